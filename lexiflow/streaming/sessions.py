"""Conversation and session state: batch views and their Structured Streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= n)


def context(turns: DataFrame, n: int) -> DataFrame:
    """The last n user and assistant turns as one text, oldest first."""
    kept = last_turns(turns.filter(F.col("role").isin("user", "assistant")), n)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions per user: events no further apart than the gap. Works on a stream if a watermark is set."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions_stream(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """The streaming form: late by no more than the gap."""
    return sessions(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap), gap)


def distinct_stream(rows: DataFrame, key: str, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Rows of a stream whose key was not seen within the watermark."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def running(batches: DataFrame, order: str, total: str, correct: str) -> DataFrame:
    """Cumulative totals and accuracy after each batch."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    return batches.withColumn("cum_total", F.sum(total).over(w)).withColumn("cum_correct", F.sum(correct).over(w)).withColumn("cum_accuracy", F.col("cum_correct") / F.col("cum_total"))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not processed yet: what a resumed run has left to do."""
    return todo.join(done.select(key), key, "left_anti")


# --- durable sessions

#: A session that no message reaches for so long is over; within an hour it counts as active.
LIFE_SECONDS, ACTIVE_SECONDS = 7 * 86_400, 3_600
#: Messages of a session that its state holds, the latest: what a history may ask for.
HISTORY = 50
#: The conversation id that asks for a new session.
NEW = "default"
TURNS = "conv_id string, session int, turn long, created timestamp, ts timestamp, role string, text string, active boolean"


def messages(rows: DataFrame, conv_id: str, ts: str, role: str, text: str, message_id: Column) -> DataFrame:
    """conv_id, ts, role, text: conversation ids as texts. Every message to ``default`` begins a session of its own, named
    by its id; null conversation ids are ``default``."""
    name = F.coalesce(F.col(conv_id).cast("string"), F.lit(NEW))
    fresh = F.concat(F.lit("s-"), F.substring(F.sha2(message_id.cast("string"), 256), 1, 32))
    return rows.select(F.when(name == NEW, fresh).otherwise(name).alias("conv_id"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def numbered(rows: DataFrame) -> DataFrame:
    """Batch form of ``durable``: the sessions of all messages (conv_id, ts, role, text), in the order of ts, role, text."""
    w = Window.partitionBy("conv_id").orderBy("ts", "role", "text")
    gap = F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")
    rows = rows.withColumn("_gap", gap).withColumn("session", F.sum((F.coalesce("_gap", F.lit(0.0)) > LIFE_SECONDS).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    own = Window.partitionBy("conv_id", "session").orderBy("ts", "role", "text")
    new = F.row_number().over(own) == 1
    rows = rows.withColumn("turn", (F.row_number().over(own) - 1).cast("long")).withColumn("created", F.first("ts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("active", ~new & (F.col("_gap") <= ACTIVE_SECONDS)).select(*[c.split(" ")[0] for c in TURNS.split(", ")])


def durable(rows: DataFrame, stored: DataFrame | None = None, late: str | None = None) -> DataFrame:
    """A stream of messages (conv_id, ts, role, text) with their session and turn, by state that outlives restarts.

    Each row of a trigger, in the order of ts, role and text, joins the conversation's session or, if that has been
    without a message for seven days, begins the next; ``turn`` counts a session's messages from 0, ``created`` is its
    first time, ``active`` says whether the message before it is an hour old at most. Messages that come in a later
    trigger than younger ones are numbered as they come. Without ``late`` none is dropped and states stay, up to
    ``HISTORY`` messages a conversation. With it, a session's state goes by a timer seven days of event time after its
    last message, only the number of the next one stays, and messages that come later than that behind the youngest
    are dropped, as watermarks do. ``stored`` (conv_id, session, turns, created,
    last: one row each) is what an earlier table knows: conversations go on from there. A trigger's rows of one
    conversation are held at once: bound triggers by files.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Sessions(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.head = handle.getValueState("head", "session int, turns long, created timestamp, last timestamp, timer long")
            self.log = handle.getListState("log", "role string, text string, ts timestamp")

        def handleInitialState(self, key, initialState, timerValues):
            for r in initialState.itertuples(index=False):
                self._keep((int(r.session), int(r.turns), r.created.to_pydatetime(), r.last.to_pydatetime()), 0)

        def _keep(self, head, timer):
            due = int((head[3].timestamp() + LIFE_SECONDS) * 1000) + 1
            if late:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.head.update((*head, due))

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            got = pd.concat(list(rows)).sort_values(["ts", "role", "text"], kind="stable")
            session, turns, created, last, timer = self.head.get() if self.head.exists() else (0, 0, None, None, 0)
            log = [tuple(x) for x in self.log.get()] if self.log.exists() else []
            out = []
            for ts, role, text in zip(got["ts"], got["role"], got["text"], strict=True):
                ts = ts.to_pydatetime()
                gap = (ts - last).total_seconds() if last is not None else None
                if gap is not None and gap > LIFE_SECONDS:
                    session, turns, created, log = session + 1, 0, None, []
                active = turns > 0 and gap is not None and gap <= ACTIVE_SECONDS
                created = created or ts
                out.append((key[0], session, turns, created, ts, role, text, active))
                log = [*log[1 - HISTORY :], (role, text, ts)]
                turns, last = turns + 1, max(last, ts) if last else ts
            self._keep((session, turns, created, last), timer or 0)
            self.log.put(log)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in TURNS.split(", ")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.head.update((self.head.get()[0] + 1, 0, None, None, 0))
            self.log.clear()
            return iter(())

        def close(self):
            pass

    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = stored.groupBy("conv_id") if stored is not None else None
    given = rows.withWatermark("ts", late) if late else rows
    return given.groupBy("conv_id").transformWithStateInPandas(Sessions(), TURNS, "Append", "EventTime" if late else "None", initialState=first)


def head(turns: DataFrame) -> DataFrame:
    """conv_id, session, turns, created, last: the session table of numbered messages, as ``durable`` takes it."""
    last = turns.groupBy("conv_id").agg(F.max("session").alias("session"))
    own = turns.join(last, ["conv_id", "session"]).groupBy("conv_id", "session")
    return own.agg(F.count("*").alias("turns"), F.min("created").alias("created"), F.max("ts").alias("last"))


def sessions_of(turns: DataFrame) -> DataFrame:
    """One row per session, as a JSON store keeps it: conv_id, session, created, last, document (a JSON text with all
    messages in order). Messages are gathered per session: one conversation is one document."""
    message = F.struct("turn", "role", F.col("text").alias("content"), "ts")
    own = turns.groupBy("conv_id", "session").agg(F.min("created").alias("created"), F.max("ts").alias("last"), F.array_sort(F.collect_list(message)).alias("messages"))
    return own.select("conv_id", "session", "created", "last", F.to_json(F.struct("conv_id", "created", "last", "messages")).alias("document"))


# --- resumable results


def write_once(rows: DataFrame, path: str, checkpoint: str, evaluate=None):
    """Start a stream that writes results batch by batch under ``path``, each batch once.

    A batch goes to a folder of its own number, replacing what an attempt that died left there, so a batch that runs
    again after a crash counts once; ``evaluate`` maps a batch's rows to its results. All files that are there are
    worked off, in batches as ``throttled`` cuts them, and the stream ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = evaluate(batch) if evaluate else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(spark, path: str, schema, files: int) -> DataFrame:
    """A stream of the Parquet files of a folder, at most ``files`` a trigger: the rate limit of what follows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def progress(results: DataFrame, correct: str) -> DataFrame:
    """batch, n, cum_total, cum_correct, cum_accuracy of written results (with their batch number)."""
    each = results.groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("_right"))
    return running(each, "batch", "n", "_right").select("batch", "n", "cum_total", "cum_correct", "cum_accuracy")
