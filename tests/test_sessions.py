"""Durable sessions and resumable results: streams against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexiflow.streaming import sessions as S

START = dt.datetime(2024, 3, 1)
SCHEMA = "conv_id string, ts timestamp, role string, text string"


def _turns(n=120, seed=1):
    r, at, rows = random.Random(seed), {c: START for c in "abcd"}, []
    for i in range(n):
        c = r.choice("aaabcd")
        at[c] += dt.timedelta(seconds=r.choice([30, 1800, 3600, 3601, 90_000, 604_800, 604_801, 900_000]))
        rows.append((c, at[c], r.choice(["user", "assistant"]), f"m{i}"))
    return sorted(rows, key=lambda x: x[1])


def _stream(spark, folder, parts):
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _run(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination(60)


def _got(df):
    return sorted((x.conv_id, x.session, x.turn, x.created, x.ts, x.role, x.text, x.active) for x in df.collect())


@pytest.mark.parametrize("late", [None, "30 days"])
def test_sessions_of_a_stream_equal_the_batch_form_over_a_restart(spark, tmp_path, late):
    rows = _turns()
    source = tmp_path / "in"
    _run(S.durable(_stream(spark, source, [rows[:50], rows[50:70]]), late=late), tmp_path / "out", tmp_path / "c")
    _run(S.durable(_stream(spark, source, [rows[70:]]), late=late), tmp_path / "out", tmp_path / "c")
    want = _got(S.numbered(spark.createDataFrame(rows, SCHEMA)))
    assert _got(spark.read.parquet(str(tmp_path / "out"))) == want
    assert max(x[1] for x in want) > 1 and len({x[0] for x in want}) == 4


def test_sessions_go_on_from_a_stored_table(spark, tmp_path):
    rows = [("a", START, "user", "1"), ("b", START, "user", "1"), ("a", START + dt.timedelta(days=3), "user", "2")]
    later = [("a", START + dt.timedelta(days=4), "assistant", "3"), ("b", START + dt.timedelta(days=9), "user", "2"), ("c", START + dt.timedelta(days=9), "user", "1")]
    known = S.head(S.numbered(spark.createDataFrame(rows, SCHEMA)))
    _run(S.durable(_stream(spark, tmp_path / "in", [later]), stored=known), tmp_path / "out", tmp_path / "c")
    got = [(x[0], x[1], x[2]) for x in _got(spark.read.parquet(str(tmp_path / "out")))]
    assert got == [("a", 0, 2), ("b", 1, 0), ("c", 0, 0)]


def test_default_and_missing_ids(spark):
    rows = spark.createDataFrame([(1, "default", "x"), (2, "default", "x"), (3, None, "x"), (4, "7", None)], "id long, c string, t string").withColumn("at", F.lit(START)).withColumn("who", F.lit("user"))
    out = S.messages(rows, "c", "at", "who", "t", F.col("id")).collect()
    assert len({x.conv_id for x in out}) == 4 and "7" in {x.conv_id for x in out} and [x.text for x in out if x.conv_id == "7"] == [""]
    doc = S.sessions_of(S.numbered(S.messages(rows.filter("id = 4"), "c", "at", "who", "t", F.col("id")))).first()
    assert doc.session == 0 and '"content":""' in doc.document


def test_a_batch_counts_once(spark, tmp_path):
    """A run that dies between writing a batch and committing it equals an unbroken one."""
    for i in range(4):
        spark.createDataFrame([(10 * i + j, j % 3 == 0) for j in range(5)], "id long, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "id long, ok boolean"
    died = []

    def dies(batch):
        if not died and batch.filter("id >= 20").count() and len(list((tmp_path / "out").glob("batch=*"))) >= 2:
            died.append(1)
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch=2")  # written, never committed
            raise RuntimeError("killed")
        return batch

    with pytest.raises(Exception, match="killed"):
        S.write_once(S.throttled(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/c", evaluate=dies).awaitTermination(120)
    S.write_once(S.throttled(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/c", evaluate=dies).awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert died and sorted(x.id for x in out.collect()) == [10 * i + j for i in range(4) for j in range(5)]
    last = S.progress(out, "ok").orderBy(F.desc("batch")).first()
    assert (last.batch, last.cum_total, last.cum_correct) == (3, 20, 8)
