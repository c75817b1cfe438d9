"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network routes the tokens of each pattern
to the quotas of its sources; every further copy of a pattern's tokens costs more than the one before (convex
repetition cost), so nothing is repeated while unrepeated tokens can serve. Documents of a pattern are then taken
in a seeded order until the pattern's flow is used up.

Only sums per pattern reach the driver: their number depends on the sources, never on the documents. Cumulative
sizes are two-level (sums of hash buckets, then rows of the one bucket in which a pattern's flow ends), so no task
holds a whole source, and documents themselves are never shuffled.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize, n_words, words

#: Buckets of the seeded order, as a power of two.
BUCKET_BITS = 12
WEIGHTS = (3, 1, 2)


def quotas(sizes: dict[str | None, int], total: float, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 2) -> dict[str | None, float]:
    """Targets by weight (sources in code point order, null last), none above max_copies times its size.

    What a capped source cannot use goes to the others by weight, until none is above its cap.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: max_copies * sizes[s] for s in order}
    target: dict[str | None, float] = {}
    free, left = list(order), float(total)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap[s]]
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(cap[s])
            left -= cap[s]
        free = [s for s in free if s not in target]
    return target


def route(patterns: list[tuple[tuple, int]], target: dict, max_copies: int = 2) -> dict[tuple[int, object], int]:
    """Min-cost max-flow: tokens from pattern number to source. Copy k of a pattern's tokens costs k * k.

    Successive cheapest augmenting paths on the small network start - patterns - sources - end.
    """
    ids: dict = {}
    node = lambda x: ids.setdefault(x, len(ids))
    start, end = node("start"), node("end")
    head: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[], []]

    def arc(a: int, b: int, c: int, w: int) -> int:
        while len(out) < len(ids):
            out.append([])
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(head))
            head.append(y)
            cap.append(k)
            cost.append(v)
        return len(head) - 2

    routes = {}
    for i, (members, size) in enumerate(patterns):
        p = node(("pattern", i))
        for k in range(max_copies):
            arc(start, p, size, k * k)
        for s in members:
            routes[i, s] = arc(p, node(("source", s)), max_copies * size, 0)
    for s, t in target.items():
        arc(node(("source", s)), end, round(t), 0)
    while True:
        best, by, queue, waiting = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                if cap[e] > 0 and best[a] + cost[e] < best.get(head[e], 1 << 60):
                    best[head[e]], by[head[e]] = best[a] + cost[e], e
                    if head[e] not in waiting:
                        waiting.add(head[e])
                        queue.append(head[e])
        if end not in by:
            return {k: cap[e + 1] for k, e in routes.items()}
        path, b = [], end
        while b != start:
            path.append(by[b])
            b = head[by[b] ^ 1]
        flow = min(cap[e] for e in path)
        for e in path:
            cap[e] -= flow
            cap[e ^ 1] += flow


def mix(docs: DataFrame, sources: Column, text: str = "text", key: str = "doc_id", share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 2, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` with a struct column ``mix`` (an input column of that name is replaced).

    Fields: size (words; null text: 0), taken (words the mix takes, repeats counted), pattern (JSON of the sources),
    source_sizes and targets (maps by source; the key of the null source is the JSON text null). ``sources`` is an
    array column; a null element is the null source, a null or empty array belongs nowhere and is not taken.
    The last document taken of a pattern is taken in part, so that sums meet the targets to the word. Repeated
    rows are separate documents; order among equal keys goes by size and text hash. An empty table gives none.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "mix"]
    h = F.xxhash64(F.col(f"`{key}`"), F.lit(seed))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names],
        n_words(F.col(f"`{text}`")).alias("__m_size"),
        F.to_json(F.sort_array(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))).alias("__m_pattern"),
        h.alias("__m_hash"),
        F.shiftright(h, 64 - BUCKET_BITS).alias("__m_bucket"),
    )
    sums = materialize(rows.groupBy("__m_pattern", "__m_bucket").agg(F.sum("__m_size").alias("__m_sum")), "mix-sums")
    found = [(p, tuple(json.loads(p)), int(n)) for p, n in sums.groupBy("__m_pattern").agg(F.sum("__m_sum")).orderBy("__m_pattern").collect()]
    sizes: dict = {}
    for _, members, n in found:
        for s in members:
            sizes[s] = sizes.get(s, 0) + n
    target = quotas(sizes, share * sum(n for _, m, n in found if m), weights, max_copies)
    flows = route([(m, n) for _, m, n in found], target, max_copies)
    named = lambda s: "null" if s is None else json.dumps(s, ensure_ascii=False)
    plan = []
    for i, (p, members, n) in enumerate(found):
        flow = sum(flows[i, s] for s in members)
        copies, rest = divmod(flow, n) if n else (0, 0)
        plan.append((p, copies, rest, {named(s): sizes[s] for s in members}, {named(s): float(target[s]) for s in members}))
    plan = spark.createDataFrame(plan, "__m_pattern string, __m_copies long, __m_rest long, __m_sizes map<string,long>, __m_targets map<string,double>")
    before = F.sum("__m_sum").over(Window.partitionBy("__m_pattern").orderBy("__m_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = (
        sums.withColumn("__m_before", F.coalesce(before, F.lit(0)))
        .join(F.broadcast(plan.select("__m_pattern", "__m_rest")), "__m_pattern")
        .filter((F.col("__m_before") <= F.col("__m_rest")) & (F.col("__m_rest") < F.col("__m_before") + F.col("__m_sum")))
        .select("__m_pattern", F.col("__m_bucket"), "__m_before")
        .collect()
    )  # one bucket per pattern at most
    last = spark.createDataFrame([tuple(r) for r in ends], "__m_pattern string, __m_last int, __m_before long")
    rows = rows.withColumn("__m_bucket", F.col("__m_bucket").cast("int")).join(F.broadcast(plan.join(F.broadcast(last), "__m_pattern", "left")), "__m_pattern")
    inside = F.coalesce(F.col("__m_bucket") == F.col("__m_last"), F.lit(False))
    clear = rows.filter(~inside).withColumn("__m_part", F.when(F.coalesce(F.col("__m_bucket") < F.col("__m_last"), F.lit(False)), F.col("__m_size")).otherwise(0))
    order = Window.partitionBy("__m_pattern").orderBy("__m_hash", F.col(f"`{key}`"), "__m_size", F.xxhash64(F.col(f"`{text}`"))).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("__m_before") + F.coalesce(F.sum("__m_size").over(order), F.lit(0))
    split = rows.filter(inside).withColumn("__m_part", F.greatest(F.lit(0), F.least(F.col("__m_size"), F.col("__m_rest") - at)))
    out = clear.unionByName(split)
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.struct(
            F.col("__m_size").alias("size"),
            (F.col("__m_copies") * F.col("__m_size") + F.col("__m_part")).cast("long").alias("taken"),
            F.col("__m_pattern").alias("pattern"),
            F.col("__m_sizes").alias("source_sizes"),
            F.col("__m_targets").alias("targets"),
        ).alias("mix"),
    )


def take(mixed: DataFrame, text: str = "text", whole_only: bool = False) -> DataFrame:
    """The documents of a mix: each row as often as it is taken whole, and once more with its first words (joined by
    one space) if it is taken in part. With ``whole_only`` a document taken in part is given once more in full if half
    of it or more is taken, else not: whichever is nearer to the target. Untaken rows and documents without a word go."""
    size, taken = F.greatest(F.col("mix.size"), F.lit(1)), F.col("mix.taken")
    if whole_only:
        taken = F.floor((2 * taken + size) / (2 * size)) * size
    rest = (taken % size).cast("int")
    whole = F.array_repeat(F.col(f"`{text}`"), F.floor(taken / size).cast("int"))
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words(F.col(f"`{text}`")), F.lit(1), F.greatest(rest, F.lit(1))), " "))).otherwise(F.array().cast("array<string>"))
    names = [c for c in mixed.columns if c != "mix"]
    out = mixed.filter(taken > 0).withColumn("__m_texts", F.concat(whole, part))
    return out.select(*[F.col(f"`{c}`") for c in names if c != text], F.explode("__m_texts").alias(text)).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.array("source"))
    only = lambda c: F.element_at(F.map_values(c), 1)
    return m.select("doc_id", F.col("mix.size").alias("size"), only("mix.source_sizes").alias("source_size"), only("mix.targets").alias("target"), F.col("mix.taken").alias("taken"))
