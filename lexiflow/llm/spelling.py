"""Spelling variants of a corpus's words: pairs one edit apart, and the frequent form that a rare word belongs to.

Forward and reversed sorted dictionaries: of two words one edit apart, the shorter of ``m`` code points, either the
first ``m // 2`` code points or the last ``m - m // 2`` are the same in both. So each word enters the forward
dictionary by that prefix and the reversed one by that suffix, once for every ``m`` it can have in a pair (its length,
and one less), and pairs lie in ranges of equal prefix or suffix. A range of too many words is subdivided: what is
still free between prefix and suffix is halved again, and the edit leaves one half of it intact. Ranges are then
scanned and their pairs verified. The place of an edit is the length of the common prefix; every pair has one place,
so exactly one range gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import materialize, table, tidy

#: Ranges of more words are subdivided, as long as two code points or more are free. With one, the alphabet bounds a range.
RANGE_WORDS = 128
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
#: Free parts of up to so many code points are compared as arrays, longer ones one by one.
WIDE = 32


def counter(min_chars: int, drop_every: int | None):
    """Arrow function from (key, text) to (word, n): counts of the words of ``min_chars`` code points or more."""

    def run(batches):
        import re
        import zlib
        from collections import Counter, defaultdict
        from itertools import count

        import numpy as np
        import pyarrow as pa

        find = re.compile("[A-Za-zÀ-ÿ]+").findall
        low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        ids, n, dropped = defaultdict(count().__next__), np.zeros(1024, np.int64), Counter()
        crc, size = np.zeros(1024, np.uint32), np.zeros(1024, np.int64)
        zeros: list[int] = []

        def out():
            words = list(ids)
            found = {w: c for w, c in zip(words, n[: len(words)].tolist(), strict=True) if c and len(w) >= min_chars}
            for w, c in dropped.items():
                found[w] = found.get(w, 0) + c
            ids.clear()
            ids.default_factory = count().__next__
            n[:] = 0
            dropped.clear()
            for at in range(0, len(found), 50_000):
                part = list(found)[at : at + 50_000]
                yield pa.record_batch({"word": pa.array(part, pa.string()), "n": pa.array([found[w] for w in part], pa.int64())})

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, key in enumerate(keys):
                text = texts[at].as_py()
                if not text:
                    continue
                words = Counter(find(text.encode().translate(low).decode()))
                if not words:
                    continue
                old = len(ids)
                mine = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                if len(ids) > len(n):
                    n, crc, size = (np.concatenate([a, np.zeros(max(len(a), len(ids) - len(a)), a.dtype)]) for a in (n, crc, size))
                times = np.fromiter(words.values(), np.int64, len(words))
                n[mine] += times
                if drop_every:
                    # The checksum is linear: that of a start and a word is the word's own, and the start's put off by as many bytes.
                    names = list(words)
                    for j in np.flatnonzero(mine >= old).tolist():
                        b = names[j].encode()
                        crc[mine[j]], size[mine[j]] = zlib.crc32(b), len(b)
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    most = int(size[mine].max())
                    while len(zeros) <= most:
                        zeros.append(zlib.crc32(bytes(len(zeros))))
                    put_off = {s: zlib.crc32(bytes(s), start) ^ zeros[s] for s in np.unique(size[mine]).tolist()}
                    by_size = np.array(list(put_off)), np.array(list(put_off.values()), np.uint32)
                    h = by_size[1][np.searchsorted(by_size[0], size[mine])] ^ crc[mine]
                    for j in np.flatnonzero(h % drop_every == 0).tolist():
                        w, i = names[j], int(h[j]) % len(names[j])
                        n[mine[j]] -= times[j]
                        if len(w) > min_chars:
                            dropped[w[:i] + w[i + 1 :]] += int(times[j])
                if len(ids) > HELD_WORDS:
                    yield from out()
        yield from out()

    return run


def dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """word, n of the words of all texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased.

    Words of fewer than ``min_chars`` code points or ``min_count`` occurrences are left out. With ``drop_every`` d, a
    word whose crc32 (of key, ``:``, word) d divides loses its code point at that crc32 modulo its length; a null key
    reads as empty. Null and empty texts have no words; repeated rows count again; other columns take no part.
    """
    parts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(counter(min_chars, drop_every)), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _entries(words: DataFrame) -> DataFrame:
    """word, m, p, s: a word in the ranges of both dictionaries that it can share with a near word, the shorter of
    ``m`` code points; ``p`` and ``s`` are the lengths of the prefix and suffix that the range has in common."""
    e = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    e = e.withColumn("_k", F.explode(F.array(F.struct(half.alias("p"), F.lit(0).alias("s")), F.struct(F.lit(0).alias("p"), (F.col("m") - half).alias("s")))))
    return e.select("word", "n", "m", "_k.p", "_k.s")


def _keyed(e: DataFrame) -> DataFrame:
    """Entries with the text of their range: prefix, and suffix read backwards."""
    return e.withColumn("head", F.substring("word", F.lit(1), F.col("p"))).withColumn("tail", F.reverse(F.substring("word", F.length("word") - F.col("s") + 1, F.col("s"))))


def ranges(words: DataFrame, most: int = RANGE_WORDS) -> DataFrame:
    """Entries (word, n, m, p, s) of ranges of at most ``most`` words each, or of one free code point."""
    rest, ready, free = _entries(words), None, F.col("m") - F.col("p") - F.col("s")
    while True:
        e = _keyed(rest).withColumn("id", F.xxhash64("m", "p", "s", "head", "tail")).drop("head", "tail")
        large = materialize(e.filter(free >= 2).groupBy("id").count().filter(F.col("count") > most).select("id"), "spelling-large")
        if large.isEmpty():
            return rest if ready is None else ready.unionByName(rest)
        # Short ranges of the same hash stay together and are subdivided with no harm.
        fits = e.join(large, "id", "left_anti").drop("id")
        ready = fits if ready is None else ready.unionByName(fits)
        g = F.floor(free / 2).cast("int")
        left = F.struct((F.col("p") + g).alias("p"), F.col("s").alias("s"))
        right = F.struct(F.col("p").alias("p"), (F.col("m") - F.col("p") - g).alias("s"))
        split = e.join(large, "id", "left_semi").withColumn("_k", F.explode(F.array(left, right)))
        rest = materialize(split.select("word", "n", "m", "_k.p", "_k.s"), "spelling-split")


def _near(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common prefix, and of the common suffix."""
    from os.path import commonprefix

    return len(commonprefix([a, b])), len(commonprefix([a[::-1], b[::-1]]))


def _scan(batches):
    """Pairs of the ranges of a sorted part of the dictionaries: word, n, other, other_n."""
    import numpy as np
    import pyarrow as pa

    def verified(rows):
        """rows: range number, free (of the shorter), bounded, word, n, mid; ranges whole and together, shorter words first."""
        block, free, bounded, mid = rows["block"], rows["free"], rows["bounded"], rows["mid"]
        length = np.fromiter(map(len, mid), np.int64, len(mid))
        first = np.flatnonzero(np.diff(np.concatenate([[-1], block])))
        ends = np.append(first[1:], len(block))
        left = np.repeat(ends, ends - first) - np.arange(len(block))  # rows from this one to its range's end
        wide = free > WIDE
        slim = np.array([x if n <= WIDE + 1 else "" for x, n in zip(mid, length.tolist(), strict=True)], dtype=f"<U{WIDE + 2}")
        back = np.array([x[::-1] if n <= WIDE + 1 else "" for x, n in zip(mid, length.tolist(), strict=True)], dtype=f"<U{WIDE + 2}")
        ahead, behind = (np.ascontiguousarray(x).view(np.uint32).reshape(len(mid), -1) for x in (slim, back))
        width = min(WIDE + 2, int(length[~wide].max(initial=0)) + 1)
        ahead, behind = ahead[:, :width], behind[:, :width]
        at, step, a, b = np.flatnonzero((length == free) & (left > 1)), 1, [], []
        while len(at):
            other = at + step
            slow = wide[at]
            i, j = at[~slow], other[~slow]
            for lo in range(0, len(i), 1 << 16):
                x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                differs = ahead[x] != ahead[y]
                pre = np.where(differs.any(1), differs.argmax(1), width)
                pre = np.minimum(pre, free[x])
                differs = behind[x] != behind[y]
                post = np.where(differs.any(1), differs.argmax(1), width)
                post = np.minimum(post, free[x])
                ok = (pre + post >= np.maximum(length[x], length[y]) - 1) & ((pre < free[x]) | ~bounded[x])
                a.append(x[ok])
                b.append(y[ok])
            for x, y in zip(at[slow].tolist(), other[slow].tolist(), strict=True):
                pre, post = _near(mid[x], mid[y])
                pre, post = min(pre, int(free[x])), min(post, int(free[x]))
                if pre + post >= max(length[x], length[y]) - 1 and (pre < free[x] or not bounded[x]):
                    a.append(np.array([x]))
                    b.append(np.array([y]))
            step += 1
            at = at[left[at] > step]
        if not a:
            return
        a, b = np.concatenate(a), np.concatenate(b)
        for lo in range(0, len(a), 50_000):
            x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
            yield pa.record_batch({"word": rows["word"].take(pa.array(x)), "n": pa.array(rows["n"][x]), "other": rows["word"].take(pa.array(y)), "other_n": pa.array(rows["n"][y])})

    names = ("word", "n", "m", "p", "s", "head", "tail", "mid")
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held.select(["head", "tail", "m", "p", "s"])
        if len(held) < 20_000:
            continue
        last = keys.slice(len(held) - 1).to_pylist()[0]
        # The last range may go on in the next batch.
        cut = len(held) - 1
        while cut and keys.slice(cut - 1, 1).to_pylist()[0] == last:
            cut -= 1
        if cut:
            yield from verified(_rows(held.slice(0, cut).select(names)))
            held = held.slice(cut)
    if held is not None and len(held):
        yield from verified(_rows(held.select(names)))


def _rows(t) -> dict:
    import numpy as np
    import pyarrow.compute as pc

    t = t.combine_chunks()
    get = lambda c: t.column(c).to_numpy()
    m, p, s = get("m"), get("p"), get("s")
    new = np.ones(len(t), bool)
    new[1:] = (m[1:] != m[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    for c in ("head", "tail"):
        x = t.column(c)
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False) if len(t) > 1 else False
    return {"block": np.cumsum(new), "free": (m - p - s).astype(np.int64), "bounded": s > 0, "word": t.column("word").combine_chunks(), "n": get("n"), "mid": t.column("mid").to_pylist()}


def near_pairs(words: DataFrame, most: int = RANGE_WORDS) -> DataFrame:
    """word, n, other, other_n of every pair of words (word, n; words distinct and of two code points or more) that
    differ by exactly one inserted, deleted or replaced code point, each pair once."""
    e = materialize(ranges(words, most), "spelling-entries")
    e = _keyed(e).withColumn("mid", F.substring("word", F.col("p") + 1, F.length("word") - F.col("p") - F.col("s"))).withColumn("_longer", F.length("word") > F.col("m"))
    order = ["head", "tail", "m", "p", "s"]
    slices = e.repartitionByRange(*order).sortWithinPartitions(*order, "_longer", "word").drop("_longer")
    return slices.mapInArrow(tidy(_scan), "word string, n long, other string, other_n long")


def variants(words: DataFrame, ratio: int = 10, most: int = RANGE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``words`` (word, n; words distinct and not null).

    ``form`` is the near word of the largest n (ties: the smallest by code points) if that n is at least ``ratio``
    (over 1) times the word's own, else null; ``root`` follows forms to the last, or is the word. Words without a near
    word have n_near 0. An empty table gives no rows.
    """
    found = near_pairs(words, most)
    both = found.withColumn("_p", F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))).select("_p.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("_b"))
    kept = -F.col("_b.n") >= ratio * F.col("n")
    best = best.select("word", "n_near", F.when(kept, F.col("_b.word")).alias("form"), F.when(kept, -F.col("_b.n")).alias("form_n"))
    out = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n"), "spelling-forms")
    # Pointers double each round; n grows along them, so they end.
    links = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        links = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            break
    return out.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = materialize(dictionary(docs, drop_every=31), "spelling-words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def _oracle() -> str:
    from .merkle import CRC, CRC_TABLE

    code = "unicode(c)::BIGINT"
    utf8 = f"list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 | ({code} >> 6), 128 | ({code} & 63)] END)"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
h AS (SELECT run, k, {CRC.format(bytes=f'flatten({utf8})')} AS h FROM r, crc_table),
o AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n, length(word) AS l FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS (SELECT word, n, l, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, l + 1)) AS i)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON x.rest = w.word
  UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.rest = w.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)
"""


ORACLE = _oracle()
