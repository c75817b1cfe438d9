"""Merkle manifest of a table: every row a leaf, a tree per group, and a tree over the groups' roots.

Parent-preimage paths: for every parent the concatenated hashes of its children (its preimage) are stored. A leaf
joins the preimages of its ancestors, excises its own 64 characters from each to get its siblings, and splices a
replacement into each to fold a claimed leaf up to the root.

Nodes are numbered by a range partitioning in leaf order, so a group of any size lies over many tasks. A stage
hashes blocks of ``FAN ** LEVELS`` consecutive nodes, all their levels in one row; the blocks' tops are the nodes of
the next stage. Stage tables are written to the shared folder: they are the stored manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize, table

#: Children of a parent, and levels that one row of a stage holds.
FAN, LEVELS = 3, 3
SIZE = FAN**LEVELS
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """One leaf input: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value (integers as decimals)."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _numbered(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """``nodes`` with ``idx``, their place in their tree from 0, and ``n``, the number of the tree's nodes.

    Rows are dealt by ranges of (tree, order), with the row's place in the input as last key, so neither a hot tree
    nor equal rows meet in one task. Places in a task follow from the written row numbers; offsets are summed over
    one row per tree and task.
    """
    keys = ["tree", *order, "_tie"]
    rows = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("_task", F.shiftright("_at", 33))
    tree = Window.partitionBy("tree")
    parts = rows.groupBy("tree", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    parts = parts.withColumn("_before", F.sum("_rows").over(tree.orderBy("_task")) - F.col("_rows")).withColumn("n", F.sum("_rows").over(tree)).drop("_rows")
    return rows.join(parts, ["tree", "_task"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_first", "_before")


def _joined(h: Column) -> Column:
    """Every ``FAN`` consecutive hashes as one string, the last of fewer."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / FAN).cast("int")), lambda i: F.array_join(F.slice(h, i * FAN + 1, F.lit(FAN)), ""))


def _stages(nodes: DataFrame) -> list[DataFrame]:
    """Stage tables (tree, block, n, levels, top) of nodes (tree, idx, n, hash), lowest first.

    ``levels`` holds the preimages of the block's parents by level; a tree that fits a block stops at one node, any
    other goes up all levels in every block, so all leaves of a tree have the same depth.
    """
    stages = []
    while True:
        block = F.floor(F.col("idx") / SIZE).alias("block")
        b = nodes.groupBy("tree", block, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("_h0"))
        for level in range(1, LEVELS + 1):
            h = F.col(f"_h{level - 1}")
            goes = (F.col("n") > SIZE) | (F.size(h) > 1)
            b = b.withColumn(f"_p{level}", F.when(goes, _joined(h)).otherwise(F.array().cast("array<string>")))
            b = b.withColumn(f"_h{level}", F.when(goes, F.transform(f"_p{level}", lambda p: F.sha2(p, 256))).otherwise(h))
        b = b.select("tree", "block", "n", F.array(*[f"_p{level}" for level in range(1, LEVELS + 1)]).alias("levels"), F.element_at(f"_h{LEVELS}", 1).alias("top"))
        stages.append(materialize(b, f"merkle-stage{len(stages)}"))
        taller = stages[-1].filter(F.col("n") > SIZE)
        if taller.isEmpty():
            return stages
        nodes = taller.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / SIZE).alias("n"), F.col("top").alias("hash"))


def _roots(stages: list[DataFrame]) -> DataFrame:
    """tree, top of every tree."""
    out = None
    for s in stages:
        done = s.filter(F.col("n") <= SIZE).select("tree", "top")
        out = done if out is None else out.unionByName(done)
    return out


_STEP = "array<struct<preimage:string,slot:int>>"


def _steps() -> Column:
    """A node's ancestors in its block, lowest first: preimage and the node's slot in it."""
    place = (F.col("idx") % SIZE).cast("int")
    steps = [
        F.struct(F.get(F.get("levels", level - 1), F.floor(place / FAN**level).cast("int")).alias("preimage"), (F.floor(place / FAN ** (level - 1)) % FAN).cast("int").alias("slot"))
        for level in range(1, LEVELS + 1)
    ]
    return F.filter(F.array(*steps), lambda s: s["preimage"].isNotNull())


def _with_paths(nodes: DataFrame, stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """``nodes`` (of the lowest stage) with ``path``, all their ancestors, and the columns of ``above`` (tree, upper:
    the steps over the tree's root, and others).

    Paths are handed down: a stage's blocks take the path of their own node in the stage over them, so leaves meet
    one table, by blocks of ``SIZE`` leaves.
    """
    extra = [c for c in above.columns if c not in ("tree", "upper")]
    for s in range(len(stages) - 1, -1, -1):
        blocks = stages[s].filter(F.col("n") <= SIZE).join(above, "tree").select("tree", "block", "levels", "upper", *extra)
        if s + 1 < len(stages):
            blocks = blocks.unionByName(stages[s].filter(F.col("n") > SIZE).join(higher, ["tree", "block"]).select("tree", "block", "levels", "upper", *extra))
        here = nodes if s == 0 else stages[s - 1].filter(F.col("n") > SIZE).select("tree", F.col("block").alias("idx"))
        met = here.withColumn("block", F.floor(F.col("idx") / SIZE)).join(blocks, ["tree", "block"])
        met = met.withColumn("path", F.concat(_steps(), "upper")).drop("levels", "upper", "block")
        higher = met.select("tree", F.col("idx").alias("block"), F.col("path").alias("upper"), *extra) if s else met
    return higher


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (tree, idx, n, key, leaf, carried columns), the written stage tables of the groups' trees and of the
    tree over them, and ``root`` (one row: root; none for an empty table)."""

    leaves: DataFrame
    stages: list[DataFrame]
    groups: DataFrame
    top_stages: list[DataFrame]
    root: DataFrame

    def proofs(self) -> DataFrame:
        """``leaves`` with subroot, root and ``path``: the leaf's ancestors, lowest first, over the subroot to the
        root, each with its preimage and the slot (from 0) of the child that the path came from."""
        over = _with_paths(self.groups, self.top_stages, self.root.select(F.lit("").alias("tree"), "root", F.array().cast(_STEP).alias("upper")))
        above = over.select(F.col("group").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("path").alias("upper"))
        return _with_paths(self.leaves, self.stages, above)


def build(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``. ``carry`` names expressions over ``docs`` that leaves keep.

    Leaves of a group ascend by key (null first), rows of one key by leaf hash; equal rows are leaves of their own.
    Groups ascend by their UTF-8 bytes, null first, as a group of its own apart from the empty string. Nulls in any
    field hash as ``-``. Other columns take no part. An empty table has no leaves and no root.
    """
    name = F.when(F.col(f"`{group}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    leaves = docs.select(name.alias("tree"), F.col(f"`{key}`").alias("key"), leaf_hash([F.col(f"`{f}`") for f in fields]).alias("hash"), *[c.alias(f"c_{n}") for n, c in (carry or {}).items()])
    leaves = _numbered(materialize(leaves, "merkle-leaves"), ["key", "hash"], "merkle-dealt")
    stages = _stages(leaves.select("tree", "idx", "n", "hash"))
    groups = _numbered(_roots(stages).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("hash")), ["group"], "merkle-groups")
    top_stages = _stages(groups.select("tree", "idx", "n", "hash"))
    return Manifest(leaves, stages, groups, top_stages, _roots(top_stages).select(F.col("top").alias("root")))


def siblings(path: Column) -> Column:
    """The sibling hashes of a path, level by level from below, left to right, as one string."""
    own = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGITS), F.substring(s["preimage"], s["slot"] * DIGITS + DIGITS + 1, F.lit(FAN * DIGITS)))
    return F.array_join(F.transform(path, own), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * DIGITS + 1, F.lit(DIGITS)), 256))


def tampered_leaf() -> Column:
    """The leaf of the query's tampered row, where the crc32 of its id is even; null for the others and a null id."""
    text = F.regexp_replace("text", "\n", "")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf_hash([text if f == "text" else F.col(f) for f in FIELDS]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    p = build(docs, carry={"tampered": tampered_leaf()}).proofs()
    out = p.select(
        F.col("key").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.coalesce("c_tampered", "hash"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# Of bytes in a list: the checksum's table of 256 entries, then a fold.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

_F = " || ".join(f"CASE WHEN {{{f}}} IS NULL THEN '-' ELSE strlen({{{f}}}::VARCHAR)::VARCHAR || ':' || {{{f}}}::VARCHAR END" for f in FIELDS)
_LEAF = "sha256(" + _F.format(**{f: f for f in FIELDS}) + ")"
_TAMPERED = "sha256(" + _F.format(**{f: f for f in FIELDS} | {"text": "replace(text, chr(10), '')"}) + ")"
_BYTES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)"


def _tree_sql(leaves: str, up: str) -> str:
    """Levels of every tree of a table (tree, i, n, h)."""
    return f"""{up} AS (
  SELECT tree, 0 AS level, i, n, h, ''::VARCHAR AS pre FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i) FROM {up} WHERE n > 1 GROUP BY tree, level, i // 3, n)"""


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS id, doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, {_LEAF} AS leaf,
  CASE WHEN {CRC.format(bytes=_BYTES)} % 2 = 0 THEN {_TAMPERED} END AS tampered FROM documents, crc_table),
l AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql('l', 'up')},
sub AS (SELECT tree AS src, h FROM up WHERE n = 1),
tl AS (SELECT '' AS tree, src, h, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n FROM sub),
{_tree_sql('tl', 'top')},
root AS (SELECT h AS root FROM top WHERE n = 1),
path AS (
  SELECT l.id, u.level, u.pre, (l.i // (3 ** (u.level - 1))::BIGINT) % 3 AS slot FROM l JOIN up u ON u.tree = l.tree AND u.level > 0 AND u.i = l.i // (3 ** u.level)::BIGINT
  UNION ALL
  SELECT l.id, 1000 + u.level, u.pre, (tl.i // (3 ** (u.level - 1))::BIGINT) % 3 FROM l JOIN tl ON tl.src = l.tree JOIN top u ON u.level > 0 AND u.i = tl.i // (3 ** u.level)::BIGINT),
steps AS (SELECT id, list({{'pre': pre, 'slot': slot}} ORDER BY level) AS p FROM path GROUP BY id),
walk AS (
  SELECT id, p, 1 AS k, coalesce(tampered, leaf) AS h FROM l LEFT JOIN steps USING (id)
  UNION ALL
  SELECT id, p, k + 1, sha256(left(p[k].pre, 64 * p[k].slot) || h || substr(p[k].pre, 64 * p[k].slot + 65)) FROM walk WHERE k <= coalesce(len(p), 0))
SELECT l.doc_id, l.leaf, sub.h AS subroot, root.root,
  sha256(coalesce(array_to_string(list_transform(w.p, lambda s: left(s.pre, 64 * s.slot) || substr(s.pre, 64 * s.slot + 65)), ''), '')) AS proof_sha256,
  w.h AS folded_root, w.h = root.root AS verified
FROM l JOIN sub ON sub.src = l.tree JOIN walk w ON w.id = l.id AND w.k = coalesce(len(w.p), 0) + 1, root
"""
