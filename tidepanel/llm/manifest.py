"""A Merkle manifest of a table: a digest a row, a tree a language, a root over all, and a proof for every row.

The rows of a language are ranked by doc_id and cut into aligned blocks of 2 ** HEIGHT. Each block
is traversed on its own, recursively and in postorder: a subtree returns its digest, and while the
recursion unwinds, the digest of each half is appended to the proofs of the leaves in the other
half. The blocks' roots are the nodes of the next traversal, until each language has one; the
languages' roots are traversed in the same way. Proofs are put together from the top down: a node
extends its block's proof, so no join has more than 2 ** HEIGHT rows of a key.

A single node at the end of a level, with others before it, has no sibling and is hashed alone.

Cases: null columns are hashed as "-", null languages are a tree of their own, the first; null
doc_ids come first. Rows of one doc_id and language go by their digests; repeated rows are leaves
of their own. An empty table has no rows and no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .ordering import ranked

#: Binary logarithm of a block's nodes.
HEIGHT = 10
#: What stands before a sibling in a path: it is on the left, it is on the right; or there is none.
LEFT, RIGHT, NONE = b"L", b"R", b"-"
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row, with some columns replaced."""
    return F.unhex(F.sha2(F.concat(*(field((changed or {}).get(c, F.col(c))) for c in FIELDS)), 256))


def digest(*nodes: bytes) -> bytes:
    """The digest of nodes' digests as hex text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def subtree(nodes: list[bytes], paths: list[bytearray], low: int, height: int) -> bytes:
    """The digest over nodes low to low + 2 ** height, whose siblings are appended to the paths below it."""
    if height == 0:
        return nodes[low]
    middle, end = low + (1 << height - 1), min(low + (1 << height), len(nodes))
    left = subtree(nodes, paths, low, height - 1)
    if middle >= end:
        for path in paths[low:end]:
            path += NONE
        return digest(left)
    right = subtree(nodes, paths, middle, height - 1)
    for path in paths[low:middle]:
        path += RIGHT + right
    for path in paths[middle:end]:
        path += LEFT + left
    return digest(left, right)


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path lead to."""
    at = 0
    while at < len(path):
        side, sibling = path[at : at + 1], path[at + 1 : at + 1 + SIZE]
        at += 1 if side == NONE else 1 + SIZE
        node = digest(node) if side == NONE else digest(sibling, node) if side == LEFT else digest(node, sibling)
    return node


def siblings(path: bytes) -> bytes:
    """The siblings of a path alone."""
    out, at = [], 0
    while at < len(path):
        if path[at : at + 1] == NONE:
            at += 1
        else:
            out.append(path[at + 1 : at + 1 + SIZE])
            at += 1 + SIZE
    return b"".join(out)


def _traversed(height: int):
    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        nodes, total = rows.column("node").to_pylist(), rows.column("total")[0].as_py()
        levels = min(height, max(total - 1, 0).bit_length())
        paths = [bytearray() for _ in nodes]
        root = subtree(nodes, paths, 0, levels)
        roots = [root] + [None] * (len(nodes) - 1)  # with the block's first node only
        return rows.append_column("path", pa.array([bytes(p) for p in paths], pa.binary())).append_column("top", pa.array(roots, pa.binary()))

    return block


def climbed(scratch: common.Scratch, nodes: DataFrame, name: str, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks over nodes (tree, rank, total, node, more), each with path and top, and the trees' roots (tree, node)."""
    levels = []
    while True:
        block = F.shiftright("rank", height)
        grouped = nodes.withColumn("block", block).groupBy("tree", "block")
        schema = StructType(nodes.schema.fields).add("block", "long").add("path", "binary").add("top", "binary")
        found = grouped.applyInArrow(_traversed(height), schema)
        levels.append(scratch.save(found, f"{name}-{len(levels)}"))
        tops = levels[-1].filter("top IS NOT NULL").select("tree", F.col("block").alias("rank"), F.ceil(F.col("total") / (1 << height)).cast("long").alias("total"), F.col("top").alias("node"))
        if tops.filter("total > 1").isEmpty():
            return levels, tops.select("tree", "node")
        # trees of one block are done; their root waits as it is, as a block of one node stays that node
        nodes = tops


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with its whole path: each level extends the paths of its blocks; above (tree, rank, path, more) goes with the trees' roots."""
    kept = above.columns
    for level in reversed(levels):
        up = above.select(kept).withColumnsRenamed({"rank": "block", "path": " up"})
        above = level.drop("top").join(up, ["tree", "block"]).withColumn("path", F.concat("path", " up")).drop(" up", "block")
    return above


def _finished(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        proofs = [hashlib.sha256(siblings(p).hex().encode()).hexdigest() for p in rows["path"]]
        tops = [folded(t if t is not None else n, p) for n, t, p in zip(rows["node"], rows["tampered"], rows["path"])]
        columns = [common.column(batch, "doc_id"), pa.array([n.hex() for n in rows["node"]], pa.string()), pa.array([s.hex() for s in rows["subroot"]], pa.string())]
        columns += [pa.array([root.hex()] * len(tops), pa.string()), pa.array(proofs, pa.string()), pa.array([t.hex() for t in tops], pa.string()), pa.array([t == root for t in tops], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(spark: SparkSession, docs: DataFrame, tampered: Column | None = None, changes: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    tampered: of which rows the leaf is taken with ``changes`` when its root is recomputed.
    """
    scratch = common.Scratch(spark)
    other = F.when(tampered, leaf(changes)) if tampered is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first, then by bytes
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf().alias("node"), other.alias("tampered"))
    levels, roots = climbed(scratch, ranked(scratch, leaves, "tree", ["doc_id", "node"], "leaves"), "language", height)
    languages = roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node")
    over, top = climbed(scratch, ranked(scratch, languages, "tree", ["lang"], "languages"), "all", height)
    result = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root = top.first()
    if root is None:
        return spark.createDataFrame([], result)
    first = top.select("tree", F.lit(0).cast("long").alias("rank"), F.lit(b"").alias("path"))
    paths = descended(over, first).select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.col("node").alias("subroot"))
    rows = descended(levels, paths.select("tree", "rank", "path", "subroot"))
    value = bytes(root["node"])
    return rows.select("doc_id", "node", "tampered", "path", "subroot").mapInArrow(lambda batches: _finished(batches, value), result)


def seventh(doc_id: Column) -> Column:
    """Whether 7 divides the crc32 of a decimal doc_id; null counts as no."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


CRC_TABLE_SQL = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) FROM range(256) t(i))"


def crc_sql(octets: str, table: str) -> str:
    """The unsigned crc32 of a list of bytes, by a list of 256 numbers."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


FIELD_SQL = {c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS}
LEAF_SQL = "sha256(" + " || ".join(FIELD_SQL.values()) + ")"
TAMPERED_SQL = LEAF_SQL.replace(FIELD_SQL["n_chars"], FIELD_SQL["n_chars"].replace("n_chars", "(n_chars + 1)"))
UP_SQL = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
STEPS_SQL = "CASE WHEN (place >> level) % 2 = 1 THEN 'L' || nodes[(place >> level)] ELSE 'R' || coalesce(nodes[(place >> level) + 2], '') END"
SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE_SQL} AS t),
  leaves AS (SELECT doc_id, lang, {LEAF_SQL} AS leaf, CASE WHEN {crc_sql("list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))", "crc.t")} % 7 = 0 THEN {TAMPERED_SQL} ELSE {LEAF_SQL} END AS other FROM documents, crc),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
  trees AS (
    SELECT coalesce('=' || lang, '') AS tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
    UNION ALL
    SELECT tree, level + 1, {UP_SQL} FROM trees WHERE len(nodes) > 1),
  subroots AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM trees WHERE len(nodes) = 1),
  tops AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, {UP_SQL} FROM tops WHERE len(nodes) > 1),
  low AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, place, leaf, other FROM placed),
  steps AS (
    SELECT l.tree, l.place, list({STEPS_SQL} ORDER BY level) AS steps FROM low l JOIN trees t ON l.tree = t.tree AND len(t.nodes) > 1 GROUP BY ALL),
  high AS (
    SELECT tree, subroot, list({STEPS_SQL} ORDER BY level) FILTER (level IS NOT NULL) AS steps FROM subroots LEFT JOIN tops ON len(nodes) > 1 GROUP BY ALL),
  found AS (
    SELECT l.doc_id, l.leaf, h.subroot, l.other, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, list_concat(coalesce(s.steps, []), coalesce(h.steps, [])) AS steps
    FROM low l JOIN high h ON l.tree = h.tree LEFT JOIN steps s ON s.tree = l.tree AND s.place = l.place),
  folds AS (
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
      list_reduce(list_prepend(other, steps), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
