"""Merkle manifest of a dataset: a digest for every row, a tree for each value of a column, one root, and all proofs.

A row's leaf hashes its fields. The leaves of a tree stand in ascending order; every two consecutive nodes become their
hash, a last one alone its own, until one is left, the subroot; subroots, in the order of their trees, likewise give
the root. Places come from ranges of the order and prefix sums over them, so no task orders a whole tree.

Trees are cut into aligned blocks of 2**BLOCK leaves. A first walk hashes each block to its root, and roots are nodes of
the next round of blocks until one is left. Proofs then go down: within a block the fractal traversal keeps a stack of
existing subtrees of SUB levels along the path of the current leaf and, beside each but the uppermost, the desired
subtree that comes next, which takes one leaf in at every step and is whole when it is due; the successive
authentication paths come out with 2 ** (SUB + 1) nodes a stacked subtree, and the block's upper proof, found by the
same traversal a round higher, is appended. A group of rows is one block, whatever the sizes of trees.

A proof is a text of steps of 65 characters from the leaf to the root: L or R (where the sibling stands) and its
digest, or 65 dashes where a node stands alone.

Null fields are told apart from empty ones; null trees come first and null order values first in them; rows of equal
order go by their leaves, so equal rows are interchangeable; very long texts are hashed whole; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import has, prepare, stage

#: Levels of an aligned block, and of a stacked subtree in it.
BLOCK, SUB = 9, 3
STEP = 65
ALONE = "-" * STEP


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def parent(left: str | None, right: str | None) -> str | None:
    return None if left is None else digest(left) if right is None else digest(left, right)


class Growing:
    """A subtree of nodes at the heights low to high, from leaves taken in one by one (None: past the last)."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.stack: list[tuple[int, str | None]] = []
        self.layers: list[list[str | None]] = [[] for _ in range(high - low + 1)]

    def take(self, leaf: str | None) -> None:
        height, node = 0, leaf
        while True:
            if height >= self.low:
                self.layers[height - self.low].append(node)
            if height == self.high or not self.stack or self.stack[-1][0] != height:
                break
            node = parent(self.stack.pop()[1], node)
            height += 1
        self.stack.append((height, node))


def traverse(leaves: list[str], height: int, sub: int = SUB) -> Iterator[list[str | None]]:
    """The siblings (None: alone) of successive leaves, level by level, in a tree of a height that may be incomplete."""
    bounds = [(low, min(low + sub, height)) for low in range(0, height, sub)]
    existing = [Growing(low, high) for low, high in bounds]
    at = lambda i: leaves[i] if i < len(leaves) else None
    for s, (_, high) in enumerate(bounds):
        for i in range(1 << high):
            existing[s].take(at(i))
    desired = [Growing(low, high) for low, high in bounds[:-1]]
    for i in range(len(leaves)):
        path: list[str | None] = []
        for (low, high), tree in zip(bounds, existing):
            inside = (i & ((1 << high) - 1)) >> low
            path.extend(tree.layers[k][(inside >> k) ^ 1] for k in range(high - low))
        yield path
        for s, (low, high) in enumerate(bounds[:-1]):
            desired[s].take(at(i + (1 << high)))
            if (i + 1) & ((1 << high) - 1) == 0:
                existing[s], desired[s] = desired[s], Growing(low, high)


def steps(path: list[str | None], i: int) -> str:
    """The part of a proof that a path of leaf i is."""
    return "".join(ALONE if x is None else ("L" if i >> k & 1 else "R") + x for k, x in enumerate(path))


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and a proof give."""
    for k in range(0, len(proof), STEP):
        side, other = proof[k], proof[k + 1 : k + STEP]
        leaf = digest(leaf) if side == "-" else digest(other, leaf) if side == "L" else digest(leaf, other)
    return leaf


def block_height(n: int, block: int) -> int:
    """Levels of a block of a tree that has n nodes: all, or those up to the only one."""
    return min(block, (n - 1).bit_length())


def block_root(leaves: list[str], height: int) -> str:
    for _ in range(height):
        leaves = [digest(*leaves[k : k + 2]) for k in range(0, len(leaves), 2)]
    return leaves[0]


def field(c: Column) -> Column:
    """A value told apart from all others: a dash for null, else its UTF-8 bytes, a colon and itself."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def placed(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, the place from 0 in their tree by `order`, and n, the rows of the tree."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for t in b.column("tree").to_pylist():
                last, seen = t, seen + 1 if t == last else 0
                places.append(seen)
            table = pa.Table.from_batches([b]).append_column("_p", pa.array([part] * len(b), pa.int32()))
            yield from table.append_column("_i", pa.array(places, pa.int64())).to_batches()

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = stage(spark, ordered.mapInArrow(number, f"{kinds}, _p int, _i long"), name)
    counts = ordered.groupBy("tree", "_p").agg(F.count("*").alias("c"))  # a row for a range and a tree in it
    w = Window.partitionBy("tree")
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("tree", "_p", (F.sum("c").over(before) - F.col("c")).alias("_base"), F.sum("c").over(w).alias("n"))
    return ordered.join(bases, ["tree", "_p"]).withColumn("pos", F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def climb(spark: SparkSession, nodes: DataFrame, block: int) -> list[DataFrame]:
    """The nodes (tree, pos, n, digest, ...) and their rounds of block roots; the last has a node for each tree."""

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        top = block_root(_column(table, "digest"), block_height(n, block))
        size = 1 << block
        row = {"tree": [table.column("tree")[0].as_py()], "pos": [table.column("pos")[0].as_py() >> block], "n": [-(-n // size)], "digest": [top]}
        return pa.table(row, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1 or len(rounds) == 1:
        grouped = rounds[-1].select("tree", "pos", "n", "digest").groupBy("tree", F.shiftright("pos", block).alias("_block"))
        rounds.append(stage(spark, grouped.applyInArrow(root, "tree string, pos long, n long, digest string"), "roots"))
    return rounds


def descend(nodes: DataFrame, upper: DataFrame, block: int, sub: int) -> DataFrame:
    """nodes with proof and what else `upper` (tree, pos, proof, ...: the roots of their blocks) has."""
    own = [c for c in nodes.columns]
    more = [c for c in upper.columns if c not in ("tree", "pos", "proof")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in [*nodes.dtypes, *[(c, t) for c, t in upper.dtypes if c in more], ("proof", "string")])

    def paths(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        height = block_height(left.column("n")[0].as_py(), block)
        above = _column(right, "proof")[0]
        proofs = [steps(p, i) + above for i, p in enumerate(traverse(_column(left, "digest"), height, sub))] if height else [above]
        out = left.select(own)
        for c in more:
            out = out.append_column(c, pa.array([right.column(c)[0].as_py()] * len(left), pa.string()))
        return out.append_column("proof", pa.array(proofs, pa.string()))

    below = nodes.withColumn("_block", F.shiftright("pos", block)).groupBy("tree", "_block")
    return below.cogroup(upper.withColumn("_block", F.col("pos")).groupBy("tree", "_block")).applyInArrow(paths, kinds)


def manifest(spark: SparkSession, leaves: DataFrame, tree: str, order: str, block: int = BLOCK, sub: int = SUB) -> DataFrame:
    """leaves (with a column `digest`) and their pos, subroot, root and proof; a tree for each value of a column.

    The roots of all trees and rounds are written; leaves are written once.
    """
    prepare(spark)
    named = F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))  # null first
    rounds = climb(spark, placed(spark, leaves.withColumn("tree", named), [order, "digest"], "leaves"), block)
    tops = rounds[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), "digest")
    upper_rounds = climb(spark, placed(spark, tops, ["name"], "subroots"), block)
    upper = upper_rounds[-1].select("tree", "pos", F.lit("").alias("proof"), F.col("digest").alias("root"))
    for nodes in reversed(upper_rounds[:-1]):
        upper = descend(nodes, upper.select("tree", "pos", "proof", "root"), block, sub)
    upper = upper.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(rounds[:-1]):
        upper = descend(nodes, upper.select("tree", "pos", "proof", "subroot", "root"), block, sub)
    return upper.drop("tree", "n")


def folded(rows: DataFrame, leaf_column: str, name: str) -> DataFrame:
    """rows with the root that a column's leaf and the row's proof give."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            found = [fold(x, p) for x, p in zip(_column(t, leaf_column), _column(t, "proof"))]
            yield from t.append_column(name, pa.array(found, pa.string())).to_batches()

    return rows.mapInArrow(add, ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{name}` string"]))


def tampered_manifest(spark: SparkSession, docs: DataFrame, block: int = BLOCK, sub: int = SUB) -> DataFrame:
    """Every document's leaf, roots and proof, and the root it folds to after one was added to n_chars of some.

    Those are the rows whose doc_id has a crc32 that 7 divides; a null doc_id is never among them, a null n_chars stays.
    """
    d = has(docs, "doc_id", "source", "lang", "n_chars", "text")
    fields = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = d.select("doc_id", "lang", fields(F.col("n_chars")).alias("digest"), F.when(hit, fields(F.col("n_chars") + 1)).alias("changed"))
    found = manifest(spark, rows, "lang", "doc_id", block, sub).withColumn("claimed", F.coalesce("changed", "digest"))
    found = folded(found.drop("changed", "lang", "pos"), "claimed", "folded_root")
    siblings = F.regexp_replace("proof", "[LR-]", "")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
