"""Exact dedup by Patricia tries: equal texts share a terminal node, which holds the row that owns them.

Where texts are read, each task inserts them as whole byte strings into a compressed radix trie. Its terminal nodes
count rows and store the owner: the row of the smallest doc_id (or of the largest, by `keep`), of equal doc_ids the one
read first; a null doc_id owns only where all are null. A trie over its memory spills its heaviest subtree: the terminal
nodes below it go out as partial groups, as all do at the end. So a text that fills a third of a table leaves a task
once, not once a row. Partial groups are shuffled by length and content hash; each such partition is a trie of its own
again, which compares whole byte strings, so that two texts of one hash stay apart. A row finds its group by the number
of its task's partial group, never by a hash, and no key of that join is larger than a task.

Null texts are empty texts; very long ones are one string like others; repeated rows are counted each and one of them
stays; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import has, prepare, stage

#: Bytes of labels and nodes a task's trie holds before a subtree is spilled; a node counts as so many.
MEMORY, NODE = 64 << 20, 400
#: Rows of an output batch, and bytes of bodies in it.
ROWS, BYTES = 4096, 8 << 20
#: Rows are addressed by partition and place: places take so many bits.
PLACE = 40

Owner = tuple[int, int, int | None]  # rank of the doc_id (the least owns), place of the row, doc_id


class Node:
    __slots__ = ("label", "kids", "owner", "count", "name")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count, self.name = label, {}, None, 0, -1


def common(a: bytes, key: bytes, at: int) -> int:
    """How many bytes of a stand in key from at on; halves are compared, so long labels cost little."""
    if key.startswith(a, at):
        return len(a)
    low, high = 0, min(len(a), len(key) - at) + 1  # a[:low] stands there, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if key.startswith(a[low:mid], at + low) else (low, mid)
    return low


class Trie:
    """A compressed radix trie over bytes. A node with an owner is terminal: its path is a text."""

    def __init__(self) -> None:
        self.root, self.size, self.weight = Node(b""), 0, {}

    def insert(self, key: bytes) -> Node:
        """The node at which key ends, made where there is none."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self._grow(key, len(kid.label) + NODE)
                return kid
            same = common(kid.label, key, at)
            if same < len(kid.label):
                mid = Node(kid.label[:same])
                mid.kids[kid.label[same]] = kid
                kid.label = kid.label[same:]
                node.kids[key[at]] = kid = mid
                self._grow(key, NODE)
            node, at = kid, at + same
        return node

    def _grow(self, key: bytes, by: int) -> None:
        self.size += by
        self.weight[key[0]] = self.weight.get(key[0], 0) + by

    def terminals(self, first: Node | None = None) -> Iterator[tuple[bytes, Node]]:
        """The texts of the subtree below the root's child `first` (all: None), with their nodes."""
        todo = [(b"", self.root if first is None else first)]
        while todo:
            before, node = todo.pop()
            text = before + node.label  # joined when it is its turn: siblings share what is before them
            if node.owner is not None:
                yield text, node
            todo.extend((text, kid) for kid in node.kids.values())

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Takes the root's heaviest subtree out and gives its texts."""
        byte = max(self.weight, key=self.weight.__getitem__)
        self.size -= self.weight.pop(byte)
        return self.terminals(self.root.kids.pop(byte))


def merge(node: Node, owner: Owner, count: int) -> None:
    node.owner = owner if node.owner is None else min(node.owner, owner)
    node.count += count


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


GROUPS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("name", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("body", pa.binary()), ("rank", pa.int64()), ("count", pa.int64())])
OWNERS = pa.schema([("name", pa.int64()), ("keep_id", pa.int64()), ("keep_place", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, body: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[body] or b"") if body is not None else 0
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _local(keep: str, memory: int, digest: Callable[[bytes], str]) -> Callable:
    """Rows of a task to (doc_id, place, name) each, and its partial groups with bodies."""
    sign = 1 if keep == "smallest" else -1

    def group(text: bytes, node: Node) -> tuple:
        return node.owner[2], node.owner[1], node.name, len(text), digest(text), text, node.owner[0], node.count

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        base = TaskContext.get().partitionId() << PLACE
        trie, place, names = Trie(), base, base
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                node = trie.insert(text or b"")
                if node.owner is None:
                    node.name, names = names, names + 1
                merge(node, (rank(doc, sign), place, doc), 1)
                yield doc, place, node.name, None, None, None, None, None
                place += 1
                if trie.size > memory:
                    yield from (group(*t) for t in trie.spill())
        yield from (group(*t) for t in trie.terminals())

    return lambda batches: _batches(rows(batches), GROUPS, 5)


def rank(doc: int | None, sign: int) -> int:
    """The order of owners: ascending or descending doc_id, null last."""
    return (1 << 63) - 1 if doc is None else min(doc * sign, (1 << 63) - 1)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial groups in the order of length and hash to (name, keep_id, keep_place, group_size, text_sha256)."""

    def rows() -> Iterator[tuple]:
        at, trie, held = None, Trie(), []
        for b in batches:
            for doc, place, name, size, digest, body, order, count in zip(*(c.to_pylist() for c in b.columns)):
                if (size, digest) != at:
                    yield from close(held)
                    at, trie, held = (size, digest), Trie(), []
                node = trie.insert(body)
                merge(node, (order, place, doc), count)
                held.append((name, sha256(body), node))
        yield from close(held)

    def close(held: list) -> Iterator[tuple]:
        for name, sha, node in held:
            yield name, node.owner[2], node.owner[1], node.count, sha

    return _batches(rows(), OWNERS)


def exact_dedup(spark: SparkSession, docs: DataFrame, keep: str = "smallest", memory: int = MEMORY, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256 (of the text's UTF-8).

    `keep` is smallest or largest; exactly one row of each group of equal texts is kept.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    prepare(spark)
    kinds = "doc_id long, place long, name long, n_bytes long, digest string, body binary, rank long, count long"
    rows = has(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    read = stage(spark, rows.mapInArrow(_local(keep, memory, digest), kinds), "tries")
    groups = read.where(F.col("digest").isNotNull()).repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    owners = groups.mapInArrow(_tries, "name long, keep_id long, keep_place long, group_size long, text_sha256 string")
    members = read.where(F.col("digest").isNull()).select("doc_id", "place", "name")
    return members.join(owners, "name").select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256")
