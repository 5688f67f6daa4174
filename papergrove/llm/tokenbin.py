"""Token-ID files: flat unsigned integers and 64-bit document offsets, in ascending doc_id order.

A corpus is a folder of shards in order. Shard k has `k.bin`, the ids of its documents one after another as
little-endian unsigned 16-bit integers (32-bit for vocabularies of over 65,536 ids), `k.idx`, the (documents + 1) signed 64-bit
offsets of its documents in ids, and `k.doc`, their doc_ids as signed 64-bit integers. A shard's base, the number of
ids before it in the corpus, is the prefix sum of the shards' lengths. Readers map the files into memory.

Rows are dealt by range of doc_id and, where many share one, of the text's hash,
so shards are ordered and no task sorts more than its range. An id that does not fit its width is an error. Only shard lengths
(one row a shard) reach the driver. A file is written under a name of its own and renamed, so a task that runs again
replaces a whole file by an equal one.

Null texts are empty and get just the end id; rows whose doc_id is null are written first, as doc_id -2**63; repeated
doc_ids are kept, ordered by the text's hash, then the text. An empty table gives no shard. Further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import file_system, has, prepare, stage, work_dir
from .tokenize import END_ID, memo, resolve

NULL_ID = -(1 << 63)
MANIFEST = "shard int, path string, docs long, tokens long, width int"


def narrowed(ids: bytes, width: int) -> bytes:
    """Ids of four bytes each in `width` bytes each; an id that does not fit is an error."""
    values = np.frombuffer(ids, "<u4")
    if len(values) and int(values.max()) >= 1 << 8 * width:
        raise ValueError(f"id {values.max()} does not fit in {width} bytes")
    return values.astype(f"<u{width}").tobytes()


def write_shard(folder: str, shard: int, rows: Iterator[tuple[int, bytes]], width: int) -> dict | None:
    """Writes the ids (`width` bytes each) of ordered documents; None for no rows."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    name, mine = f"{root}/{shard:06d}", f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
    offsets, docs, held, size = [0], [], [], 0
    with fs.open_output_stream(f"{mine}.bin") as out:
        for doc, ids in rows:
            docs.append(doc)
            offsets.append(offsets[-1] + len(ids) // width)
            held.append(ids)
            size += len(ids)
            if size >= 8 << 20:
                out.write(b"".join(held))
                held, size = [], 0
        out.write(b"".join(held))
    if not docs:
        fs.delete_file(f"{mine}.bin")
        return None
    for kind, values in (("idx", offsets), ("doc", docs)):
        with fs.open_output_stream(f"{mine}.{kind}") as out:
            out.write(np.array(values, "<i8").tobytes())
    for kind in ("idx", "doc", "bin"):
        fs.move(f"{mine}.{kind}", f"{name}.{kind}")
    return {"shard": shard, "path": f"{folder}/{shard:06d}", "docs": len(docs), "tokens": offsets[-1], "width": width}


def read_shard(path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and ids of a shard, mapped into memory where the file system is local."""
    from pyarrow import fs as pafs

    out = []
    for kind, dtype in (("doc", "<i8"), ("idx", "<i8"), ("bin", f"<u{width}")):
        fs, name = file_system(f"{path}.{kind}")
        if isinstance(fs, pafs.LocalFileSystem):
            empty = fs.get_file_info(name).size == 0
            out.append(np.zeros(0, dtype) if empty else np.memmap(name, dtype, "r"))
        else:
            with fs.open_input_file(name) as f:
                out.append(np.frombuffer(f.read(), dtype))
    return out[0], out[1], out[2]


def write_corpus(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = END_ID, width: int | None = None) -> DataFrame:
    """Encodes every whole text and writes the corpus; returns its manifest with each shard's base.

    The manifest has one row a shard: shard, path, docs, tokens, width and base, the ids before the shard. The width is
    that of the vocabulary unless given.
    """
    prepare(spark)
    width = width or (2 if max(memo(resolve(vocabulary)).most_id, end) < 1 << 16 else 4)
    folder = folder or work_dir(spark, "tokens")

    order = ("doc_id", F.xxhash64("text"))
    rows = has(docs, "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = memo(resolve(vocabulary))

        def each() -> Iterator[tuple[int, bytes]]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield NULL_ID if doc is None else doc, narrowed(tokens.ids(text, end), width)

        row = write_shard(folder, TaskContext.get().partitionId(), each(), width)
        if row:
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]))

    shards = sorted(rows.mapInArrow(write, MANIFEST).collect(), key=lambda r: r["shard"])
    base, out = 0, []
    for r in shards:
        out.append((*r, base))
        base += r["tokens"]
    return spark.createDataFrame(out, MANIFEST + ", base long")


def read_corpus(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document's (doc_id, start, n_tokens, ids_crc32) from the files of a manifest, a shard a task."""
    n = max(1, manifest.count())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                docs, at, ids = read_shard(r.path, r.width)
                for k in range(0, len(docs), 20_000):
                    to = min(len(docs), k + 20_000)
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4")) for i in range(k, to)]
                    yield pd.DataFrame({"doc_id": docs[k:to].astype("int64"), "start": at[k:to] + r.base, "n_tokens": at[k + 1 : to + 1] - at[k:to], "ids_crc32": np.array(crc, np.int64)})

    spread = manifest.repartitionByRange(n, "shard")
    out = spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def corpus_table(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes a corpus and reads its document table back."""
    manifest = write_corpus(spark, docs, vocabulary)
    return read_corpus(spark, manifest)
