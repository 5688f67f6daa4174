"""Vector best-fit packing of token pieces into sequences.

A document longer than a sequence is cut into full pieces and a rest. Pieces are packed in decreasing length; each
goes to the open sequence that fits it under all three residual capacities (tokens, documents, attention cost, which
is the sum of squared lengths) and scores best: by `norm`, the least weighted squared norm of what stays free, or by
`dot`, the greatest weighted dot product of the piece's demand and the free capacities. Where none fits, a sequence
is opened. The capacities of documents and attention default to values that tokens alone imply.

A full piece is a sequence of its own. The others are packed in groups of about `group` pieces dealt by hash, which
bounds a task's memory and keeps results the same when a task runs again; a group leaves on average less than one
sequence partly filled. No piece is dropped.

Null texts are empty documents of one end id; repeated rows are packed each; very long texts are cut into
full pieces and a rest, none lost; an empty table gives no rows; null
doc_ids are packed like others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import has, prepare, stage
from .tokenize import END_ID, memo, resolve

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, tokens: int, most_docs: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; lengths must be in decreasing order and none over the capacities.

    A bin's state is its free tokens, documents and attention cost, as shares of the capacities when it is scored.
    """
    most_docs = most_docs or tokens
    attention = attention or tokens * tokens
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > attention):
        raise ValueError("a piece is larger than a sequence")
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    room = np.empty((3, 1024))
    caps = np.array([tokens, most_docs, attention], float)
    scale = np.array(weights) / (caps * caps)
    where, names, n_open, made = np.empty(len(lengths), np.int64), np.empty(1024, np.int64), 0, 0
    offset = np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        best = -1
        if n_open:
            t, d, a = room[0, :n_open], room[1, :n_open], room[2, :n_open]
            fits = np.flatnonzero((t >= size) & (d >= 1) & (a >= size * size))
            if len(fits):
                if rule == "norm":
                    score = scale[0] * (t[fits] - size) ** 2 + scale[1] * (d[fits] - 1) ** 2 + scale[2] * (a[fits] - size * size) ** 2
                else:
                    score = -(scale[0] * t[fits] * size + scale[1] * d[fits] + scale[2] * a[fits] * (size * size))
                best = fits[int(np.argmin(score))]
        if best < 0:
            if n_open == room.shape[1]:
                room, names = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([names, np.empty_like(names)])
            best, room[:, n_open], names[n_open] = n_open, caps, made
            n_open, made = n_open + 1, made + 1
        where[i], offset[i] = names[best], tokens - int(room[0, best])
        room[:, best] -= (size, 1, size * size)
        if room[0, best] < 1 or room[1, best] < 1 or room[2, best] < 1:  # full: the last open bin takes its place
            n_open -= 1
            room[:, best], names[best] = room[:, n_open], names[n_open]
    return where, offset


def cut_pieces(spark: SparkSession, docs: DataFrame, vocabulary: str, tokens: int, end: int = END_ID) -> DataFrame:
    """The pieces of every whole document: doc_id, piece, start, length and the crc32 of its ids."""
    prepare(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(resolve(vocabulary))
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = memoryview(known.ids(text, end))
                for k in range(0, len(ids), 4 * tokens):
                    part = ids[k : k + 4 * tokens]
                    rows.append((doc, k // (4 * tokens), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return has(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def pack(spark: SparkSession, pieces: DataFrame, tokens: int, most_docs: int | None = None, attention: int | None = None, rule: str = "norm", group: int = 4096) -> DataFrame:
    """Pieces with the sequence and the offset they get. `pieces` is read twice: pass a written table."""
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_group")]
    alone = F.col("length") == tokens if attention is None or attention >= tokens * tokens else F.lit(False)
    short = pieces.where(~alone).select(*columns)
    n = max(1, math.ceil(short.count() / group))
    # ids are below 0 for full pieces, and hold the group for the others; equal rows are told apart by their place
    full = pieces.where(alone).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(n))  # spreads rows that are equal in all columns
    keyed = short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32") + salt, F.lit(n)))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, offset = best_fit(frame["length"].to_numpy(), tokens, most_docs, attention, rule)
        return frame.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c in columns)
    return keyed.groupBy("_group").applyInPandas(fill, f"{kinds}, sequence_id long, offset long").unionByName(full)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, tokens: int = 4096, **limits) -> DataFrame:
    """Every piece of every document with its place: tokenises once, writes the small piece table, packs it."""
    pieces = stage(spark, cut_pieces(spark, docs, vocabulary, tokens), "pieces")
    return pack(spark, pieces, tokens, **limits)
