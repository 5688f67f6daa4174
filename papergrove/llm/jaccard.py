"""Exact n-gram Jaccard join with set-relation skipping, and the components of its links.

A document's set is its distinct word shingles. The join runs over distinct sets:

1. One scan gives each document's set size, 64-bit set key and 128 parity bits (bit i: whether an odd number of its
   shingles fall to i); documents with equal keys are one set in all that follows. The same scan counts all shingles
   of all documents in a sketch of WIDTH counters, summed over all tasks, so what is frequent counts as frequent at any
   input size: a counter is never too low, and too high by the shingles that share it, total / WIDTH on average.
2. A second scan gives each set's prefix in the order (frequency by the sketch, hash), rare first: two sets with
   Jaccard of at least t share a shingle among the first n - ceil(t n) + 1 of each. Any order is right; this one keeps
   lists short. Lists whose count is far over the median counter are dealt by hash to cells of about CELL entries.
3. Inverted lists are sorted by (set size, position) and walked in blocks of equal size: for two blocks the overlap
   that t needs bounds the positions, so the rest of a block is skipped (index-level skipping). Parity bits that differ
   bound the sets' difference from below, so pairs that cannot link are not written.
   The first walk, inside cells, gives each set's nearest earlier one over all its lists (earlier: by size, then key),
   and the entries that have any partner left. One pair a set is checked. The next walks take these entries with the
   component of their set: lists of one component are done. In the others each set asks for one set of another component
   (the nearest, then others near by), and these walks go on while many of such pairs are links, so that a large group of near copies
   becomes one component by a row a set and walk, not a row a pair. The last walk checks every pair of components that
   still differ. All links between components are seen; those inside one change nothing. These walks split a long list into
   its most frequent component and the rest, and walks parts of the one against parts of the other, and of the rest
   against itself. Their pairs must also pass by longer parity bits, as many as shingles, before texts are fetched.
4. A pair is checked in a group: those of one a set by the set asked for (in parts of FAMILY sets at most), the last
   walk's by blocks of 32 by 32 list entries, at the least shared list. There every set is held as its difference from the
   group's first set, and an overlap is derived from the two differences alone; pairs that links found in the group
   already connect are not checked (answer-level skipping).
5. Links join sets to components by contraction to the least neighbour, each round a written table.

No list, link or set is gathered on the driver, which gets counts and the sketch (WIDTH numbers).
Words are cut after lower-casing A to Z; shingles and sets are compared as 64-bit hash values.

Null and empty texts have the empty set, linked with nothing (component_id is the document's own doc_id). Rows with a
null doc_id take part like all others; component_id is the least doc_id that is not null. Repeated rows are kept, and
rows that share a doc_id but not the text are documents of their own. A very long text is one set like others, whole; an
empty table gives no rows. What is written on the way is deleted when it has been read, but for the tables that the
result itself is read from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import drop, free_shuffles, has, prepare, small_or_not, stage
from .words import mix, shingles, slices

#: Counters of the sketch (a power of two) and of a piece of it, shingles counted at a time, list entries of a block.
WIDTH, PIECE, CHUNK, BLOCK = 1 << 21, 1 << 15, 1 << 21, 32
#: Entries of a list that is walked along with others at once, at most (speed alone); entries of a cell, about; sets of
#: a group that the first walk's pairs are checked in, at most.
SHORT, CELL, FAMILY = 16, 1024, 256
#: Rows read at once by the two walks (their runs hold whole lists); entries of a part of a very long list, at most.
ROWS, CROSS_ROWS, PART = 1 << 18, 1 << 16, 1 << 19
#: Pairs that the last walk holds before they are written; links of a walk of one pair a set, at least, for another one.
PAIRS, LEAST_LINKS = 1 << 20, 64

SCAN = "doc_id long, t long, n int, k long, bits binary, piece int, counts binary"


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text."""
    for part in slices(column):
        h, at = part.hashes(lower=True), part.bounds()
        for k in range(part.n_docs):
            yield part.first + k, np.unique(shingles(h[at[k] : at[k + 1]], size))


def set_key(values: np.ndarray) -> int:
    """64 bits of a set of 64-bit values, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix(values + np.uint64(0x1234567)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(values))]))[0]) - (1 << 63)


def parity(values: np.ndarray) -> np.ndarray:
    """128 bits as two integers: bit i tells whether an odd number of values fall to i.

    The bits that differ between two sets are no more than the values that do.
    """
    odd = np.bincount((values >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def long_parity(values: np.ndarray) -> bytes:
    """The same by the values' low bits, with a power of two of bits, no fewer than values."""
    size = max(64, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def long_differing(a: bytes, b: bytes) -> int:
    """Bits that differ between two long parities, the longer one folded to the length of the other."""
    x, y = sorted((np.frombuffer(v, "<u8") for v in (a, b)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def needed_overlap(a, b, num: int, den: int):
    """The least overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-num * (a + b) // (den + num))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _packed(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    return zlib.compress(counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u8").tobytes(), 1)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.uint64)


class Recent:
    """The keys met last, some at most: what repeats close by is found here."""

    def __init__(self) -> None:
        self.held: set[int] = set()

    def new(self, key: int) -> bool:
        if key in self.held:
            return False
        if len(self.held) > 1 << 18:
            self.held.clear()
        self.held.add(key)
        return True


def _scan(size: int):
    width, piece = WIDTH, min(PIECE, WIDTH)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        counts, held, recent = np.zeros(width, np.uint64), 0, Recent()
        names = ["doc_id", "t", "n", "k", "bits", "piece", "counts"]
        for b in batches:
            n, key = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
            bits: list[bytes | None] = [None] * len(b)
            for row, values in text_sets(b.column(1), size):
                n[row], key[row], bits[row] = len(values), set_key(values), long_parity(values) if len(values) else None
                if len(values) and recent.new(int(key[row])):  # copies close by count once
                    pending.append((values & np.uint64(width - 1)).astype(np.int64))
                    held += len(values)
                    if held >= CHUNK:
                        counts += np.bincount(np.concatenate(pending), minlength=width).astype(np.uint64)
                        pending, held = [], 0
            none = pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(key), pa.array(bits, pa.binary()), *none], names)
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=width).astype(np.uint64)
        if counts.any():
            m = width // piece
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(m), pa.int32()), pa.array([_packed(counts[k * piece : (k + 1) * piece]) for k in range(m)], pa.binary())], names)

    return scan


def _summed(size: int):
    """The sums of the pieces (piece, counts) of a partition; a piece has `size` counters."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1)):
                counts = _unpacked(packed.as_py(), size)
                total[k] = total[k] + counts if k in total else counts
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(v) for v in total.values()], pa.binary())], ["piece", "counts"])

    return summed


def sketch(scan: DataFrame) -> np.ndarray:
    """The counters, summed over all tasks in two steps so that no task reads the pieces of many."""
    kind, size = "piece int, counts binary", min(PIECE, WIDTH)
    pieces = scan.where("piece IS NOT NULL").select("piece", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("part"))
    some = pieces.repartition("piece", "part").select("piece", "counts").mapInArrow(_summed(size), kind)
    out = np.zeros(WIDTH, np.uint64)
    for r in some.repartition("piece").mapInArrow(_summed(size), kind).toLocalIterator():
        out[r["piece"] * size :][:size] = _unpacked(bytes(r["counts"]), size)
    return out


def ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each counter a rank (eighths of the logarithm to base 2) and the cells that its lists are dealt to."""
    usual = float(np.median(counts))
    parts = np.ceil(np.maximum(counts - 2 * usual, 1) / CELL)
    return np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8), np.minimum(parts, 1 << 30).astype(np.int32)


def _prefixes(size: int, num: int, den: int, held):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, parts = held.value
        low, recent = np.uint64(len(rank) - 1), Recent()
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for _, values in text_sets(b.column(0), size):
                n = len(values)
                if den * n < num * (n + 1) or not recent.new(key := set_key(values)):  # too small for any link but to an equal set
                    continue
                m = prefix_length(n, num, den)
                at = (values & low).astype(np.int64)
                order = np.lexsort((values, rank[at]))[:m]
                first, split = values[order], parts[at[order]]
                with np.errstate(over="ignore"):
                    dealt = mix(first + np.uint64(key % (1 << 64))) % split.astype(np.uint64)
                cell = np.where(split > 1, dealt.astype(np.int32) + 1, 0).astype(np.int32)  # 0: the list is whole
                bits = parity(values)
                for into, x in zip(out, (first.view(np.int64), cell, (n << 32) + np.arange(m, dtype=np.int64), np.full(m, key), np.full(m, bits[0]), np.full(m, bits[1]))):
                    into.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "cell", "at", "k", "p1", "p2"])

    return prefixes


def differing(bits: tuple[np.ndarray, np.ndarray], i, j) -> np.ndarray:
    p, q = (x.view(np.uint64) for x in bits)  # of signed values numpy counts the bits of the amount
    return (np.bitwise_count(p[i] ^ p[j]) + np.bitwise_count(q[i] ^ q[j])).astype(np.int32)


def blocks_that_fit(n: np.ndarray, pos: np.ndarray, num: int, den: int, bits: tuple[np.ndarray, np.ndarray], side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Index ranges i and j of one cell of an inverted list with (i by j) their differing parity bits and whether they fit.

    Entries are sorted by (side, n, pos) and walked in blocks of equal side and n; with two sides, only across them.
    The last value tells that i and j are of one block.
    """
    if not len(n):
        return
    side = np.zeros(len(n), np.int64) if side is None else side
    edge = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (side[1:] != side[:-1])))
    sizes, ends, sides = n[edge], np.append(edge[1:], len(n)), side[edge]
    cut = int(np.searchsorted(sides, sides[0], "right"))  # blocks of the first side
    for a in range(cut):
        na = int(sizes[a])
        if cut == len(edge):
            others = range(a, int(np.searchsorted(sizes, den * na // num, "right")))
        else:
            others = range(cut + int(np.searchsorted(sizes[cut:], -(-num * na // den))), cut + int(np.searchsorted(sizes[cut:], den * na // num, "right")))
        for b in others:
            nb = int(sizes[b])
            need = needed_overlap(na, nb, num, den)
            # positions of each block grow: what needs more than the rest of a set holds is skipped as a whole
            la = int(np.searchsorted(pos[edge[a] : ends[a]], na - need, "right"))
            lb = int(np.searchsorted(pos[edge[b] : ends[b]], nb - need, "right"))
            if not (la and lb):
                continue
            most = na + nb - 2 * need  # shingles that the two sets may differ by
            step = max(1, (1 << 20) // lb)
            for at in range(0, la, step):
                i, j = np.arange(edge[a] + at, edge[a] + min(la, at + step)), np.arange(edge[b], edge[b] + lb)
                d = differing(bits, i[:, None], j[None, :])
                yield i, j, d, d <= most, a == b


def nearest(n: np.ndarray, pos: np.ndarray, key: np.ndarray, num: int, den: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of a cell the nearest earlier one by differing bits (-1: none), those bits, and whether any fits."""
    least, partner, some = np.full(len(n), 1 << 20, np.int32), np.full(len(n), -1), np.zeros(len(n), bool)
    for i, j, d, fits, same in blocks_that_fit(n, pos, num, den, bits):
        if same:  # earlier entries alone
            fits &= key[i][:, None] < key[j][None, :]
        some[i] |= fits.any(axis=1)
        some[j] |= fits.any(axis=0)
        d[~fits] = 1 << 20
        row = d.argmin(axis=0)
        value = d[row, np.arange(len(j))]
        better = value < least[j]
        least[j[better]], partner[j[better]] = value[better], i[row[better]]
    return partner, least, some


def crossing(n: np.ndarray, pos: np.ndarray, num: int, den: int, bits: tuple[np.ndarray, np.ndarray], roots: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidate pairs (as indices) of different roots in a cell, across sides only where there are two."""
    for i, j, _, fits, same in blocks_that_fit(n, pos, num, den, bits, side):
        x, y = np.nonzero(fits & (roots[i][:, None] != roots[j][None, :]))
        x, y = i[x], j[y]
        keep = x < y if same else slice(None)
        yield x[keep], y[keep]


def other_root(n: np.ndarray, pos: np.ndarray, key: np.ndarray, num: int, den: int, bits: tuple[np.ndarray, np.ndarray], roots: np.ndarray, side: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a cell one candidate of a different root (-1: none), and its value, the least of those it has.

    In turn 0 that is the nearest by differing bits; in later ones each set seems farther by a number of its own below 8,
    another in each turn, so that an entry whose nearest was a false candidate asks for others.
    """
    last = np.iinfo(np.int64).max
    least, partner = np.full(len(n), last), np.full(len(n), -1)
    with np.errstate(over="ignore"):
        order = (mix(key.view(np.uint64) + np.uint64(turn)) >> np.uint64(24)).astype(np.int64)  # 40 bits
    for i, j, d, fits, same in blocks_that_fit(n, pos, num, den, bits, side):
        x, y = np.nonzero(fits & (roots[i][:, None] != roots[j][None, :]))
        far = d[x, y].astype(np.int64)
        for own, other in ((i[x], j[y]), (j[y], i[x])):
            value = (far + (order[other] & 7 if turn else 0) << 40) + order[other]
            falling = np.argsort(-value, kind="stable")  # of what is set more than once the last stays
            found, to = np.full(len(n), last), np.full(len(n), -1)
            found[own[falling]], to[own[falling]] = value[falling], other[falling]
            better = found < least
            least[better], partner[better] = found[better], to[better]
    return partner, least


def _whole_lists(batches: Iterator[pa.RecordBatch], keys: int, rows: int, split: bool = True) -> Iterator[pa.Table]:
    """Rows sorted by their first `keys` columns, in runs of about `rows` that hold whole lists.

    A list of more rows is split, or held whole however long it is.
    """
    held: list[pa.RecordBatch] = []
    n, least = 0, rows
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= least:
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(n, bool)
            for k in range(keys):
                column = whole.column(k).to_numpy()
                last &= column == column[-1]
            cut = n - int(last.sum())  # the last list may go on
            if cut:
                yield whole.slice(0, cut)
                held, n, least = whole.slice(cut).combine_chunks().to_batches(), n - cut, rows
            elif split:
                yield whole
                held, n = [], 0
            else:
                held, least = whole.to_batches(), 2 * n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(num: int, den: int):
    """Nearest earlier sets (x, y, d) over the lists of a task, and the entries that have a partner left (y null)."""
    names = ["x", "y", "d", "token", "n", "pos", "p1", "p2"]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going = None  # a list that was split, so that its parts did not all meet
        for whole in _whole_lists(batches, 2, ROWS):
            token, cell, at, key, p1, p2 = (whole.column(k).to_numpy() for k in range(6))
            last, rows = (token[-1], cell[-1]), len(token)
            new = np.ones(rows, bool)
            new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]) | (at[1:] != at[:-1]) | (key[1:] != key[:-1])
            token, cell, at, key, p1, p2 = (x[new] for x in (token, cell, at, key, p1, p2))
            n, pos, bits = at >> 32, at & 0xFFFFFFFF, (p1, p2)
            head = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
            length = np.diff(np.append(head, len(token)))
            start, sizes = np.repeat(head, length), np.repeat(length, length)
            some, least, partner = cell > 0, np.full(len(token), 1 << 20, np.int32), np.full(len(token), -1)
            if going is not None:
                some |= (token == going[0]) & (cell == going[1])
            going = last if rows >= ROWS and len(head) == 1 else going if going == last else None
            if going is not None:
                some |= (token == last[0]) & (cell == last[1])
            # what no partner can reach at its position is of no use
            some &= n - pos >= needed_overlap(n, -(-num * n // den), num, den)

            active, d = np.flatnonzero((sizes > 1) & (sizes <= SHORT)), 1
            while len(active):  # short lists, all at once: each entry and the d-th after it
                active = active[active + d < len(token)]
                other = active + d
                near = (start[other] == start[active]) & (den * n[active] >= num * n[other])
                active, other = active[near], other[near]
                need = needed_overlap(n[active], n[other], num, den)
                bit = differing(bits, active, other)
                fits = (n[active] - pos[active] >= need) & (n[other] - pos[other] >= need) & (bit <= n[active] + n[other] - 2 * need)
                i, j, bit = active[fits], other[fits], bit[fits]
                some[i] = some[j] = True
                after = (n[i] < n[j]) | (key[i] < key[j])
                for x, y, v in ((j[after], i[after], bit[after]), (i[~after], j[~after], bit[~after])):
                    better = (v < least[x]) | (v == least[x]) & (key[y] < key[partner[x]])
                    least[x[better]], partner[x[better]] = v[better], y[better]
                d += 1
            for h, m in zip(head[length > SHORT].tolist(), length[length > SHORT].tolist()):
                own = slice(h, h + m)
                to, v, has_one = nearest(n[own], pos[own], key[own], num, den, (p1[own], p2[own]))
                some[own] |= has_one
                least[own], partner[own] = v, np.where(to >= 0, to + h, -1)

            x = np.flatnonzero(partner >= 0)
            order = x[np.lexsort((key[partner[x]], least[x], key[x]))]
            first = order[np.append(True, key[order][1:] != key[order][:-1])] if len(order) else order
            for k in range(0, len(first), 1 << 16):
                f = first[k : k + (1 << 16)]
                none = [pa.nulls(len(f), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(key[f]), pa.array(key[partner[f]]), pa.array(least[f]), *none], names)
            x = np.flatnonzero(some)
            for k in range(0, len(x), 1 << 16):
                f = x[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(key[f]), pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.int32()), pa.array(token[f]), pa.array(n[f].astype(np.int32)), pa.array(pos[f].astype(np.int32)), pa.array(p1[f]), pa.array(p2[f])], names)

    return lists


CELLS = ["token", "cell", "side", "n", "pos", "k", "p1", "p2", "root"]
PAIR = "h1 long, h2 long, h3 int, a long, b long"


def _long_lists(num: int, den: int):
    """Pairs of different roots of cells (CELLS, in this order) with the blocks they are found in. No cell is cut."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_lists(batches, 2, CROSS_ROWS, split=False):
            token, cell, side, n, pos, key, p1, p2, root = (whole.column(k).to_numpy() for k in range(len(CELLS)))
            n = n.astype(np.int64)
            head = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
            length = np.diff(np.append(head, len(token)))
            place = (cell << 20) + (np.arange(len(token)) - np.repeat(head, length)) // BLOCK
            left, right, held = [], [], 0

            def pairs() -> Iterator[pa.RecordBatch]:
                i, j = np.concatenate(left), np.concatenate(right)
                swap = key[i] > key[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                order = np.lexsort((token[a], key[b], key[a]))
                a, b = a[order], b[order]
                new = np.ones(len(a), bool)
                new[1:] = (key[a][1:] != key[a][:-1]) | (key[b][1:] != key[b][:-1])
                a, b = a[new], b[new]
                for k in range(0, len(a), 1 << 16):
                    x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (token[x], place[x], (place[y] & 0xFFFFF).astype(np.int32), key[x], key[y])], ["h1", "h2", "h3", "a", "b"])

            for h, m in zip(head.tolist(), length.tolist()):
                own = slice(h, h + m)
                for i, j in crossing(n[own], pos[own], num, den, (p1[own], p2[own]), root[own], side[own]):
                    left.append(i + h)
                    right.append(j + h)
                    held += len(i)
                    if held >= PAIRS:
                        yield from pairs()
                        left, right, held = [], [], 0
            if held:
                yield from pairs()

    return lists


def _one_each(num: int, den: int, turn: int):
    """For each set of the cells (CELLS, in this order) of a run one of another root (x, y), with other_root()'s value."""

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_lists(batches, 2, CROSS_ROWS, split=False):
            token, cell, side, n, pos, key, p1, p2, root = (whole.column(k).to_numpy() for k in range(len(CELLS)))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            head = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
            least, partner = np.zeros(len(n), np.int64), np.full(len(n), -1)
            for h, m in zip(head.tolist(), np.diff(np.append(head, len(token))).tolist()):
                own = slice(h, h + m)
                to, least[own] = other_root(n[own], pos[own], key[own], num, den, (p1[own], p2[own]), root[own], side[own], turn)
                partner[own] = np.where(to >= 0, to + h, -1)
            x = np.flatnonzero(partner >= 0)
            order = x[np.lexsort((key[partner[x]], least[x], key[x]))]
            first = order[np.append(True, key[order][1:] != key[order][:-1])] if len(order) else order
            for k in range(0, len(first), 1 << 16):
                f = first[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(key[f]), pa.array(key[partner[f]]), pa.array(least[f])], ["x", "y", "d"])

    return one_each


def _crossed(spark: SparkSession, rows: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Entries (token, k, n, pos, p1, p2, root) dealt to cells so that all pairs of different roots of a list meet.

    Lists of one root are left out. top is a list's most frequent root; entries of it (side 0) only meet the others
    (side 1). Cells of even number hold these two; cells of odd number hold one or two parts of the others. Lists within
    CELL are one cell. The parts of a longer list of m entries have m ** (2 / 3) entries, CELL at least and PART at most,
    so that an entry is copied m ** (1 / 3) times or m / PART times, and a cell, which a task holds whole, has about
    2 * PART rows at most.
    """
    lists = rows.groupBy("token", "root").count().groupBy(F.col("token").alias("t")).agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("total"))
    lists = lists.withColumn("rest", F.col("total") - F.col("most.count")).where("rest > 0").withColumn("part", F.greatest(F.lit(CELL), F.least(F.lit(PART), F.ceil(F.pow("total", F.lit(2 / 3))))))
    lists = stage(spark, lists.select("t", F.col("most.root").alias("top"), "total", F.ceil(F.col("most.count") / F.col("part")).alias("tops"), F.ceil(F.col("rest") / F.col("part")).alias("rests")), "crossed")
    if held is not None:
        held.append(lists)  # for the caller to drop
    dealt = rows.join(small_or_not(lists, lists.count()), rows["token"] == lists["t"])
    h, is_top, whole = F.xxhash64("token", "k"), F.col("root") == F.col("top"), F.col("total") <= CELL
    dealt = dealt.withColumn("own", F.when(whole, F.lit(0)).when(is_top, F.pmod(h, "tops")).otherwise(F.pmod(h, "rests")).cast("long"))

    def upto(n: str):
        return F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)

    def cell(number, side):
        return F.struct(number.cast("long").alias("cell"), side.cast("int").alias("side"))

    own, tops, rests = F.col("own"), F.col("tops"), F.col("rests")
    of_top = F.transform(upto("rests"), lambda u: cell(2 * (own * rests + u), F.lit(0)))
    with_top = F.transform(upto("tops"), lambda c: cell(2 * (c * rests + own), F.lit(1)))
    with_rest = F.transform(upto("rests"), lambda v: cell(2 * (F.least(own, v) * rests + F.greatest(own, v)) + 1, (own > v)))
    to = F.when(whole, F.array(cell(F.lit(0), F.lit(0)))).when(is_top, of_top).otherwise(F.concat(with_top, with_rest))
    return dealt.withColumn("to", F.explode(to)).select("token", "k", "n", "pos", "p1", "p2", "root", "to.cell", "to.side").select(*CELLS)


class Block:
    """Sets of one group, each as its difference from the first: what it adds and what it lacks."""

    def __init__(self) -> None:
        self.sets: dict[int, int] = {}
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.up: dict[int, int] = {}
        self.leader: np.ndarray | None = None

    def add(self, key: int, values: np.ndarray) -> None:
        if self.leader is None:
            self.leader = values
        if key not in self.sets:
            self.sets[key] = len(values)
            self.parts[key] = np.setdiff1d(values, self.leader, True), np.setdiff1d(self.leader, values, True)

    def overlap(self, a: int, b: int) -> int:
        (more_a, less_a), (more_b, less_b) = self.parts[a], self.parts[b]
        both_lack = len(np.intersect1d(less_a, less_b, True))
        return len(self.leader) - (len(less_a) + len(less_b) - both_lack) + len(np.intersect1d(more_a, more_b, True))

    def root(self, key: int) -> int:
        while (up := self.up.get(key, key)) != key:
            self.up[key] = self.up.get(up, up)
            key = up
        return key

    def link(self, a: int, b: int, num: int, den: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        both = self.overlap(a, b)
        if den * both < num * (self.sets[a] + self.sets[b] - both):
            return False
        self.up[max(ra, rb)] = min(ra, rb)
        return True


def _verify(size: int, num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, block = None, Block()
        for batch in batches:
            place = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            kind, a, b = (batch.column(k).to_pylist() for k in (3, 4, 5))
            sets, found = dict(text_sets(batch.column(6), size)), []
            for r in range(len(batch)):
                if place[r] != home:
                    home, block = place[r], Block()
                if kind[r] < 2:
                    block.add(set_key(sets[r]), sets[r])
                elif block.link(a[r], b[r], num, den):
                    found.append((a[r], b[r]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return verify


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, root) for every end of the links (a, b): root is the least id of its component.

    Each round every vertex goes to its least neighbour (or stays), links follow, and loops go; rounds are about the
    logarithm of the longest path.
    """
    edges = stage(spark, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = stage(spark, edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage(spark, both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).where("to <> a").withColumnRenamed("a", "from"), "step")
        was = roots, edges, step
        roots = stage(spark, roots.join(step, roots["root"] == step["from"], "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        s1, s2 = step.toDF("f1", "t1"), step.toDF("f2", "t2")
        moved = edges.join(s1, edges["a"] == s1["f1"], "left").join(s2, edges["b"] == s2["f2"], "left").select(F.coalesce("t1", "a").alias("a"), F.coalesce("t2", "b").alias("b"))
        edges = stage(spark, moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        drop(spark, *was)
    drop(spark, edges)
    return roots


PLACE = ["h1", "h2", "h3"]


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t, id): t is the text's hash, id the doc_id or, where that is null, t."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).withColumn("id", F.coalesce("doc_id", "t"))


def checked(spark: SparkSession, docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (PLACE, a, b) of sets, links (a, b) that connect what the true ones connect.

    In a group the set a pair's place is named by (kind 0) comes first, as the one that others are told by.
    """
    first = F.when(F.col("k") == F.col("h1"), F.lit(0)).otherwise(F.lit(1))
    ends = pairs.select(*PLACE, F.col("a").alias("k")).unionByName(pairs.select(*PLACE, F.col("b").alias("k"))).distinct()
    ends = stage(spark, ends.join(sets.select("k", "id", "t"), "k").select(*PLACE, first.alias("kind"), "id", "t"), "ends")
    wanted = stage(spark, ends.select("id", "t").distinct(), "wanted")  # only these texts go through a shuffle, once
    texts = named(docs).select("id", "t", "text").join(small_or_not(wanted, wanted.count()), ["id", "t"], "left_semi")
    none = F.lit(None).cast("bigint")
    members = texts.join(small_or_not(ends, ends.count()), ["id", "t"]).select(*PLACE, "kind", none.alias("a"), none.alias("b"), "text")
    asked = pairs.select(*PLACE, F.lit(2).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text"))
    homes = members.unionByName(asked).repartition(*PLACE).sortWithinPartitions(*PLACE, "kind", "a", "b")
    links = stage(spark, homes.mapInArrow(_verify(size, num, den), "a long, b long"), "checked")
    drop(spark, ends, wanted)
    free_shuffles(spark)
    return links


def likely(spark: SparkSession, sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs (PLACE, a, b) whose long parity bits leave enough overlap."""
    a, b = (sets.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (5, 6))
            most = na + nb - 2 * needed_overlap(na, nb, num, den)
            keep = [long_differing(x, y) <= m for x, y, m in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), most.tolist())]
            yield batch.select([*PLACE, "a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(a, "a").join(b, "b").select(*PLACE, "a", "b", "na", "nb", "bitsa", "bitsb")
    return stage(spark, both.mapInArrow(near, PAIR), "likely")


def joined_to(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the roots of their ends."""
    ra, rb = roots.toDF("ia", "ra"), roots.toDF("ib", "rb")
    out = links.join(ra, links["a"] == ra["ia"], "left").join(rb, links["b"] == rb["ib"], "left")
    return out.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(id, root) of all ends when the roots (id, root) have gone to those of `more` (id, root)."""
    more = more.toDF("root", "top")
    ends = roots.join(more, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    alone = more.join(roots, more["root"] == roots["id"], "left_anti").select(F.col("root").alias("id"), F.col("top").alias("root"))
    return ends.unionByName(alone)


def _rooted(rows: DataFrame, of: str, roots: DataFrame) -> DataFrame:
    """rows (token, k, n, pos, p1, p2) with the root that `roots` (id, root) have for the column `of`, else that itself."""
    linked = roots.toDF("id", "top")
    return rows.join(small_or_not(linked, linked.count()), rows[of] == linked["id"], "left").select("token", "k", "n", "pos", "p1", "p2", F.coalesce("top", of).alias("root"))


def by_family(spark: SparkSession, near: DataFrame, held: list[DataFrame]) -> DataFrame:
    """Pairs (PLACE, a, b) of near (a, b), one a set, in groups by b of about FAMILY sets at most.

    The table they are read from beside near is added to `held`, for the caller to drop.
    """
    many = stage(spark, near.groupBy("b").count().where(F.col("count") > FAMILY).select(F.col("b").alias("h"), F.ceil(F.col("count") / FAMILY).alias("parts")), "many")
    held.append(many)
    part = F.coalesce(F.pmod(F.xxhash64("a"), "parts"), F.lit(0)).cast("long")
    return near.join(small_or_not(many, many.count()), near["b"] == many["h"], "left").select(F.col("b").alias("h1"), part.alias("h2"), F.lit(0).alias("h3"), "a", "b")


def set_links(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, t, n, k), the sets (k, id, t, least: its least doc_id, n, bits) and (id, root) of linked keys k.

    Roots tell exactly what all pairs with den * overlap >= num * union connect.
    """
    prepare(spark)
    scan = stage(spark, named(docs).select("doc_id", "text", "t").mapInArrow(_scan(size), SCAN), "scan")
    meta = scan.where("piece IS NULL").select("doc_id", "t", "n", "k", "bits")
    held = spark.sparkContext.broadcast(ranks(sketch(scan)))
    one = F.min(F.struct(F.coalesce("doc_id", "t").alias("id"), "t")).alias("one")
    sets = stage(spark, meta.where("n > 0").groupBy("k").agg(one, F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("k", "one.id", "one.t", "least", "n", "bits"), "sets")

    entries = docs.select("text").mapInArrow(_prefixes(size, num, den, held), "token long, cell int, at long, k long, p1 long, p2 long")
    entries = entries.repartition("token", "cell").sortWithinPartitions("token", "cell", "at", "k")
    lists = stage(spark, entries.mapInArrow(_lists(num, den), "x long, y long, d int, token long, n int, pos int, p1 long, p2 long"), "lists")
    free_shuffles(spark)  # that of all entries is the largest

    def nearest_of(found: DataFrame) -> DataFrame:
        least = found.groupBy("x").agg(F.min(F.struct("d", "y")).alias("m"))
        return stage(spark, least.select(F.col("x").alias("a"), F.col("m.y").alias("b")), "near")

    near = nearest_of(lists.where("y IS NOT NULL"))
    held: list[DataFrame] = []
    one = checked(spark, docs, sets, by_family(spark, near, held), size, num, den)
    roots = components(spark, one)
    rows = lists.where("y IS NULL").select("token", F.col("x").alias("k"), "n", "pos", "p1", "p2")
    rows = stage(spark, _rooted(rows, "k", roots), "rooted")
    drop(spark, lists, near, one, *held)

    turn, more = 0, True
    while more:  # one pair a set, while that joins many
        held = []
        crossed = _crossed(spark, rows, held).repartition("token", "cell").sortWithinPartitions(*CELLS)
        near = nearest_of(crossed.mapInArrow(_one_each(num, den, turn), "x long, y long, d long"))
        wanted = by_family(spark, near, held)
        close = likely(spark, sets, wanted, num, den)
        two = checked(spark, docs, sets, close, size, num, den)
        links, asked = two.count(), near.count()
        more, turn = links >= max(LEAST_LINKS, asked // 8), turn + 1
        if links:
            step = components(spark, joined_to(two, roots))
            was = roots, rows, step
            lists = held[0].select(F.col("t").alias("token"))  # lists of one root are done
            rows = rows.join(small_or_not(lists, lists.count()), "token", "left_semi")
            rows = stage(spark, _rooted(rows, "root", step), "rooted")
            roots = stage(spark, merged(roots, step), "found")
            drop(spark, *was)
        drop(spark, near, close, two, *held)

    held = []
    crossed = _crossed(spark, rows, held).repartition("token", "cell").sortWithinPartitions(*CELLS).mapInArrow(_long_lists(num, den), PAIR)
    pairs = stage(spark, crossed.groupBy("a", "b").agg(F.min(F.struct(*PLACE)).alias("home")).select("home.*", "a", "b"), "pairs")
    drop(spark, rows, *held)
    close = likely(spark, sets, pairs, num, den)
    two = checked(spark, docs, sets, close, size, num, den)
    step = components(spark, joined_to(two, roots))
    found = stage(spark, merged(roots, step), "found")
    drop(spark, two, pairs, close, roots, step)
    return meta.drop("bits"), sets, found


def _classed(spark: SparkSession, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Every document's (doc_id, t, n, k, least): least is the least doc_id of its component, null for lone documents."""
    meta, sets, roots = set_links(spark, docs, size, num, den)
    linked = sets.join(roots, sets["k"] == roots["id"]).select("k", "root", "least")
    tops = linked.groupBy("root").agg(F.min("least").alias("least"))
    inside = linked.select("k", "root").join(tops, "root").select("k", "root", "least")
    many = meta.where("n > 0").groupBy("k").count().where("count > 1").select("k")  # equal sets without a link to others
    copies = many.join(inside, "k", "left_anti").join(sets, "k").select("k", F.col("k").alias("root"), "least")
    inside = stage(spark, inside.unionByName(copies), "inside")
    drop(spark, sets, roots)
    return meta.where("n > 0").join(small_or_not(inside, inside.count()), "k", "left").unionByName(meta.where("n = 0").select("*", F.lit(None).cast("bigint").alias("root"), F.lit(None).cast("bigint").alias("least")))


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Every document's (doc_id, n_shingles, component_id): component_id is the least doc_id that links reach."""
    found = _classed(spark, has(docs, "doc_id", "text"), size, num, den)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of least (doc_id, hash of the text), null doc_ids last.

    Rows without words are linked with nothing and all stay. Of rows that share a doc_id, those of different components
    stay both, and of those that share the text too one stays, an arbitrary one where further columns differ.
    """
    found = stage(spark, _classed(spark, has(docs, "doc_id", "text"), size, num, den).where("root IS NOT NULL").select("doc_id", "t", "root"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", "t").alias("id"), "t")
    first = found.groupBy("root").agg(F.min(order).alias("one"))
    i, t = _unused(docs, "_id"), _unused(docs, "_t")
    rows = found.select("root", order.alias("own")).groupBy("root", "own").count().join(first, "root")
    gone = stage(spark, rows.where("own <> one").select(F.col("own.id").alias(i), F.col("own.t").alias(t)).distinct(), "gone")
    twice = stage(spark, rows.where("own = one AND count > 1").select(F.col("own.id").alias(i), F.col("own.t").alias(t)).distinct(), "twice")
    text = F.xxhash64(docs["text"])
    marked = docs.select("*", F.coalesce(docs["doc_id"], text).alias(i), text.alias(t))
    left = marked.join(small_or_not(gone, gone.count()), [i, t], "left_anti")
    if n := twice.count():
        once = left.join(small_or_not(twice, n), [i, t], "left_semi").dropDuplicates([i, t])
        left = left.join(small_or_not(twice, n), [i, t], "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
