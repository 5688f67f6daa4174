"""Repair of conversations: the cheapest edits that give roles of the form (s?(ua)+)?, by A* on the edit lattice.

Rows of a conversation go by turn (null first), then by role and the hash of role and text. A row's first fault counts:
blank, a copy of an earlier row (role and text), truncated (does not end in . ! or ?). Edits: K keep 0, R change the
role to user or assistant 1, D delete 2 (the only one for blank rows and copies), I insert an empty user or assistant
row 5; a truncated row that stays costs 5 more.

A state is a row and a phase: nothing yet, after the system's row, after the user's, after the assistant's. A* pops by
(cost plus heuristic, edits so far as text). The heuristic sums over the rows ahead 2 for each that must go and 2 for
each truncated one, which costs that or more either way; it never falls by more than an edit costs. Two ways of one
cost to one state take the same rows, so neither's text begins the other's: the least stays the least when edits are
added, and the first goal popped is the cheapest repair with the ASCII-least edits.

Rows are judged in Spark and reach Python without their texts, equal ones as one row with a count. They are dealt by
ranges of conversation and turn, so a conversation of any share of the table is cut over many tasks. Within a task a
search takes at most BLOCK rows: from each phase it begins in to each it may end in. Such tables of costs and edits are
multiplied (least cost, then least text) to those of longer stretches and, for the conversations that cross a border of
ranges, over tasks. Edits meet the texts again in the order of turns, row by row; no conversation's texts are held.

Null roles and texts are one space; null conv_ids are one conversation and null turns come first; empty texts are blank;
very long ones are judged in Spark; equal rows are copies; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import has, prepare, stage

#: White space, and what ends a whole text.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Rows of one search, at most.
BLOCK = 512
FINE, BLANK, COPY, CUT = 0, 1, 2, 3
#: Phases: nothing yet, after s, after u, after a. A repair may end in the first and the last.
NONE, S, U, A = 0, 1, 2, 3
#: The phase a user's or an assistant's row may follow, and the one it leads to.
NEXT = {"u": {NONE: U, S: U, A: U}, "a": {U: A}, "s": {NONE: S}}
EITHER = {NONE: U, S: U, A: U, U: A}
KEEP, REROLE, DELETE, INSERT, STAYS_CUT = 0, 1, 2, 5, 5

Row = tuple[str, int]  # initial of the role, fault
Ways = dict[int, tuple[int, str]]  # phase at the end to cost and edits


def search(rows: list[Row], first: int, ends: tuple[int, ...], one: bool = False) -> Ways:
    """The cheapest edits of rows from a phase to each of `ends` that can be reached (one: to the best of them)."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0 if rows[i][1] == FINE else 2)
    heap, done, found = [(ahead[0], "", 0, first)], set(), {}
    while heap:
        f, edits, i, phase = heappop(heap)
        if (i, phase) in done:
            continue
        done.add((i, phase))
        cost = f - ahead[i]
        if i == n and phase in ends:
            found[phase] = (cost, edits)
            if one or len(found) == len(ends):
                break
        heappush(heap, (f + INSERT, edits + "I", i, EITHER[phase]))
        if i < n:
            initial, fault = rows[i]
            rest = cost + ahead[i + 1]
            heappush(heap, (rest + DELETE, edits + "D", i + 1, phase))
            if fault in (FINE, CUT):
                rest += STAYS_CUT if fault == CUT else 0
                if phase in NEXT.get(initial, ()):
                    heappush(heap, (rest + KEEP, edits + "K", i + 1, NEXT[initial][phase]))
                heappush(heap, (rest + REROLE, edits + "R", i + 1, EITHER[phase]))
    return found


def table(rows: list[Row]) -> list[Ways]:
    """For each phase before rows, the cheapest edits to each phase after them."""
    return [search(rows, phase, (NONE, S, U, A) if phase == NONE else (U, A) if phase != S else (S, U, A)) for phase in range(4)]


def chain(before: Ways, after: list[Ways]) -> Ways:
    """The ways of two stretches in a row."""
    out: Ways = {}
    for mid, (cost, edits) in before.items():
        for end, (more, then) in after[mid].items():
            if end not in out or (cost + more, edits + then) < out[end]:
                out[end] = (cost + more, edits + then)
    return out


def best(ways: Ways) -> tuple[int, str]:
    return min(w for end, w in ways.items() if end in (NONE, A))


class Stretch:
    """What a task knows of a conversation's rows in its range."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first, self.last, self.rows, self.tables = None, None, [], []

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == COPY
        self.truncated += fault == CUT
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:  # turns ascend
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.rows.append((initial, fault))
        if len(self.rows) == BLOCK:
            self.tables.append(table(self.rows))
            self.rows = []

    def row(self, part: int, whole: bool) -> tuple:
        """A row of STRETCHES: costs and edits are the best repair of a whole conversation, else the 4 by 4 table."""
        if whole and not self.tables:
            ways = [best(search(self.rows, NONE, (NONE, A), one=True))]
        else:
            tables = [*self.tables, table(self.rows)] if self.rows else self.tables
            product = []
            for phase in range(1 if whole else 4):
                got = {phase: (0, "")}
                for t in tables:
                    got = chain(got, t)
                product.append(got)
            ways = [best(product[0])] if whole else [p.get(end, (-1, "")) for p in product for end in range(4)]
        costs, edits = zip(*ways)
        return self.conv, part, whole, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last, list(costs), list(edits)


STRETCHES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")], ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))])
STRETCHES_SQL = "conv_id long, part int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, edits array<string>"
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judged rows of a range, in order, to a row for each conversation; the first and the last may go on elsewhere."""
    part, now, n, out = TaskContext.get().partitionId(), None, 0, []
    for b in batches:
        for conv, turn, initial, fault, copies in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row(part, n > 0))
                    n += 1
                now = Stretch(conv)
            now.add(turn, initial, fault)
            for _ in range(copies - 1):
                now.add(turn, initial, BLANK if fault == BLANK else COPY)
        if len(out) >= 1024:
            yield _batch(out, STRETCHES)
            out = []
    if now is not None:
        yield _batch([*out, now.row(part, False)], STRETCHES)


def _joined(stretches: pa.Table) -> pa.Table:
    """A conversation's stretches to its row of PLAN."""
    rows = stretches.sort_by("part").to_pylist()
    sums = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    sums["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    dated = [r for r in rows if r["turns"]]
    sums["turns"] -= sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    ways: Ways = {NONE: (0, "")}
    for r in rows:
        cells = list(zip(r["costs"], r["edits"]))
        ways = chain(ways, [{end: cells[4 * p + end] for end in range(4) if cells[4 * p + end][0] >= 0} for p in range(4)])
    cost, audit = best(ways)
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - sums["turns"] if dated else 0
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "gaps": [gaps], **{c: [sums[c]] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": [cost], "audit": [audit]})


def given(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of the last two as one space."""
    c = has(conversations, "conv_id", "turn", "role", "text")
    return c.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def identity() -> Column:
    """What equal rows of a conversation share: role and text, told apart by the length of the first."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def plan(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """PLAN for every conversation of rows as given() has them: faults, cost and edits."""
    prepare(spark)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(*ENDS), FINE).otherwise(CUT)
    judged = rows.select("conv_id", "turn", "role", identity().alias("same"), fault.alias("fault"))
    judged = judged.groupBy("conv_id", "turn", "role", "same").agg(F.first("fault").alias("fault"), F.count("*").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    seen = judged.groupBy("conv_id", "same").agg(F.min(at).alias("earliest"), F.count("*").alias("n")).where("n > 1").toDF("c", "s", "earliest", "n")
    judged = judged.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    again = F.col("earliest").isNotNull() & (F.col("earliest") < at) & (F.col("fault") != BLANK)
    judged = judged.select("conv_id", "turn", "role", "same", F.when(again, COPY).otherwise(F.col("fault")).alias("fault"), "copies")
    keys = ["conv_id", "turn", "role", "same"]
    ordered = judged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "copies")
    found = stage(spark, ordered.mapInArrow(_stretches, STRETCHES_SQL), "stretches")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    whole = found.where("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("edits")[0].alias("audit"))
    return whole.unionByName(found.where("not whole").groupBy("conv_id").applyInArrow(_joined, PLAN))


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
REPAIRED_SQL = "conv_id long, place long, edit string, turn long, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits and then its rows, in order, to the rows of its repair."""
    conv, audit, at, place, phase, out = None, "", 0, 0, NONE, []

    def made(edit: str, turn: int | None, role: str, text: str) -> tuple:
        nonlocal place, phase
        if edit != "K":
            role = "assistant" if phase == U else "user"
        phase = NEXT[role[:1]][phase]
        place += 1
        return conv, place - 1, edit, turn, role, text

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield made("I", None, "", "")

    for b in batches:
        for key, edits, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if edits is not None:
                out.extend(inserted())
                conv, audit, at, place, phase = key, edits, 0, 0, NONE
                continue
            out.extend(inserted())
            at += 1
            if audit[at - 1] != "D":
                out.append(made(audit[at - 1], turn, role, text))
        if out:
            yield _batch(out, REPAIRED)
            out = []
    out.extend(inserted())
    if out:
        yield _batch(out, REPAIRED)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of all repairs, each conversation's together and in order.

    A conversation's rows pass through one task, one batch at a time, because what is made of them is a sequence.
    """
    none = F.lit(None)
    edits = plans.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("edits"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("same"))
    both = edits.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), none.cast("string").alias("edits"), "turn", "role", "text", identity().alias("same")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "same")
    return ordered.select("conv_id", "edits", "turn", "role", "text").mapInArrow(_edited, REPAIRED_SQL)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, started, h, out = None, False, hashlib.sha256(), []
    for b in batches:
        for conv, place, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if place == 0:
                if started:
                    out.append((now, h.hexdigest()))
                now, started, h = conv, True, hashlib.sha256()
            h.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        if out:
            yield _batch(out, schema)
            out = []
    if started:
        yield _batch([(now, h.hexdigest())], schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of conv_id:turn deals out, modulo 20: 0 dropped, 1 emptied, 2 without . ! ?,
    3 twice, 4 role user."""
    rows = given(conversations)
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("k", F.crc32(F.concat(text[0], F.lit(":"), text[1])) % 20).where("k <> 0")
    rows = rows.withColumns({"text": F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("twice", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def damaged_repairs(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The faults, the repair and its hash for every conversation of the table after damaged()."""
    prepare(spark)
    rows = damaged(conversations)
    plans = stage(spark, plan(spark, rows), "plans")
    hashes = repaired(rows, plans).select("conv_id", "place", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), F.lit("").alias("repaired_sha256")).distinct()
    # every conversation has a row of nothings; what is found is more than that, so that one grouping joins all three
    found = plans.withColumn("repaired_sha256", F.lit("")).unionByName(hashes.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), "repaired_sha256"))
    parts = every.unionByName(found).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")])
    return parts.withColumn("repaired_sha256", F.when(F.col("repaired_sha256") == "", F.sha2(F.lit(""), 256)).otherwise(F.col("repaired_sha256")))
