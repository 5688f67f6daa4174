"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

With token shares q, source s gets weight q_s ** a / sum(q ** a). The exponent a in [0, 1] is found by bisection: the
largest whose weights reach a target entropy (a share of the highest possible), and, if a repetition limit is given,
at least as large as needed for no source to be repeated more often than that (the limit goes first where both
cannot hold). A budget in tokens then gives each source weight * budget tokens, taken as whole passes over its
documents and one partial pass. Each pass of a source is a permutation of its blocks (by hash of the pass), and of
the documents within a block; the partial pass ends at the document where the source's budget is met.

Documents are dealt to blocks of a source by hash, so a source of any size is spread; only sums by block are
ordered, and running sums of documents stay within one block. Without a budget, the least one at which every source
has a full pass is taken, so no document is left out.

Tokens by source are summed in Spark. Up to SOURCES sources the plan is made from their rows on the driver; of more, the
driver gets sums over all sources at some exponents at once, narrows the exponent by these, and the plan is an
expression over the table of sources. It is broadcast within the bound that holds for all small sides, else joined. A
document's tokens are its white-space words, at least one. Null sources are a source of their own; null texts have
one token; repeated rows are taken each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import small_or_not, stage


#: Sources whose rows the driver takes, at most; and how a wider bisection goes: exponents a job, jobs.
SOURCES, CELLS, ROUNDS = 4096, 32, 12


def weights_at(shares: list[float], exponent: float) -> list[float]:
    raised = [q**exponent if q > 0 else 0.0 for q in shares]
    total = math.fsum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repetition(shares: list[float], weights: list[float], budget: float | None) -> float:
    """Passes over the most repeated source, for a budget as a multiple of all tokens (None: one full pass at least)."""
    ratio = [w / q for q, w in zip(shares, weights) if q > 0]
    return max(ratio) * budget if budget else max(ratio) / min(ratio)


def _bisect(holds, low: float, high: float) -> float:
    """The largest exponent of [low, high] that holds, for a condition that fails from some point on."""
    if holds(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def choose_exponent(shares: list[float], least_entropy: float | None = None, most_passes: float | None = None, budget: float | None = None) -> float:
    """The exponent for a target entropy (as a share of log(sources)) and a repetition limit.

    Entropy falls as the exponent grows; passes over the rarest source fall too.
    """
    a = 1.0
    if least_entropy is not None and len(shares) > 1:
        goal = least_entropy * math.log(len(shares))
        a = _bisect(lambda x: entropy(weights_at(shares, x)) >= goal - 1e-12, 0.0, 1.0)
    if most_passes is not None and shares and repetition(shares, weights_at(shares, a), budget) > most_passes + 1e-9:
        a = 1.0 - _bisect(lambda x: repetition(shares, weights_at(shares, 1.0 - x), budget) <= most_passes + 1e-9, 0.0, 1.0 - a)
    return a


@dataclass(frozen=True)
class Mix:
    """Target and layout: least_entropy is a share of log(sources); budget is a multiple of all tokens, or None."""

    least_entropy: float | None = 0.95
    most_passes: float | None = 2.0
    budget: float | None = None
    block_tokens: int = 1 << 20


def source_plan(sources: list[tuple[str | None, int]], mix: Mix) -> list[tuple[str | None, int, float, int, int, int]]:
    """(source, tokens, weight, whole passes, tokens of the partial pass, blocks) from the tokens by source."""
    total = sum(t for _, t in sources)
    if not total:
        return []
    shares = [t / total for _, t in sources]
    weights = weights_at(shares, choose_exponent(shares, mix.least_entropy, mix.most_passes, mix.budget))
    budget = mix.budget * total if mix.budget else max(q * total / w for q, w in zip(shares, weights))
    out = []
    for (name, tokens), w in zip(sources, weights):
        due = round(w * budget)
        out.append((name, tokens, w, due // tokens, due % tokens, max(1, math.ceil(tokens / mix.block_tokens))))
    return out


def _sums_at(sources: DataFrame, exponents: list[float], total: int) -> list[tuple[float, float]]:
    """For each exponent the sum of the raised shares and the entropy of the weights, by one job over (source, tokens)."""
    q = F.col("tokens").cast("double") / F.lit(float(total))
    columns = []
    for k, a in enumerate(exponents):
        raised = F.pow(q, F.lit(a))
        columns += [F.sum(raised).alias(f"s{k}"), F.sum(raised * F.lit(a) * F.ln(q)).alias(f"t{k}")]
    r = sources.agg(*columns).first()
    return [(r[f"s{k}"], math.log(r[f"s{k}"]) - r[f"t{k}"] / r[f"s{k}"]) for k in range(len(exponents))]


def _narrowed(holds, low: float, high: float) -> float:
    """The largest exponent that holds, for a condition on many at once that fails from some point on."""
    if holds([high])[0]:
        return high
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / CELLS for k in range(1, CELLS)]
        ok = sum(1 for x in holds(grid) if x)
        low, high = (grid[ok - 1] if ok else low), (grid[ok] if ok < len(grid) else high)
    return low


def wide_plan(sources: DataFrame, mix: Mix, n: int) -> DataFrame:
    """source_plan() as a table, for any number of sources (source, tokens): the driver gets sums alone."""
    r = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    total, least, most = r[0], r[1] / r[0], r[2] / r[0]
    a = 1.0
    if mix.least_entropy is not None:
        goal = mix.least_entropy * math.log(n)
        a = _narrowed(lambda xs: [h >= goal - 1e-12 for _, h in _sums_at(sources, xs, total)], 0.0, 1.0)
    if mix.most_passes is not None:
        limit = mix.most_passes + 1e-9

        def few(xs: list[float]) -> list[bool]:  # at exponents 1 - x
            if mix.budget is None:
                return [(least / most) ** -x <= limit for x in xs]
            return [least**-x / s * mix.budget <= limit for x, (s, _) in zip(xs, _sums_at(sources, [1.0 - x for x in xs], total))]

        if not few([1.0 - a])[0]:
            a = 1.0 - _narrowed(few, 0.0, 1.0 - a)
    (s, _), = _sums_at(sources, [a], total)
    budget = mix.budget * total if mix.budget else total * s * most ** (1.0 - a)
    q = F.col("tokens").cast("double") / F.lit(float(total))
    weight = F.pow(q, F.lit(a)) / F.lit(s)
    due = F.bround(weight * F.lit(float(budget))).cast("long")
    return sources.select(F.col("source").alias("s"), F.col("tokens").alias("source_tokens"), weight.alias("weight"), F.floor(due / F.col("tokens")).cast("long").alias("passes"), F.pmod(due, F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(float(mix.block_tokens)))).cast("long").alias("blocks"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens and a hash of the row, which equal rows share."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)))
    return docs.select("doc_id", "source", F.greatest(words, F.lit(1)).cast("long").alias("tokens"), F.xxhash64("doc_id", "text").alias("_h"))


def _block(h: str, blocks: str):
    return F.pmod(F.xxhash64(h, F.lit("block")), F.col(blocks))


def layout(spark: SparkSession, docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows dealt to blocks, the plan by source, the block passes taken whole, and the rows of the partial ones.

    A source has at most one block taken in part: there, and only there, documents are ordered.
    """
    rows = stage(spark, _keyed(docs), "mix-rows")
    sums = stage(spark, rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    n = sums.count()
    if n <= SOURCES:
        sources = sorted(((r["source"], r["tokens"]) for r in sums.collect()), key=lambda x: (x[0] is None, x[0] or ""))
        plan = spark.createDataFrame(source_plan(sources, mix), "s string, source_tokens long, weight double, passes long, rest long, blocks long")
    else:
        plan = stage(spark, wide_plan(sums, mix, n), "mix-plan")
    dealt = rows.join(small_or_not(plan, n), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", _block("_h", "blocks")).drop("s")
    sums = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    passes = sums.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "epoch", "block"), "block")
    placed = passes.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("before", F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = (F.col("epoch") < F.col("passes")) | (F.col("before") + F.col("block_tokens") <= F.col("rest"))
    placed = stage(spark, placed.where(whole | (F.col("before") < F.col("rest"))).select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("epoch").cast("int").alias("epoch"), "place", whole.alias("whole"), (F.col("rest") - F.col("before")).alias("room")), "mix-blocks")
    cut = small_or_not(placed.where("NOT whole"), n)  # a row a source at most
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("_h", F.lit("order")), "doc_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    in_cut = dealt.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    units = in_cut.groupBy("doc_id", "_h", "source", "block", "epoch", "place", "room").agg(F.sum("tokens").alias("unit"))
    units = units.withColumn("ahead", F.coalesce(F.sum("unit").over(inside), F.lit(0))).where("ahead < room")
    return dealt, plan, placed.where("whole"), stage(spark, units.select("doc_id", "_h", "source", "block", "epoch", "place"), "mix-part")


def mixed(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The draws (doc_id, source, tokens, epoch, block, place) and the plan by source; place orders a source's blocks.

    A row of docs is drawn once for each pass of its source that reaches it.
    """
    dealt, plan, whole, part = layout(spark, docs, mix)
    base = dealt.select("doc_id", "_h", "source", "tokens", "block")
    w = small_or_not(whole, whole.count())
    first = base.join(w, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("doc_id", "source", "tokens", "epoch", "block", "place")
    p = small_or_not(part.select(F.col("doc_id").alias("d"), F.col("_h").alias("h"), "epoch", "place"), part.count())
    last = base.join(p, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h"))).select("doc_id", "source", "tokens", "epoch", "block", "place")
    return first.unionByName(last), plan


def mix_rows(spark: SparkSession, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs as often as they are drawn; texts are not shuffled while the block table is small."""
    _, plan, whole, part = layout(spark, docs, mix)
    times = whole.groupBy("s", "b").agg(F.count("*").cast("int").alias("_n"))
    part = part.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k")).distinct().withColumn("_more", F.lit(1))
    keyed = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], docs["source"].alias("_source"), docs["doc_id"].alias("_doc"), F.xxhash64(docs["doc_id"], docs["text"]).alias("_h"))
    keyed = keyed.join(small_or_not(plan.select(F.col("s").alias("_s"), "blocks"), plan.count()), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", _block("_h", "blocks"))
    keyed = keyed.join(small_or_not(times, times.count()), F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")), "left")
    keyed = keyed.join(small_or_not(part, part.count()), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left")
    drawn = F.coalesce("_n", F.lit(0)) + F.coalesce("_more", F.lit(0))
    out = keyed.withColumn("_drawn", drawn).where("_drawn > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_drawn"))))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
