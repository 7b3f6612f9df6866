"""Mixing of sources to target shares of the tokens, by a low-discrepancy schedule of blocks.

The documents of each source are shuffled by hash and laid end to end in blocks of equal tokens; a slot
of the mixture belongs to the source in whose stretch of the cumulated weights the fractional part of
its number times the golden ratio falls, and the n-th slot of a source takes its n-th block. Any stretch
of the mixture so holds the sources in nearly their shares, and the mixture can be written or read in parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.tokens import count
from docloom.tables import checkpointed, stored

#: Tokens of a block.
BLOCK = 4096
#: Parts that a copy of a source's documents is shuffled into; each is summed up on its own.
PARTS = 4096
#: Slots of the schedule that are ranked together.
STRETCH = 1 << 16
GOLDEN = 0.6180339887498949
#: Sources that a mixture may name; their sums are brought to the driver.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Plan:
    """What a source gives to the mixture."""

    source: str
    target: float
    weight: float
    max_repeats: int
    documents: int
    tokens: int
    slots: int
    low: float
    high: float


def plan(sized: DataFrame, targets: DataFrame, block: int = BLOCK, total: int | None = None) -> list[Plan]:
    """The number of slots of each source.

    The mixture is as large as every source with tokens can reach its share of, no document used more
    often than it may; a given ``total`` overrides that, and a source then gives what it has at most.
    Shares of sources without tokens go to the others in proportion.
    """
    sums = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    goals = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
    goals = goals.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most"))
    rows = goals.join(sums, "source").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    rows = [r for r in rows if r["tokens"]]
    if not rows:
        return []
    whole = sum(r["share"] for r in rows)
    size = min(r["tokens"] * r["most"] / (r["share"] / whole) for r in rows) if total is None else total
    out, low = [], 0.0
    for k, r in enumerate(rows):
        weight = r["share"] / whole
        have = r["tokens"] * r["most"]
        want = max(1, round(min(size * weight, have) / block))
        while want > 1 and want * block > have:
            want -= 1
        high = 1.0 if k == len(rows) - 1 else low + weight
        out.append(Plan(r["source"], r["share"], weight, r["most"], r["documents"], r["tokens"], want, low, high))
        low = high
    return out


def _shuffled(sized: DataFrame, plans: list[Plan], block: int, seed: int) -> DataFrame:
    """``source, block_no, place, doc_id, copy, n_tokens``: the documents of each source in shuffled order, as often as needed.

    The running sum of tokens goes in two steps, over parts and within each, so that no source is
    gathered in one task, however many rows it has.
    """
    spark = sized.sparkSession
    needed = spark.createDataFrame([(p.source, min(p.max_repeats, -(-p.slots * block // p.tokens)), p.tokens) for p in plans], "source string, copies int, of_source bigint")
    each = sized.join(F.broadcast(needed), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    mixed = F.xxhash64("doc_id", "copy", F.lit(seed))
    each = each.withColumn("_h", mixed).withColumn("_part", F.pmod("_h", F.lit(PARTS)))
    key = ["source", "copy", "_part"]
    sums = each.groupBy(*key).agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("source", "copy").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*key, "_ahead")
    inside = Window.partitionBy(*key).orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(sums, key).withColumn("_at", (F.col("copy") - 1) * F.col("of_source") + F.col("_ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return each.select("source", F.floor(F.col("_at") / block).alias("block_no"), (F.col("_at") % block).alias("place"), "doc_id", "copy", "n_tokens")


def schedule(spark, plans: list[Plan]) -> DataFrame:
    """``slot, source, block_no``: the slots of the mixture in order, each with the block it takes.

    The slots a source has beyond its number of blocks are left empty; ranks within a source are counted
    by stretches of slots and within them, not in one task.
    """
    total = sum(p.slots for p in plans)
    # each source draws by its share of the slots, so that it has about as many as it has blocks
    bounds, low = [], 0.0
    for p in plans:
        bounds.append((p.source, low, low + p.slots / total))
        low += p.slots / total
    bounds[-1] = (*bounds[-1][:2], 2.0)
    slack = 64 + total // 1000
    # the products of large numbers lose digits; stretches start afresh, each at its own offset
    point = F.expr(f"((id % {STRETCH}) * {GOLDEN!r}D + (id div {STRETCH}) * 0.7548776662466927D) % 1.0D")
    # a point finds its source by the buckets that the source's stretch lies in; a bucket holds two or so
    buckets = 4 * len(bounds)
    held = [(k, source, low, high) for source, low, high in bounds for k in range(min(int(low * buckets), buckets - 1), min(int(high * buckets), buckets - 1) + 1)]
    stretches = spark.createDataFrame(held, "_bucket int, source string, _low double, _high double")
    points = spark.range(total + slack * len(plans)).withColumn("_x", point).withColumn("_bucket", F.least(F.floor(F.col("_x") * buckets), F.lit(buckets - 1)).cast("int"))
    inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high"))
    slots = points.join(F.broadcast(stretches), "_bucket").where(inside).select(F.col("id").alias("slot"), F.expr(f"id div {STRETCH}").alias("_stretch"), "source")
    counts = slots.groupBy("source", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("source", "_stretch").orderBy("slot"))
    ranked = slots.join(counts, ["source", "_stretch"]).select("slot", "source", (rank + F.col("_ahead") - 1).alias("block_no"))
    blocks = spark.createDataFrame([(p.source, p.slots) for p in plans], "source string, slots long")
    return ranked.join(F.broadcast(blocks), "source").where(F.col("block_no") < F.col("slots")).select("slot", "source", "block_no")


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total: int | None = None, seed: int = 13) -> DataFrame:
    """``slot, place, source, doc_id, copy, n_tokens``: the mixture, in order of slot and place.

    A document counts once for each copy; it stands in the block in which it begins, whole. Documents
    without tokens (null and empty texts), of no source or of a source without a target are not in it,
    nor is a target without documents. No document is there more often than its source's max_repeats. A
    doc_id that repeats counts as so many documents. Empty tables give an empty mixture.
    """
    return _mixed(_sized(documents), targets, block, total, seed)[0]


def _sized(documents: DataFrame) -> DataFrame:
    sized = count(documents.where(F.col("source").isNotNull() & (F.length("text") > 0)), keep=["doc_id", "source"])
    # sizes are asked for more than once; texts are not
    return checkpointed(sized.where(F.col("n_tokens") > 0))


def _mixed(sized: DataFrame, targets: DataFrame, block: int, total: int | None, seed: int) -> tuple[DataFrame, list[Plan]]:
    spark, plans = sized.sparkSession, plan(sized, targets, block, total)
    if not plans:
        return spark.createDataFrame([], "slot bigint, place bigint, source string, doc_id bigint, copy int, n_tokens bigint"), plans
    blocks = _shuffled(sized, plans, block, seed)
    # a slot with no document at all is possible only where one is longer than a block
    return schedule(spark, plans).join(blocks, ["source", "block_no"]).select("slot", "place", "source", "doc_id", "copy", "n_tokens"), plans


def shares(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total: int | None = None, seed: int = 13) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, most_copies``: what each source got, also those of only one table.

    A source without a target has a null target and nothing; a target without documents a share of 0.
    """
    sized = _sized(documents)
    mixed, _ = _mixed(sized, targets, block, total, seed)
    # a row for each source of the mixture, of which there are at most MOST_SOURCES
    got = stored(mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("copy").alias("most_copies")))
    whole = got.agg(F.sum("tokens")).first()[0] or 1
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"))
    every = sized.select("source").distinct().join(goals, "source", "full").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.select("source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("documents"), zero("most_copies"))
