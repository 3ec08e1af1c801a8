"""Positions in a total order and the plans of fixed size over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a stripe that are worth a stripe of their own, most stripes, and how many of them a search looks at together.
STRIPE, MOST_STRIPES, STEP = 1 << 16, 1024, 32


def _stripes(rows: DataFrame, each: int) -> Column:
    """Which of the ranges of idx that hold about equally many rows an idx lies in: by approximate quantiles, so ids may be hashed or sparse."""
    fractions = [k / MOST_STRIPES for k in range(1, MOST_STRIPES)]
    found = rows.agg(F.count("idx").alias("n"), F.percentile_approx("idx", fractions, 10 * MOST_STRIPES).alias("q")).first()  # one row
    wanted = min(MOST_STRIPES, max(1, found.n // each))
    cuts = sorted({found.q[k * MOST_STRIPES // wanted - 1] for k in range(1, wanted)})
    if not cuts:
        return F.lit(0)
    at_most = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("idx")))
    coarse = at_most(F.array(*(F.lit(c) for c in cuts[STEP - 1 :: STEP])).cast("array<bigint>")) * STEP
    return coarse + at_most(F.slice(F.array(*map(F.lit, cuts)).cast("array<bigint>"), coarse + 1, F.lit(STEP)))


def positions(lengths: DataFrame, key: str = "token_len", *, descending: bool = True, stripe: int = STRIPE) -> DataFrame:
    """The rows with pos, from 0 in order of key and then idx.

    Ranks are counted in three steps: within stripes of idx for each value of the key, over the stripes of a value, and over the values. Only
    the last one is a single task, of one row for each distinct value, so no task orders the table and one frequent length is spread over its stripes.
    """
    rows = lengths.withColumn("__stripe", _stripes(lengths, stripe))
    counts = rows.groupBy(key, "__stripe").agg(F.count("*").alias("__n"))
    order = F.desc(key) if descending else F.asc(key)
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each value
    values = counts.groupBy(key).agg(F.sum("__n").alias("__n")).select(key, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__first"))
    before = Window.partitionBy(key).orderBy("__stripe").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, "__stripe", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")).join(values, key)
    within = Window.partitionBy(key, "__stripe").orderBy("idx")
    ranked = rows.withColumn("__own", F.row_number().over(within) - 1).join(bases, [key, "__stripe"])
    return ranked.withColumn("pos", (F.col("__first") + F.col("__base") + F.col("__own")).cast("bigint")).drop("__stripe", "__base", "__own", "__first")


def fixed_batches(ranked: DataFrame, batch_size: int) -> DataFrame:
    """The rows with batch_id and slot: batch_size neighbours in pos."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return ranked.withColumns({"batch_id": F.floor(F.col("pos") / batch_size).cast("bigint"), "slot": (F.col("pos") % batch_size).cast("bigint")})


def static_plan(lengths: DataFrame, batch_size: int) -> DataFrame:
    """(batch_id, slot, idx): longest first, ties in input order."""
    return fixed_batches(positions(lengths), batch_size).select("batch_id", "slot", "idx")


def bucket_plan(lengths: DataFrame, batch_size: int) -> DataFrame:
    """(batch_id, slot, idx): shortest text first by characters."""
    return fixed_batches(positions(lengths, "char_len", descending=False), batch_size).select("batch_id", "slot", "idx")


def normal_plan(lengths: DataFrame, batch_size: int) -> DataFrame:
    """(batch_id, slot, idx): input order."""
    return fixed_batches(positions(lengths.withColumn("__all", F.lit(0)), "__all"), batch_size).select("batch_id", "slot", "idx")


def batch_totals(plan: DataFrame, lengths: DataFrame) -> DataFrame:
    """(batch_id, n, token_sum, token_max, padding) of each batch."""
    rows = plan.join(lengths.select("idx", "token_len"), "idx")
    out = rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("token_len").alias("token_sum"), F.max("token_len").alias("token_max"))
    return out.withColumn("padding", F.col("n") * F.col("token_max") - F.col("token_sum"))


def padding_totals(plan: DataFrame, lengths: DataFrame, name: str) -> DataFrame:
    """One row: (strategy, batches, area, used, padding)."""
    totals = batch_totals(plan, lengths)
    zero = F.lit(0).cast("bigint")
    return totals.agg(F.lit(name).alias("strategy"), F.count("*").alias("batches"), F.coalesce(F.sum(F.col("n") * F.col("token_max")), zero).alias("area"), F.coalesce(F.sum("token_sum"), zero).alias("used"), F.coalesce(F.sum("padding"), zero).alias("padding"))


def sample_order(id_col: str, seed: int) -> Column:
    """A seeded order of ids that any engine can repeat: the hex MD5 of seed:id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_rows(corpus: DataFrame, n: int, seed: int = 21, *, id_col: str = "doc_id") -> DataFrame:
    """Exactly n rows (or all), by a seeded hash of the id: the same rows on any cluster."""
    return corpus.orderBy(sample_order(id_col, seed), id_col).limit(n)


def sample_ordinals(ranked: DataFrame, n: int, seed: int = 21) -> DataFrame:
    """(pos) of exactly n of the rows (or all), ascending."""
    return sample_rows(ranked.select("pos"), n, seed, id_col="pos").orderBy("pos")


def positional_slice(ranked: DataFrame, first: int, length: int) -> DataFrame:
    """The rows at `length` places from `first`, fewer at the end."""
    if first < 0 or length < 0:
        raise ValueError("a slice needs a place and a length of 0 or more")
    return ranked.where(F.col("pos").between(first, first + length - 1))
