"""Statistics of batches and of candidate batches at positions of the length order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchplan.functions.sizes import candidate_grid

#: Ratio columns: candidate over baseline.
RATIOS = ("batch_size", "token_max", "token_mean", "token_sum", "word_max", "word_mean", "word_sum", "char_sum")


def statistic(column: str, name: str) -> Column:
    """mean, std (population), sum, max, min, median or mode (the lowest of the most frequent)."""
    return {"mean": F.avg(column), "std": F.stddev_pop(column), "sum": F.sum(column), "max": F.max(column), "min": F.min(column), "median": F.percentile(column, F.lit(0.5)), "mode": F.array_min(F.expr(f"array(mode() within group (order by {column}))"))}[name].alias(f"{column}_{name}")


def batch_statistics(plan: DataFrame, lengths: DataFrame, names: tuple[str, ...] = ("mean", "std", "sum", "max"), columns: tuple[str, ...] = ("token_len",)) -> DataFrame:
    rows = plan.join(lengths.select("idx", *columns), "idx")
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), *(statistic(c, s) for c in columns for s in names))


def baseline_features(ranked: DataFrame, batch_size: int) -> DataFrame:
    """One row over the first batch_size positions; the size is the configured one even if there are fewer rows."""
    first = ranked.where(F.col("pos") < batch_size)
    stats = [f(f"{k}_len").alias(f"{k}_{s}_x") for k in ("token", "word") for s, f in (("mean", F.avg), ("sum", F.sum), ("max", F.max))]
    return first.agg(F.lit(batch_size).cast("bigint").alias("batch_size_x"), *stats, F.sum("char_len").alias("char_sum_x"))


def candidate_features(ranked: DataFrame, grid: list[int], every: int = 1) -> DataFrame:
    """For each position (a multiple of `every`) and candidate size the statistics of the rows from there, fewer at the end.

    Frames look only as far ahead as the largest candidate. Positions are cut into blocks and each block gets that many rows of the
    next one besides its own, so blocks are independent tasks. batch_size_y stays the candidate's, also where rows are fewer.
    """
    ahead, block = max(grid), max(4096, 4 * max(grid))
    own = ranked.withColumn("__block", F.floor(F.col("pos") / block))
    near = own.where((F.col("pos") % block < ahead) & (F.col("__block") > 0)).withColumn("__block", F.col("__block") - 1)
    rows = own.withColumn("__own", F.lit(True)).unionByName(near.withColumn("__own", F.lit(False)))
    order = Window.partitionBy("__block").orderBy("pos")

    def frame(c: int) -> Column:
        w = order.rowsBetween(0, c - 1)
        mean = F.avg("token_len").over(w)
        variance = F.avg(F.col("token_len") * F.col("token_len")).over(w) - mean * mean
        return F.struct(
            F.lit(c).cast("bigint").alias("batch_size_y"),
            mean.alias("token_mean_y"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("token_std_y"),
            F.sum("token_len").over(w).alias("token_sum_y"),
            F.max("token_len").over(w).alias("token_max_y"),
            F.avg("word_len").over(w).alias("word_mean_y"),
            F.sum("word_len").over(w).alias("word_sum_y"),
            F.max("word_len").over(w).alias("word_max_y"),
            F.sum("char_len").over(w).alias("char_sum_y"),
        )

    framed = rows.select("pos", "__own", F.array(*(frame(c) for c in grid)).alias("f")).where(F.col("__own") & (F.col("pos") % every == 0))
    return framed.select("pos", F.explode("f").alias("f")).select("pos", "f.*")


def ratio_features(features: DataFrame, baseline: DataFrame) -> DataFrame:
    """The features with the baseline and the ratio columns; over a baseline of 0 a ratio is 0."""
    rows = features.join(F.broadcast(baseline))  # one row
    return rows.withColumns({f"{r}_diff": F.coalesce(F.try_divide(F.col(f"{r}_y").cast("double"), F.col(f"{r}_x").cast("double")), F.lit(0.0)) for r in RATIOS})


def pressure(model: str) -> Column:
    """Predicted memory pressure of a ratio row relative to the first batch."""
    if model == "token_sum":
        return F.col("token_sum_diff")
    if model == "padded_area":
        return F.coalesce(F.try_divide((F.col("batch_size_y") * F.col("token_max_y")).cast("double"), (F.col("batch_size_x") * F.col("token_max_x")).cast("double")), F.lit(0.0))
    if model.startswith("constant:"):
        return F.lit(float(model.split(":")[1]))
    raise ValueError(f"unknown pressure model {model!r}")


def optimal_sizes(ratios: DataFrame, batch_size: int, threshold: float = 0.9, model: str = "token_sum") -> DataFrame:
    """(pos, size): the largest candidate whose pressure is within the threshold, else batch_size."""
    passing = F.max(F.when(pressure(model) <= threshold, F.col("batch_size_y")))
    return ratios.groupBy("pos").agg(F.coalesce(passing, F.lit(batch_size).cast("bigint")).alias("size"))


def grid_frame(spark, batch_size: int, max_range: float) -> DataFrame:
    return spark.createDataFrame([(c,) for c in candidate_grid(batch_size, max_range)], "size bigint")


def all_ratios(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each pair c_y, c_x gets c_diff; null, NaN and division by zero give 0."""
    return reduce(lambda f, c: f.withColumn(f"{c}_diff", F.coalesce(F.nanvl(F.try_divide(F.col(f"{c}_y").cast("double"), F.col(f"{c}_x").cast("double")), F.lit(0.0)), F.lit(0.0))), columns, frame)
