"""Building, fitting and judging a model of memory pressure from a log of measured batches."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchplan.operators.plans import positions, sample_order

#: The features that the model is fitted on.
FEATURES = ("batch_size_diff", "token_sum_diff", "token_mean_diff", "token_max_diff", "word_sum_diff", "word_mean_diff", "word_max_diff", "char_sum_diff", "token_std_y", "batch_size_x")
STATS = ("mean", "std", "sum", "max", "min", "median", "mode")


def run_groups(log: DataFrame, *, file: str = "file", order: str = "ordinal", size: str = "size") -> DataFrame:
    """The log with batch_group: a size s > 0 makes the next s rows of its run one group, a size of 0 one failed row.

    Rows of one file in order; a run is a stretch of equal sizes. Groups are numbered within the file, a failed row has the number of
    the next group.
    """
    w = Window.partitionBy(file).orderBy(order)
    rows = log.withColumn("__new", F.coalesce((F.col(size) != F.lag(size).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy(file, "__run").orderBy(order)) - 1)
    starts = F.when(F.col(size) > 0, (F.col("__in") % F.col(size) == 0).cast("int")).otherwise(0)
    rows = rows.withColumn("__group", F.sum(starts).over(w))
    name = F.when(F.col(size) > 0, F.concat_ws("_", file, (F.col("__group") - 1).cast("string"))).otherwise(F.concat_ws("_", file, F.col("__group").cast("string"), F.lit("Failed")))
    return rows.withColumn("batch_group", name).drop("__new", "__run", "__in", "__group")


def _stat(column: Column, stat: str) -> Column:
    return {"mean": F.avg(column), "std": F.stddev_samp(column), "sum": F.sum(column), "max": F.max(column), "min": F.min(column), "median": F.percentile(column, F.lit(0.5)).cast("bigint"), "mode": F.mode(column, True)}[stat]


def group_statistics(log: DataFrame, *, file: str = "file", columns: tuple[str, ...] = ("token", "word", "char"), first: str = "is_first", stats: tuple[str, ...] = STATS) -> DataFrame:
    """The log with, for each column, the statistics of its batch_group (_y, sample deviation) and of the file's first group (_x) on every row.

    The groups are aggregated and joined back, so no row waits for a window over a whole file.
    """
    per_group = log.groupBy("batch_group").agg(*(_stat(F.col(f"{c}_length"), s).alias(f"{c}_{s}_y") for c in columns for s in stats))
    per_file = log.groupBy(file).agg(*(_stat(F.when(F.col(first), F.col(f"{c}_length")), s).alias(f"{c}_{s}_x") for c in columns for s in stats))
    return log.join(per_group, "batch_group").join(per_file, file)


def first_group_lengths(log: DataFrame, *, file: str = "file", order: str = "ordinal", first: str = "is_first") -> DataFrame:
    """Word and char lengths of every row of the first group replaced by its first row's, as the offline features have them."""
    heads = log.where(first).groupBy(file).agg(F.min_by("word_length", order).alias("__w"), F.min_by("char_length", order).alias("__c"))
    rows = log.join(heads, file, "left")
    return rows.withColumns({"word_length": F.when(F.col(first), F.col("__w")).otherwise(F.col("word_length")), "char_length": F.when(F.col(first), F.col("__c")).otherwise(F.col("char_length"))}).drop("__w", "__c")


def clean_numbers(frame: DataFrame, infinite: tuple[str, ...] = ()) -> DataFrame:
    """NaN and null become 0 in every number, infinities only in the named columns."""
    out = {}
    for name, kind in frame.dtypes:
        if kind in ("double", "float"):
            c = F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
            out[name] = F.when(F.abs(c) == float("inf"), 0.0).otherwise(c) if name in infinite else c
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            out[name] = F.coalesce(F.col(name), F.lit(0).cast(kind))
    return frame.withColumns(out)


def check_numbers(frame: DataFrame, columns: tuple[str, ...]) -> None:
    """An error if a column holds a null, NaN or infinity; one pass for all of them."""
    bad = frame.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns)).first()
    found = {c: bad[c] for c in columns if bad[c]}
    if found:
        raise ValueError(f"rows without a finite number: {found}")


def dedup_first(frame: DataFrame, subset: list[str], order: str) -> DataFrame:
    """The first row in order of each combination of the subset."""
    w = Window.partitionBy(*subset).orderBy(order)
    return frame.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def true_first_batch(log: DataFrame, same: dict[str, str]) -> DataFrame:
    """The rows of the batch that ran first: those in which each column is equal to the one that holds the first batch's value."""
    return log.where(reduce(lambda a, b: a & b, (F.col(c) == F.col(first) for c, first in same.items())))


def uniform_groups(frame: DataFrame, group: str, column: str) -> DataFrame:
    """(group, uniform): whether the column has one value in all of the group's rows; a null is none."""
    return frame.groupBy(group).agg((F.count_distinct(column) == 1).alias("uniform"))


def threshold_shares(frame: DataFrame, column: str, threshold: float) -> DataFrame:
    """One row: rows up to the threshold and beyond it, and their shares, null for an empty table."""
    out = frame.agg(F.count_if(F.col(column) <= threshold).alias("n_low"), F.count_if(F.col(column) > threshold).alias("n_high"))
    total = F.nullif(F.col("n_low") + F.col("n_high"), F.lit(0))
    return out.withColumns({"share_low": F.col("n_low") / total, "share_high": F.col("n_high") / total})


def speedups(timings: DataFrame, baseline: str, *, name: str = "strategy", cost: str = "seconds") -> DataFrame:
    """(name, speedup): the baseline's cost over each one's, summed over rows; null where there is no baseline or nothing was spent."""
    totals = timings.groupBy(name).agg(F.sum(cost).cast("double").alias("__cost"))
    base = totals.where(F.col(name) == baseline).agg(F.max("__cost").alias("__base"))  # one row
    return totals.join(F.broadcast(base)).select(name, (F.col("__base") / F.nullif(F.col("__cost"), F.lit(0.0))).alias("speedup"))


def train_validation(frame: DataFrame, share: float = 0.1, *, id_col: str = "doc_id", seed: int = 21) -> DataFrame:
    """The frame with is_validation, by the first 16 bits of a seeded hash of the id: no shuffle, the share holds about."""
    return frame.withColumn("is_validation", F.substring(sample_order(id_col, seed), 1, 4) < F.lit(f"{round(share * 65536):04x}"))


def range_weight(target: Column, ranges: list[tuple[float, float, float]], default: float = 1.0) -> Column:
    """The weight of the first half-open range [lo, hi) that holds the target."""
    weight = F.lit(default)
    for lo, hi, w in reversed(ranges):
        weight = F.when((target >= lo) & (target < hi), F.lit(w)).otherwise(weight)
    return weight


def cut(value: Column, breaks: list[float], labels: list[str]) -> Column:
    """Right-closed buckets: labels[i] up to and with breaks[i], the last label beyond."""
    out = None  # one flat CASE, as nested ones of hundreds of breaks are too deep
    for b, label in zip(breaks, labels, strict=False):
        out = (F if out is None else out).when(value <= b, F.lit(label))
    return F.lit(labels[-1]) if out is None else out.otherwise(F.lit(labels[-1]))


def adaptive_breaks(frame: DataFrame, target: str, most: int = 1500) -> list[float]:
    """Upper bounds of buckets: each one with `most` rows or more is halved, until none is left but those of a single value.

    The data are aggregated once to counts of values rounded up to 5 digits, which fall into the same buckets; the bisecting works on those.
    """
    near = F.round(F.col(target).cast("double") * 1e5)
    step = (near + F.when(F.col(target) > near / 1e5, 1).otherwise(0)).cast("long")
    counts = {r.v / 1e5: r.n for r in frame.where(F.col(target).isNotNull()).groupBy(step.alias("v")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    values = sorted(counts)
    rows = [0, *accumulate(counts[v] for v in values)]
    breaks = sorted({round(values[0], 4), round(values[-1], 4) + 1e-4})
    todo = list(zip([round(values[0] - 1e-5, 5), *breaks], breaks, strict=False))
    while todo:
        low, high = todo.pop()
        first, end = bisect_right(values, low), bisect_right(values, high)
        middle = round((low + high) / 2, 5)
        if rows[end] - rows[first] < most or end - first < 2 or not low < middle < high:
            continue
        breaks.append(middle)
        todo += [(low, middle), (middle, high)]
    return sorted(breaks)


def stratified_split(frame: DataFrame, strata: list[str], id_col: str, share: float = 0.1, seed: int = 21) -> DataFrame:
    """The frame with is_test: of each stratum the floor of its share, by a seeded hash of the id."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    counts = frame.groupBy(*strata).agg(F.count("*").alias("__n"))
    rows = frame.withColumn("__k", F.row_number().over(w)).join(counts, strata)
    return rows.withColumn("is_test", F.col("__k") <= F.floor(F.col("__n") * share)).drop("__k", "__n")


def regression_metrics(frame: DataFrame, actual: str, predicted: str, region: tuple[float, float] | None = None) -> DataFrame:
    """One row: n, rmse, r2, mae, mape and safe, the share of rows that are not predicted within 1 while beyond it; of a closed range of the actual, if given.

    Rows whose actual is 0 have no share in mape; without rows or variance a figure is null.
    """
    rows = frame.where(F.col(actual).between(*region)) if region else frame
    y, p = F.col(actual), F.col(predicted)
    return rows.agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*"))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.abs(F.try_divide(y - p, y))).alias("mape"),
        (1 - F.try_divide(F.count_if((y > 1) & (p <= 1)), F.count("*"))).alias("safe"),
    )


def augment(lines: DataFrame, bands: list[tuple[int, int, int]], seed: int = 21) -> DataFrame:
    """(band, row, text): for each band (low, high, rows) texts joined from hash-chosen lines until they have `low` words at least, cut at `high`.

    lines: (line_no from 0, text). How many lines can be needed is bounded by low, as every line that counts has a word.
    """
    spark = lines.sparkSession
    words = lines.where(F.trim("text") != "").withColumn("w", F.split(F.trim("text"), r"\s+"))
    n = words.count()
    if not n:
        return spark.createDataFrame([], "band int, row int, text string")
    numbered = positions(words.select(F.col("line_no").alias("idx"), "w", F.lit(0).alias("all")), "all").select(F.col("pos").alias("k"), "w")
    wanted = spark.createDataFrame([(b, low, high, rows) for b, (low, high, rows) in enumerate(bands)], "band int, low int, high int, rows int")
    picks = wanted.select("band", "low", "high", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select("*", F.posexplode(F.sequence(F.lit(1), F.greatest("low", F.lit(1)))).alias("at", "__")).drop("__")
    picks = picks.withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "band", "row", "at"), F.lit(n)))
    made = picks.join(numbered, "k").groupBy("band", "row", "low", "high").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("parts"))
    grown = F.aggregate("parts", F.array().cast("array<string>"), lambda a, p: F.when(F.size(a) >= F.col("low"), a).otherwise(F.concat(a, p.w)))
    return made.select("band", "row", F.array_join(F.slice(grown, F.lit(1), F.col("high")), " ").alias("text"))


def prompt(text: Column, source: str, target: str) -> Column:
    """A translation prompt around a text."""
    return F.concat(F.lit(f"Translate this from {source} to {target}:\n{source}: "), text, F.lit(f"\n{target}:"))


def config_grid(spark: SparkSession, batches: list[int], lengths: list[int]) -> DataFrame:
    """(start_batch, max_input_length, explore): every combination, with and without exploration; a driver-side list."""
    return spark.createDataFrame([(b, m, e) for b in batches for m in lengths for e in (False, True)], "start_batch bigint, max_input_length bigint, explore boolean")


def simulated_log(totals: DataFrame, noise: float = 0.02) -> DataFrame:
    """Batch totals with a simulated memory peak: weights, an attention term in the width and hash noise. It is not a measurement."""
    wobble = (F.pmod(F.xxhash64("batch_id"), F.lit(1000)) / 1000.0 - 0.5) * 2 * noise
    area = F.col("n") * F.col("token_max")
    return totals.withColumn("gpu_memory_usage", (1000 + 0.05 * area + 0.0001 * area * F.col("token_max")) * (1 + wobble))


def fit_pressure(frame: DataFrame, features: list[str], target: str, *, weight: str | None = None, depth: int = 4, trees: int = 20, seed: int = 21):
    """A gradient-boosted regressor pipeline on the features; save it with .write(), load it with PipelineModel.load."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="predicted", maxDepth=depth, maxIter=trees, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(frame)


def replay(runs: dict[str, DataFrame]) -> DataFrame:
    """The feature frames of several runs in one, with the run's name."""
    return reduce(DataFrame.unionByName, [f.withColumn("run", F.lit(name)) for name, f in runs.items()])
