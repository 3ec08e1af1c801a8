"""Scans and sinks: corpora of text lines, Parquet logs with their file's name, partitioned logs that are not written twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType(
    [T.StructField("texts", T.StringType()), T.StructField("token_length", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("start_batch", "max_input_length")]
    + [T.StructField("gpu_memory_usage", T.DoubleType())]
    + [T.StructField(n, T.LongType()) for n in ("total_tokens", "total_paddings", "inference_batch_size", "top_token_size", "first_total_tokens", "first_total_paddings")]
    + [T.StructField("first_gpu_memory_peak_usage", T.DoubleType()), T.StructField("first_batch_size", T.LongType()), T.StructField("first_top_token_size", T.LongType()), T.StructField("model_name", T.StringType())]
)


def texts(spark: SparkSession, items: list[str]) -> DataFrame:
    """(idx, text) of a list; idx is the place in it."""
    return spark.createDataFrame(list(enumerate(items)), "idx bigint, text string")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    """(idx, text) of a table of texts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(id_col).alias("idx"), "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text): the stripped, non-blank lines of text files, numbered in order of file and place."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("text", F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).where("text <> ''")
    before = Window.orderBy("f", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a file
    bases = rows.groupBy("f", "part").agg(F.count("*").alias("n")).select("f", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("f", "part").orderBy("at")) - 1)
    return own.join(bases, ["f", "part"]).select((F.col("base") + F.col("own")).alias("line_no"), "text")


def measurement_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet log below a folder, with the column file."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0))


def write_log(log: DataFrame, path: str) -> None:
    """A log partitioned by its configuration; of configurations that the place holds already nothing is written."""
    keys = ["model_name", "start_batch", "max_input_length"]
    try:
        there = log.sparkSession.read.parquet(path).select(*(F.col(k).cast(log.schema[k].dataType) for k in keys)).distinct()
        log = log.join(there, keys, "left_anti")
    except AnalysisException:  # nothing is there
        pass
    log.write.mode("append").partitionBy(*keys).parquet(path)
