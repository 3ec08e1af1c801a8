"""Plans over streams: each micro-batch is planned on its own, as an order over all rows is only known for a bounded set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from batchplan.operators.dynamic import PlanConfig, dynamic_plan
from batchplan.operators.lengths import whitespace_lengths


def plan_stream(stream: DataFrame, path: str, checkpoint: str, config: PlanConfig = PlanConfig(), *, max_length: int = 512, id_col: str = "doc_id", text_col: str = "text", plan_key: str | None = None, ready: Callable | None = None) -> StreamingQuery:
    """Write (epoch, plan_key, batch_id, slot, idx) of each micro-batch as Parquet below path.

    A micro-batch that is run again overwrites its own partition, so each is planned once in the result.
    """

    def one(rows: DataFrame, number: int) -> None:
        lengths = whitespace_lengths(rows, max_length, id_col=id_col, text_col=text_col, keep=(plan_key,) if plan_key else ())
        dynamic_plan(lengths, config, plan_key).write.mode("overwrite").parquet(f"{path}/epoch={number}")
        if ready:
            ready(number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def length_profile(stream: DataFrame, time_col: str, text_col: str, *, width: str = "10 minutes", late: str = "10 minutes", max_length: int = 512) -> DataFrame:
    """(window, token_len, n) of a stream with late rows: the histogram that a plan's sizes depend on."""
    tokens = F.least(F.size(F.array_remove(F.split(F.coalesce(text_col, F.lit("")), r"[ \t\n\r\f]+"), "")), F.lit(max_length)).cast("bigint")
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("window"), tokens.alias("token_len")).agg(F.count("*").alias("n"))
