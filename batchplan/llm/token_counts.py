"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that are a single pre-token and come out as one token
are proven whole. While counting, a pre-token among them counts one without any merging, and only the rest is
merged (once for each distinct one in a worker). One narrow pass over the text, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchplan.llm.spark_io import freeing
from batchplan.llm.tokens import encoder


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each input row.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows; other columns are not read, whatever
    their names; an empty table gives an empty result. Texts of any length are counted whole.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(freeing(count, hands_on=True), f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
