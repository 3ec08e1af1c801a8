"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. quality classifier: documents over their language's perplexity threshold, or without text, go;
2. n-gram Jaccard join: of the documents that near-duplicate links connect one stays, the one of smallest key;
3. benchmark decontamination: documents in which a window of a benchmark item occurs go;
4. personal data: spans are replaced in the text by their kind, disclosing terms removed or generalised;
5. best-fit packing: what is left, as pieces of token sequences.

Verdicts meet their rows by a key, the hash of id and text: rows of one id with other texts are judged apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchplan.llm.decontaminate import decontaminate
from batchplan.llm.jaccard_join import jaccard_components
from batchplan.llm.packing import pack
from batchplan.llm.pii import sanitise
from batchplan.llm.quality_lm import quality_classifier
from batchplan.llm.spark_io import settled, shared_dir, unused, written
from batchplan.llm.tokens import vocabulary

#: Stages on word shingles take five words and a similarity of 0.8 or more.
WIDTH, SIMILAR = 5, (80, 100)
#: Keys of rejected documents (8 bytes each).
MOST_BROADCAST = 2_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their key, and the key's name, which no column of theirs has."""
    key = unused(docs.columns, "__key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def _without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The documents whose key is not rejected. Keys are sent to every task up to MOST_BROADCAST, beyond it the text is shuffled."""
    keys = settled(rejected.select(key).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier rejects or that have no text; repeated rows share a verdict. No trusted labels: what has text stays."""
    docs, key = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    trusted = docs.select(key, "doc_id").join(labels, "doc_id", "left_semi").select(key)
    return _without(docs, quality_classifier(docs, trusted, id_col=key).where("not kept"), key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of smallest key; of equal rows one. Documents without words are linked with nothing and stay."""
    docs, key = _keyed(docs)
    groups = written(jaccard_components(docs, WIDTH, *SIMILAR, id_col=key))
    if not groups.groupBy(key).count().where("count > 1").isEmpty():  # equal rows
        docs = docs.dropDuplicates([key])
    return _without(docs, groups.where(F.col(key) != F.col("component_id")), key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a window of a benchmark item occurs; null texts have none."""
    docs, key = _keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate(docs, items, width=10, id_col=key).where("contaminated"), key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", packing),
]
#: Perplexities, similarity components and packing have no SQL form here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each but the last is written to the cluster's shared folder and read again.

    An empty table passes through as empty; null texts go in the first stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
