"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout of a store: `shard-00000.bin` holds the ids of one stretch of documents in ascending order, nothing else, as
little-endian unsigned integers of `width` bytes; `shard-00000.idx` holds, as little-endian unsigned 64-bit integers, how
many ids of the shard stand before each document and finally their total, then one signed 64-bit id for each document;
`manifest.json` lists the shards in order with their documents, ids and the ids before them in the store.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchplan.llm.spark_io import freeing, shared_dir
from batchplan.llm.tokens import encoder, in_blocks


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(uri))


def _put(store: fs.FileSystem, path: str, data) -> None:
    """A whole file or none: a repeated or twin attempt of a task writes the same bytes and moves them in place."""
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for part in data:
            out.write(part)
    store.move(own, path)


def write_token_store(docs: DataFrame, vocabulary_path: str, end_id: int, uri: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, shards: int | None = None) -> tuple[str, list[dict]]:
    """Encode every text, append end_id, write the store; returns its place and the manifest's shards.

    Documents stand in ascending order of id; rows of equal id in order of a hash of their text, so that any run gives the
    same files. Null text is an empty document: its end id alone. Rows of null id stand first. An empty table gives a store
    without ids. The text is range-dealt by (id, text hash) before it is encoded, so one repeated id does not fill one
    task unless its rows are equal, and ids are never shuffled. Only one line for each shard goes to the driver.
    """
    spark = docs.sparkSession
    uri = uri or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = shards or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").drop("h")
    if width is None:
        width = 2 if max(encoder(vocabulary_path).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, (store, top) = encoder(vocabulary_path), _store(uri)
        store.create_dir(top, recursive=True)
        counts, ids, total, name = [], [], 0, f"{top}/shard-{shard:05d}"

        def encoded():
            nonlocal total
            for b in batches:
                own, texts = b.column(0), b.column(1).to_pylist()
                ids.append(own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
                for first, end in in_blocks(texts):
                    flat, n = enc.encode_many(texts[first:end])
                    counts.append(n + 1)
                    total += len(flat) + len(n)
                    yield np.insert(flat, np.cumsum(n), end_id).astype(f"<u{width}").tobytes()

        _put(store, f"{name}.bin", encoded())
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        if not len(n):
            store.delete_file(f"{name}.bin")
            return
        _put(store, f"{name}.idx", [np.concatenate(([0], np.cumsum(n))).astype("<u8").tobytes(), np.concatenate(ids).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(n)], "n_ids": [total]}, pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    lines, base = [], 0
    for r in sorted(rows.mapInArrow(freeing(write, hands_on=True), "shard int, n_docs long, n_ids long").collect()):
        lines.append({"shard": r.shard, "n_docs": r.n_docs, "n_ids": r.n_ids, "base": base})
        base += r.n_ids
    store, top = _store(uri)
    store.create_dir(top, recursive=True)
    _put(store, f"{top}/manifest.json", [json.dumps({"width": width, "shards": lines}).encode()])
    return uri, lines


def read_manifest(uri: str) -> dict:
    store, top = _store(uri)
    with store.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file's numbers, memory-mapped where the store is a local or mounted folder."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_store(spark: SparkSession, uri: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document of a store.

    start: ids of all documents before it; ids_crc32: of its ids as unsigned 32-bit little-endian integers. A store without
    documents gives an empty result. One task for each shard; a document is read through the mapping, a shard is never
    held as a whole.
    """
    m = read_manifest(uri)
    width, lines = m["width"], m["shards"]
    kind = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    shards = spark.createDataFrame([(x["shard"], x["base"]) for x in lines], "shard int, base long")
    if lines:
        shards = shards.repartitionByRange(len(lines), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(uri)
        for b in batches:
            for shard, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = f"{top}/shard-{shard:05d}"
                flat, index = _mapped(store, f"{name}.bin", f"<u{width}"), _mapped(store, f"{name}.idx", "<i8")
                n = (len(index) - 1) // 2
                offsets, ids = index[: n + 1], index[n + 1 :]
                for at in range(0, n, 4096):
                    end = min(n, at + 4096)
                    span = [(int(a), int(e)) for a, e in zip(offsets[at:end], offsets[at + 1 : end + 1], strict=True)]
                    out = [
                        pa.array([None if i == np.iinfo(np.int64).min else int(i) for i in ids[at:end]], pa.int64()),
                        pa.array([base + a for a, _ in span], pa.int64()),
                        pa.array([e - a for a, e in span], pa.int64()),
                        pa.array([zlib.crc32(flat[a:e].astype("<u4").tobytes()) for a, e in span], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([flat[a:e].astype(np.int64) for a, e in span], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return shards.mapInArrow(freeing(read), kind).withColumnRenamed("id", id_col)
