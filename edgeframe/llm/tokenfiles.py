"""Token-id files: texts to ids, ids to range-coded groups in Parquet, and back.

Documents are dealt by ranges of doc_id (one shuffle of the texts, no global sort), encoded where
they land, and written as groups of about a million ids. A group holds whole documents and is
readable alone: shared frequency table, blocks with checkpoints and checksums, document index. The
place of a document in the whole stream is the sum of the shards before it (one row a shard) plus
its place in its shard, which the writer knows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ans, bpecount
from . import textscan as ts

GROUP = 1 << 20
SCHEMA = "shard long, part long, local_start long, n_ids long, doc_ids array<long>, lengths array<long>, freq binary, blocks array<binary>"
_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("freq", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def pack_group(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The packed table and the blocks of one or more ids."""
    table = ans.Table.of(ids)
    return table.pack(), [ans.encode(ids[i : i + ans.BLOCK], table) for i in range(0, len(ids), ans.BLOCK)]


def unpack_group(freq: bytes, blocks: list[bytes]) -> np.ndarray:
    table = ans.Table.unpack(freq)
    return np.concatenate([ans.decode(b, table) for b in blocks])


def _writer(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = bpecount.load_encoder(path), TaskContext.get().partitionId()
        part = start = held = 0
        docs: list[int | None] = []
        sizes: list[int] = []
        raw: list[bytes] = []

        def flush():
            nonlocal part, start, held
            freq, blocks = pack_group(np.frombuffer(b"".join(raw), "<u4"))
            row = {"shard": shard, "part": part, "local_start": start, "n_ids": held, "doc_ids": list(docs), "lengths": list(sizes), "freq": freq, "blocks": blocks}
            part, start, held = part + 1, start + held, 0
            docs.clear(), sizes.clear(), raw.clear()
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                if docs and held + n > GROUP:
                    yield flush()
                docs.append(doc), sizes.append(n), raw.append(ids)
                held += n
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) into token files under ``path``, ascending doc_id.

    Null text counts as empty (its only id is the end id). Null doc_ids come first, repeated ones in
    the order of their texts. Other columns are ignored; an empty table writes no group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ts.each_batch(dealt, _writer(tokenizer, end_id), SCHEMA, keep=True).write.option("compression", "none").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            ids = unpack_group(row["freq"], row["blocks"]).astype("<u4")
            stop = np.cumsum(row["lengths"])
            if stop[-1] != len(ids):
                raise ValueError("a group's index and ids differ")
            first = stop - row["lengths"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
            n = len(stop)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["shard"])), pa.array(first + row["local_start"]), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            ids = unpack_group(row["freq"], row["blocks"])
            at = np.concatenate(([0], np.cumsum(row["lengths"]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>, end id included) of every document in the files."""
    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(_ids, "doc_id long, ids array<int>")


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard: as many as the write had partitions
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = files.mapInArrow(_reader, "doc_id long, shard long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
