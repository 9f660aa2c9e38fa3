"""Documents to token-id shards (see frames.py) and back.

Documents are dealt to shards by ranges of the id, so shards and the documents in them ascend by id; one manifest row
for each shard tells its place, documents and tokens.  Starts of documents are sums over manifest rows before the
shard and over documents before it in the shard: no global sort of tokens, no pass over a single task.

Cases: a null text counts as empty and still gets the end id; repeated ids stay side by side in the order of their
texts; a null id comes first; an empty table gives one shard without documents or none; other columns, also such as
share a name with a result column, aren't read.  A very long text is one frame: it is held whole while it is encoded.
Strings of special tokens in a text are ordinary text, so no text can forge an end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import create, open_input
from .frames import ShardReader, ShardWriter
from .shared import materialise, n_partitions, new_dir, tasks_for, text_of
from .vocab import encoder

MANIFEST = "shard int, path string, docs long, tokens long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text: str = "text", width: int | None = None, shards: int | None = None) -> DataFrame:
    """Write every document and return the manifest (shard, path, docs, tokens), itself written beside the shards.

    width: bytes for a token; as the vocabulary needs, 2 or 4, if not given.
    """
    spark = docs.sparkSession
    at = path or new_dir(spark, "tokens")
    dealt = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    dealt = dealt.repartitionByRange(shards or tasks_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"{at}/shard-{shard:06d}.zst"
        end = np.array([end_id], dtype="<u4")
        with create(name) as out:
            w = ShardWriter(out, width or (2 if max(enc.size, end_id + 1) <= 1 << 16 else 4))
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w.add(i, np.concatenate([np.frombuffer(enc.encode(t), "<u4"), end]))
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "docs": pa.array([len(w.ids)], pa.int64()), "tokens": pa.array([sum(w.counts)], pa.int64())})

    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{at}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{at}/manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 (of little-endian uint32 ids).

    Each frame is found by the seek table, decompressed and held against its checksum.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with open_input(path) as f:
                    r = ShardReader(f)
                    starts = base + np.concatenate([[0], np.cumsum(r.counts, dtype=np.int64)])
                    crc = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in range(len(r.ids))]
                    yield pa.RecordBatch.from_arrays([pa.array(r.ids, pa.int64()), pa.array(starts[:-1]), pa.array(r.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("path", "base", "shard").repartition(n_partitions(spark), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of the documents named: in each shard only their frames are decompressed."""
    wanted = frozenset(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open_input(path) as f:
                    for i, x in ShardReader(f).find(wanted):
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([x.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return manifest.select("path").mapInArrow(read, "doc_id long, ids array<long>")


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces of at most `most` tokens, written to the shared folder: doc_id, piece, start, length, ids_crc32.

    A document that is too long is cut into pieces of `most` tokens, the first being what remains.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return materialise(picked.mapInArrow(_cutter(tokenizer, end_id, most), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")


def _cutter(tokenizer: str, end_id: int, most: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(t) + end
                n = len(ids) // 4
                edges = [0, *range(n % most or most, n + 1, most)] if n > most else [0, n]
                rows += [(i, p, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for p, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut
