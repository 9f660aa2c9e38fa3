"""Line dedup by sharded minimal perfect hashes.

1. Lines become 128-bit hashes of their keys.  Each batch sums them before anything moves; the sums go to shards by
   hash.  A shard's task merges its sums, builds a minimal perfect hash over its distinct line hashes, and writes it
   with arrays beside it: a 32-bit fingerprint, the number of documents, the largest id.
2. Documents probe the arrays: their line hashes (no text) are dealt to tasks by (shard, salt), a task opens the shards
   it has rows of, one at a time, and only lines to drop come back.
3. Those are gathered by document and the text is rewritten: where the document is, if the lists are few enough to go to
   all tasks (counted first), and beyond that by a join.

Lines are never joined with lines.  A line that a third of all documents hold is one row a batch in step 1; in step 2 a
shard has salts in line with its rows, and rows take them by their place, so copies of a document part too.

Cases: a null or empty text is one empty line; rows that repeat count as documents of their own, and rows with the
largest id all keep the line; a null id is smaller than all others; an empty table gives an empty result; other
columns pass through, and result columns replace input columns of the same name; a very long text is one row's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import create, open_input
from .perfect import PerfectHash, load, save
from .shared import FEW, LOWER, NULL_ID, WS, discard, materialise, new_dir, releasing, tasks_for, text_of

#: Groups of rows for each shard in the probe, on average; a shard with more rows has more.
SALTS = 4
#: Rows of sums held before they are merged.
HELD = 500_000
#: Rows whose texts are rewritten at once.
SLICE = 1024
_UPPER = re.compile("[A-Z]")
_SUMS = "shard int, a long, b long, n long, top long"
_PROBE = "shard int, salt int, a long, b long, doc_id long, row long, k int"


def line_key(line: str) -> str:
    return line.strip(WS).translate(LOWER)


def _keys(text: str, least: int) -> list[bytes]:
    """The distinct keys of a text that are long enough, in order of first appearance."""
    out: dict[str, None] = {}
    for line in text.split("\n"):
        if len(line) >= least and len(s := line.strip(WS)) >= least:
            out[s.translate(LOWER) if _UPPER.search(s) else s] = None
    return [k.encode() for k in out]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">u8").reshape(-1, 2).astype("u8")


def _batch(shards: int, columns: dict[str, np.ndarray], h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": (h[:, 0] % np.uint64(shards)).astype("i4")} | {k: pa.array(v) for k, v in columns.items()})


def _rows(b: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row number, ordinal in the row) of all keys of a batch whose text is column 1."""
    at, ks, row = [], [], []
    for r, t in enumerate(b.column(1).to_pylist()):
        if len(t) >= least:
            keys = _keys(t, least)
            at += keys
            row.append(np.full(len(keys), r))
            ks.append(np.arange(len(keys), dtype="i4"))
    if not at:
        return np.zeros((0, 2), "u8"), np.zeros(0, "i8"), np.zeros(0, "i4")
    return _hashes(at), np.concatenate(row), np.concatenate(ks)


def _merge(h: np.ndarray, n: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, n, top = h[order], n[order], top[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])) if len(h) else np.zeros(0, "i8")
    return h[first], np.add.reduceat(n, first) if len(first) else n, np.maximum.reduceat(top, first) if len(first) else top


def index_lines(docs: DataFrame, least: int = 40, shards: int | None = None) -> tuple[str, list[int]]:
    """Write the index of docs (doc_id long, text string, neither null) and return its folder and the salts of each shard."""
    spark = docs.sparkSession
    count = shards or tasks_for(docs)
    at = new_dir(spark, "line-index")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, row, _ = _rows(b, least)
            ids = b.column(0).to_numpy(zero_copy_only=False)[row]
            h, n, top = _merge(h, np.ones(len(h), "i8"), ids)
            yield _batch(count, {"a": h[:, 0].view("i8"), "b": h[:, 1].view("i8"), "n": n, "top": top}, h)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def merged(parts: list[tuple]) -> tuple:
            return _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        for batch in batches:
            col = {c: batch.column(c).to_numpy() for c in ("shard", "a", "b", "n", "top")}
            for s in np.unique(col["shard"]):
                at_s = np.flatnonzero(col["shard"] == s)
                held.setdefault(int(s), []).append((np.stack([col["a"][at_s].view("u8"), col["b"][at_s].view("u8")]).T, col["n"][at_s], col["top"][at_s]))
            size += batch.num_rows
            if size > HELD:  # what remains are distinct hashes
                held, size = {s: [merged(x)] for s, x in held.items()}, 0
        for s, parts in held.items():
            h, n, top = merged(parts)
            a, b = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
            mph = PerfectHash.build(a, b)
            order = np.empty(len(h), "i8")
            order[mph.find(a, b)] = np.arange(len(h))
            with create(f"{at}/{s:06d}.npz") as out:
                out.write(save(mph, mark=(b[order] & np.uint64(0xFFFFFFFF)).astype("u4"), count=np.minimum(n[order], 0xFFFFFFFF).astype("u4"), top=top[order]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "keys": pa.array([len(h)], pa.int64()), "rows": pa.array([int(n.sum())], pa.int64())})

    docs.mapInArrow(releasing(sums), _SUMS).repartition(count, "shard").mapInArrow(releasing(build), "shard int, keys long, rows long").write.parquet(f"{at}/manifest")
    rows = {r["shard"]: r["rows"] for r in spark.read.schema("shard int, keys long, rows long").parquet(f"{at}/manifest").collect()}  # one for each shard
    mean = max(1.0, sum(rows.values()) / count)
    return at, [max(1, -(-SALTS * rows.get(s, 0) // int(mean))) for s in range(count)]


def probe_lines(docs: DataFrame, index: tuple[str, list[int]], least: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, drop): of docs (doc_id, text, row) those with lines to drop, as ordinals of their distinct keys."""
    at, salts = index[0], np.array(index[1], np.int64)
    count = len(salts)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, row, k = _rows(b, least)
            ids, key = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 2))
            salt = row % salts[(h[:, 0] % np.uint64(count)).astype(np.int64)]  # by place, so that copies part
            yield _batch(count, {"salt": salt.astype("i4"), "a": h[:, 0].view("i8"), "b": h[:, 1].view("i8"), "doc_id": ids, "row": key, "k": k}, h)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for b in batches:
            num = {c: b.column(c).to_numpy() for c in ("shard", "a", "b", "doc_id", "row", "k")}
            for s in np.unique(num["shard"]):
                if s != shard:
                    with open_input(f"{at}/{s:06d}.npz") as f:
                        held, shard = load(f.read()), s
                mph, x = held
                here = np.flatnonzero(num["shard"] == s)
                p, q = (np.ascontiguousarray(num[c][here]).view("u8") for c in ("a", "b"))
                i = mph.find(p, q)
                known = (i >= 0) & (x["mark"][i] == (q & np.uint64(0xFFFFFFFF)).astype("u4"))
                out = here[known & (x["count"][i] >= min_docs) & (x["top"][i] != num["doc_id"][here])]
                yield pa.RecordBatch.from_pydict({c: num[c][out] for c in ("doc_id", "row", "k")})

    hit = docs.mapInArrow(releasing(hashes), _PROBE).repartition(count, "shard", "salt").sortWithinPartitions("shard").mapInArrow(releasing(probe), "doc_id long, row long, k int")
    return hit.groupBy("doc_id", "row").agg(F.collect_set("k").alias("drop"))


def _without(text: str, drop: set[int], least: int) -> tuple[str, int]:
    keys: dict[str, int] = {}
    kept, lines = [], text.split("\n")
    for line in lines:
        if len(line) >= least and len(s := line_key(line)) >= least and keys.setdefault(s, len(keys)) in drop:
            continue
        kept.append(line)
    return "\n".join(kept), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 40, min_docs: int = 5, figures: bool = True) -> DataFrame:
    """docs with the text rewritten, and with figures also n_lines (before) and n_dropped.

    A line whose key (white space stripped at both ends, A-Z lower-cased) has at least `least` code points and is in
    at least `min_docs` documents stays only in the document of the largest id that holds it.
    """
    own = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(docs, text).alias("text"))
    own = own.withColumn("row", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)))
    index = index_lines(own.select("doc_id", "text"), least)
    hits = materialise(probe_lines(own, index, least, min_docs), "line-hits")
    discard(docs.sparkSession, index[0])
    keep = [c for c in docs.columns if not figures or c.lower() not in ("n_lines", "n_dropped")]
    full = docs.select(*[F.col(c) for c in keep], F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("__lf_id"), F.xxhash64(text_of(docs, text)).bitwiseAND(F.lit((1 << 63) - 1)).alias("__lf_row"))
    hit = hits.select(F.col("doc_id").alias("__lf_id"), F.col("row").alias("__lf_row"), F.col("drop").alias("__lf_drop"))
    rows, ordinals = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    if rows <= FEW and ordinals <= 4 * FEW:  # small enough for every task: the texts stay where they are
        hit = F.broadcast(hit)
    x = full.join(hit, ["__lf_id", "__lf_row"], "left").select(*keep, "__lf_drop")
    place = keep.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            new, before, gone = [], [], []
            for t, drop in zip(b.column(place).to_pylist(), b.column("__lf_drop").to_pylist(), strict=True):
                kept, n = (t, 0) if not drop else _without(t, set(drop), least)
                new.append(kept)
                before.append((t or "").count("\n") + 1)
                gone.append(n)
            cols = [b.column(c) if c != text else pa.array(new, b.column(place).type) for c in keep]
            if figures:
                cols += [pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = docs.select(*keep).schema
    if figures:
        schema = schema.add("n_lines", "long").add("n_dropped", "long")
    names = schema.names
    return x.mapInArrow(releasing(rewrite), schema)
