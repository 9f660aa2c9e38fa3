"""N-gram Jaccard self-join by rare-first prefix filtering, with length, positional and suffix filters.

1. Each document becomes the set of its word n-grams (64-bit hashes); documents with the same set are one class, so
   copies are never paired with each other.  The same pass says in how many documents n-grams occur: each task sorts the
   counters that its n-grams fall on and writes them as gaps, about a byte for an n-gram; one task for each block of
   counters adds them up.  There are at least as many counters as n-grams, up to 2^MOST_BITS (a byte each in a worker).
2. Each class emits the postings of its prefix: the n - ceil(t n) + 1 rarest n-grams, by the sketch's count and then by
   hash, one order for all.  Two sets of similarity t or more share an n-gram of their prefixes.  Counters never count
   too little, so an n-gram whose counter says 1 is in one document alone, and is in the prefix without a posting.
3. Postings meet by n-gram.  Within an n-gram, candidates pass the length, positional and suffix filters.  In a first
   round only one pivot of a frequent n-gram, the class with fewest rarer n-grams before it, is paired with the others;
   members found to be connected then are not paired again, which keeps a group of near copies linear.  The second round
   pairs all that is left: no pair of different components goes untested, so components are exact.  There an n-gram of
   more than CHUNK classes is dealt to tasks as pairs of chunks.
4. Each candidate pair is verified once on the exact sets of both texts.  Only texts of candidates are fetched, straight
   to the task of their pair; a class with many partners has as many tasks as they need.

The suffix filter bounds the overlap by the parities of the n-gram counts in 256 parts of the hash space: sets differ in
at least as many n-grams as they have parts of unequal parity.

Cases: a null text or one without words has no set and links with nothing; fewer words than n are one n-gram;
repeated rows are in one class; an empty table gives an empty result; other columns aren't read.  A very long text is
one task's work, and its set is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import create, open_input
from .shared import discard, materialise, new_dir, releasing, small, small_batches, tasks_for, text_of

#: Counters at most, as a power of two, and at least (also the blocks of counters that are added up apart).
MOST_BITS, LEAST_BITS, BLOCK_BITS = 26, 16, 6
#: N-grams held before their counters are written.
HELD = 2_000_000
#: Partners that one task of the verification holds against a class.
PARTNERS = 512
SIG = ("s0", "s1", "s2", "s3")
#: N-grams of at most so many classes pair them without a loop.
SMALL = 32
#: N-grams of more classes than this go through a pivot first.
PIVOT_FROM = 4
#: Classes of one n-gram in a chunk; a task holds two.
CHUNK = 1024
_MOST_WORDS = 100_000


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            self[w] = h
        return h


_WORDS = _Words()


def shingles(raw: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a UTF-8 text; bytes.lower and bytes.split know ASCII letters and white space only."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _set_id(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).astype(np.int64))


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def _gaps(counters: np.ndarray) -> bytes:
    """Sorted counters as gaps: a byte each, and those of 255 or more in full behind."""
    d = np.diff(counters, prepend=counters.dtype.type(0))
    packed = np.minimum(d, 255).astype(np.uint8).tobytes() + d[d >= 255].astype("<u4").tobytes()
    return len(d).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(packed)


def _from_gaps(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    packed = zstandard.ZstdDecompressor().decompress(raw[8:])
    d = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    d[d == 255] = np.frombuffer(packed, "<u4", offset=n)
    return np.cumsum(d)


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact to 128, then by steps of an eighth."""
    return np.where(counts <= 128, counts, np.minimum(128 + np.ceil(6 * np.log2(np.maximum(counts, 128) / 128)), 255)).astype(np.uint8)


def _levels(at: str) -> np.ndarray:
    """All counters of a sketch.  Each task reads them anew and lets them go: workers live on with other work to do."""
    out = None
    for k in range(1 << BLOCK_BITS):
        with open_input(f"{at}/{k:04d}") as f:
            part = np.frombuffer(f.read(), np.uint8)
        out = np.empty(len(part) << BLOCK_BITS, np.uint8) if out is None else out
        out[k * len(part) : (k + 1) * len(part)] = part
    return out


def document_sets(docs: DataFrame, n: int) -> tuple[DataFrame, str]:
    """(doc_id, key, n_shingles, cls, s0 to s3: parities) for every document (doc_id, text, key), and the folder of the sketch."""
    spark = docs.sparkSession
    names = ["doc_id", "key", "n_shingles", "cls", *SIG, "block", "counters"]
    inner = MOST_BITS - BLOCK_BITS

    def counters(held: list[np.ndarray]) -> pa.RecordBatch:
        c = np.concatenate(held)
        c.sort()
        cuts = np.searchsorted(c, np.arange(1, 1 << BLOCK_BITS, dtype=np.uint32) << np.uint32(inner))
        parts = [_gaps(x & np.uint32((1 << inner) - 1)) for x in np.split(c, cuts)]
        none = pa.nulls(len(parts), pa.int64())
        return pa.RecordBatch.from_arrays([none] * (4 + len(SIG)) + [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            cls, count, sig = [], [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(raw, n)
                cls.append(_set_id(s) if len(s) else None)
                count.append(len(s))
                sig.append(_parities(s))
                if len(s):
                    held.append((s >> np.uint64(64 - MOST_BITS)).astype(np.uint32))
                    size += len(s)
                if size >= HELD:
                    yield counters(held)
                    held, size = [], 0
            parts = np.array(sig, np.int64).reshape(len(sig), len(SIG))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in parts.T), pa.nulls(len(cls), pa.int32()), pa.nulls(len(cls), pa.binary())], names=names)
        if held:
            yield counters(held)

    kind = "doc_id long, key long, n_shingles long, cls long, s0 long, s1 long, s2 long, s3 long, block int, counters binary"
    seen = materialise(docs.mapInArrow(releasing(scan), kind), "sets")
    total = seen.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shift = MOST_BITS - min(MOST_BITS, max(LEAST_BITS, int(total).bit_length()))
    at = new_dir(spark, "sketch")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("counters").to_pylist(), strict=True):
                own = sums.setdefault(k, np.zeros((1 << inner) >> shift, np.int64))
                if x is not None:
                    own += np.bincount(_from_gaps(x) >> shift, minlength=len(own))
        for k, x in sums.items():
            with create(f"{at}/{k:04d}") as out:
                out.write(_level(x).tobytes())
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32())})

    blocks = spark.range(1 << BLOCK_BITS).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("binary").alias("counters"))
    seen.filter("block is not null").select("block", "counters").unionByName(blocks).repartition(1 << BLOCK_BITS, "block").mapInArrow(releasing(add), "block int").count()
    return seen.filter("block is null").select("doc_id", "key", "n_shingles", "cls", *SIG), at


def _parities(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def prefix_postings(docs: DataFrame, classes: DataFrame, sketch: str, n: int, percent: int) -> DataFrame:
    """(gram, cls, size, pos, s0 to s3) of n-grams in the prefixes of at least two classes, written to the shared folder."""
    spark = docs.sparkSession

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = _levels(sketch), set()
        shift = np.uint64(65 - len(level).bit_length())
        for b in batches:
            grams, cls, size, pos = [], [], [], []
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                s = shingles(raw, n)
                if not len(s) or (c := _set_id(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                own = level[(s >> shift).astype(np.int64)]
                first = np.argsort(own, kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]
                at = np.flatnonzero(own[first] != 1)
                grams.append(s[first[at]])
                cls.append(np.full(len(at), c, np.int64))
                size.append(np.full(len(at), len(s), np.int32))
                pos.append(at.astype(np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (cls, size, pos))], names=["gram", "cls", "size", "pos"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by n-gram and class: a row stays if it is the first of its class and a neighbour has its n-gram.
        last, opened = None, None  # the last distinct row, and whether it already went out
        for b in batches:
            if not b.num_rows:
                continue
            gram, c = b.column("gram").to_numpy(), b.column("cls").to_numpy()
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (c[1:] != c[:-1])])
            if last is not None and last.column("gram")[0].as_py() == gram[0] and last.column("cls")[0].as_py() == c[0]:
                new[0] = False
            at = np.flatnonzero(new)
            if not len(at):
                continue
            g = gram[at]
            same = np.concatenate([[False], g[1:] == g[:-1]])
            if last is not None and last.column("gram")[0].as_py() == g[0]:
                same[0] = True
                if not opened:
                    yield last
            keep = same | np.append(same[1:], False)
            yield b.take(pa.array(at[keep]))
            last, opened = b.slice(at[-1], 1), bool(keep[-1])

    posts = docs.select("text").mapInArrow(releasing(emit), "gram long, cls long, size int, pos int")
    met = posts.repartition(tasks_for(docs), "gram").sortWithinPartitions("gram", "cls").mapInArrow(releasing(groups), "gram long, cls long, size int, pos int")
    return materialise(met.join(classes.select("cls", *SIG), "cls"), "postings")


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, dealt anew so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and held[-1].column(key)[0].as_py() != int(k[0]):
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _fit(n, pos, sig, i, j, percent: int) -> np.ndarray:
    """Which of the pairs of rows (i, j) pass the length, positional and suffix filters."""
    a, b = n[i], n[j]
    must = needed(a, b, percent)
    ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    ok &= 1 + np.minimum(a - pos[i] - 1, b - pos[j] - 1) >= must
    return ok & ((a + b - np.bitwise_count(sig[i] ^ sig[j]).sum(axis=-1, dtype=np.int64)) // 2 >= must)


def pivot_candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) that pass the filters: of each n-gram that more than PIVOT_FROM classes share, its pivot with each other one.

    The pivot has the n-gram earliest in its prefix (ties: the least class).  In a group of near copies that is the one with
    fewest n-grams of its own: the same one for most n-grams, and similar to most others, so the group gives pairs in line with its size.
    """
    gap = " + ".join(f"bit_count({c} ^ p.{c})" for c in SIG)
    must = f"({percent}L * (size + p.size) + {99 + percent}) div {100 + percent}"
    pivots = postings.groupBy("gram").agg(F.min(F.struct("pos", "cls", "size", *SIG)).alias("p"), F.count("*").alias("n")).filter(F.col("n") > PIVOT_FROM).select("gram", "p")
    x = postings.join(pivots, "gram").filter("cls != p.cls").filter(f"100L * least(size, p.size) >= {percent}L * greatest(size, p.size)")
    x = x.filter(f"1 + least(size - pos - 1, p.size - p.pos - 1) >= {must}").filter(f"(size + p.size - ({gap})) div 2 >= {must}")
    return materialise(x.select(F.col("p.cls").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")


def candidates(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of all n-grams that pass the filters and whose labels (node, label) differ, written to the shared folder."""
    spark = postings.sparkSession
    x = postings.join(labels.withColumnsRenamed({"node": "cls"}), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = x.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    mixed = mixed.select("gram", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "cell"):
            cell, c, n, pos, label, chunk = (t.column(k).to_numpy() for k in ("cell", "cls", "size", "pos", "label", "chunk"))
            n, pos, sig = n.astype(np.int64), pos.astype(np.int64), np.stack([t.column(k).to_numpy() for k in SIG], axis=1).view(np.uint64)
            # In a cell of two chunks only pairs across them count.
            part = np.where(t.column("across").to_numpy(), chunk, np.int32(-1))
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(start, len(cell)))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            few = np.repeat(size <= SMALL, size)
            for d in range(1, int(size[size <= SMALL].max(initial=1))):
                i = np.flatnonzero(few[:-d] & (cell[:-d] == cell[d:]) & (label[:-d] != label[d:]) & ((part[:-d] < 0) | (part[:-d] != part[d:])))
                i = i[_fit(n, pos, sig, i, i + d, percent)]
                found.append((i, i + d))
            for s, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
                found += _across_labels(s + np.argsort(n[s : s + m], kind="stable"), n, pos, sig, label, part, percent)
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                ab = np.unique(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])

    cols = ["cls", "size", "pos", *SIG, "label"]
    met = x.join(mixed, "gram").withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(F.xxhash64("gram", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "chunk", (F.col("chunk") != F.col("other")).alias("mixed"), *cols)
    # A cell of one chunk has rows of that chunk alone; a cell of two has rows of both, all marked.
    met = met.withColumnRenamed("mixed", "across").repartition(tasks_for(postings), "cell").sortWithinPartitions("cell").mapInArrow(releasing(pair), "a long, b long")
    return materialise(met.distinct(), "pairs")


def _across_labels(rows: np.ndarray, n, pos, sig, label, part, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different labels (and parts, where these aren't negative) among rows (by size) that pass the filters.
    Rows of the most frequent label are never compared with one another, and no row with sizes too far from its own."""
    size = n[rows]
    _, of = np.unique(label[rows], return_inverse=True)
    common = of == np.bincount(of).argmax()
    rest = np.flatnonzero(~common)
    lo, hi = np.searchsorted(size, -(-percent * size // 100)), np.searchsorted(size, 100 * size // percent, side="right")
    out = []
    for q in rest:
        j = np.arange(lo[q], hi[q])
        j = j[(of[j] != of[q]) & (common[j] | (j > q)) & ((part[rows[j]] < 0) | (part[rows[j]] != part[rows[q]]))]
        i = np.full(len(j), rows[q])
        ok = _fit(n, pos, sig, i, rows[j], percent)
        out.append((i[ok], rows[j][ok]))
    return out


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, written to the shared folder.

    The text of a class is that of its first row.  It goes to a task for each of its partners (salted by PARTNERS), which
    holds one set of a at a time.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    left = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("cls"))
    asked = left.unionByName(salted.select("a", "salt", "b", F.col("b").alias("cls"))).join(classes.select("cls", "row"), "cls")
    asked = materialise(asked.select(F.col("row.doc_id").alias("first"), F.col("row.key").alias("first_key"), F.col("row.times").alias("times"), "a", "salt", "b"), "asked")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = np.zeros(0, np.uint64), None
        for b in batches:
            out_a, out_b = [], []
            for a, other, raw in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(raw, n)
                if other is None:
                    held, key = s, a
                elif key == a and 100 * (both := len(np.intersect1d(held, s, assume_unique=True))) >= percent * (len(held) + len(s) - both):
                    out_a.append(a)
                    out_b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    near = small(asked.drop("times"))
    rows = docs.join(near, docs["key"].eqNullSafe(near["first_key"]) & docs["doc_id"].eqNullSafe(near["first"])).select("a", "salt", "b", "text")
    if asked.filter("times > 1").limit(1).count():  # rows that are repeated whole
        rows = rows.dropDuplicates(["a", "salt", "b"])
    rows = rows.repartition(tasks_for(docs), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = materialise(rows.mapInArrow(releasing(test), "a long, b long"), "links")
    discard(spark, asked)
    return links


def _key(text: Column) -> Column:
    """Tells the texts of rows with the same id, or with none, apart."""
    return F.xxhash64(text)


def _linked(docs: DataFrame, n: int, percent: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and (cls, row, label): the first row of each class (no_id, doc_id, key; null ids last; and
    times, how often that row occurs) and the least class that links reach."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).withColumn("key", _key(F.col("text")))
    with small_batches(spark):
        sets, sketch = document_sets(own, n)
        rows = sets.filter("cls is not null").groupBy("cls", "doc_id", "key").agg(F.count("*").alias("times"), *(F.min(c).alias(c) for c in SIG))
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "times")
        classes = materialise(rows.groupBy("cls").agg(F.min(row).alias("row"), *(F.min(c).alias(c) for c in SIG)), "classes")
        postings = prefix_postings(own, classes, sketch, n, percent)
        discard(spark, sketch)
        pivots = pivot_candidates(postings, percent)
        links = verify(pivots, own, classes, n, percent)
        labels = components(links)
        rest = candidates(postings, labels, percent)
        more = verify(rest, own, classes, n, percent)
        star = labels.filter("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(more.unionByName(star))
        discard(spark, postings, pivots, links, rest, more)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    return sets, named.select("cls", "row", F.coalesce("label", "cls").alias("label"))


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: component_id is the least id reachable by links of
    100 * intersection >= percent * union over sets of n-word shingles."""
    sets, named = _linked(docs, n, percent, id_col, text)
    least = named.groupBy("label").agg(F.min("row.doc_id").alias("component_id"))
    by_class = named.select("cls", "label").join(least, "label").select("cls", "component_id")
    return sets.join(by_class, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, that of the least id (null ids last, then by the hash of the text), and every row without words.

    Rows are told apart by id and text; of rows that agree in both one stays, if it is the first of its component.
    """
    sets, named = _linked(docs, n, percent, id_col, text)
    first = named.groupBy("label").agg(F.min("row").alias("first"))
    first = materialise(named.join(first, "label").select("cls", "first"), "first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    # Rows that go: all but the first of each component, and the first too if it is repeated, of which one comes back.
    gone = sets.join(first, "cls").filter(~same | (F.col("first.times") > 1)).select(F.col("doc_id").alias("__lf_id"), F.col("key").alias("__lf_key")).distinct()
    gone = small(materialise(gone, "gone"))
    own_key, own_id = _key(text_of(docs, text)), docs[id_col].cast("long")
    kept = docs.join(gone, own_key.eqNullSafe(F.col("__lf_key")) & own_id.eqNullSafe(F.col("__lf_id")), "left_anti")
    again = materialise(first.filter("first.times > 1").select(F.col("first.doc_id").alias("__lf_id"), F.col("first.key").alias("__lf_key")).distinct(), "again")
    if not again.limit(1).count():
        return kept
    back = docs.join(small(again), own_key.eqNullSafe(F.col("__lf_key")) & own_id.eqNullSafe(F.col("__lf_id")))
    return kept.unionByName(back.dropDuplicates(["__lf_id", "__lf_key"]).select(*docs.columns))
