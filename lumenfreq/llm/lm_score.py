"""Scores documents by a gated recurrent language model (gru.py) and by a smoothed unigram model.

1. Words of all training documents are counted, in each task first, then by word; the counts are a written table.
2. The KNOWN most frequent words go to all tasks.  The first MODEL of them are the model's vocabulary; the others, in
   order of spelling, are leaves of its tree, each with a probability that follows from the state.  Each twig has one
   more leaf for the words beyond the KNOWN ones that are spelled between its own; among these a word has the share
   (count + 1) / (their count + their distinct words + 1).  The bounds are parameters and don't grow with the input.
3. The model is trained in ROUNDS on all training documents, each in one round by the hash of its id.  In each round
   every task improves the common weights on its share, and the tasks' weights are averaged by tokens, block by block.
4. Every document is scored in one pass, state carried from its first word to its last.  Counts of words beyond the
   KNOWN ones are looked up: they are gathered by document and word, meet the count table by word, and are summed back.

Cases: a null text or one without words is the end token alone; without training documents all words are unknown and
the model is its start; rows that repeat count and are scored each; a null id is not training; an empty table gives an
empty result; other columns aren't read; a very long text is scored whole, its state carried to its end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .shared import materialise, n_partitions, releasing, text_of

MODEL = 1024
KNOWN = 150_000
CLASSES = 24
#: Branches of the tree of words beyond the model's vocabulary, about, and levels below them.
BRANCHES, LEVELS = 24, 4
HIDDEN = 8
ROUNDS = 2
LANES = 256
#: Tokens held before they are scored or learned from; a longer document is held whole.
AT_ONCE = 1_500_000
FLUSH = 400_000
BLOCK = 8192
END = b""


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def count_words(training: DataFrame) -> DataFrame:
    """(word, n) over the column text of training; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})

        for b in batches:
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                c.update(_words(raw))
                c[END] += 1
                if len(c) > FLUSH:
                    yield out()
                    c.clear()
        if c:
            yield out()

    return materialise(training.select("text").mapInArrow(releasing(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


class Vocabulary:
    """The known words by falling count: their places, ids in the model, and figures (an array each; the last entry is for unknown words).

    far() says in which twig a word beyond them is; set_far() takes how often such words occur in each twig, and how many they are.
    """

    def __init__(self, rows: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        known = dict(rows)
        head = [w for w, _ in rows[: MODEL - 1]]
        if END not in head:
            head = [*head[: MODEL - 2], END]
        self.ids = {w: i for i, w in enumerate(head)}
        self.end, self.other = self.ids[END], len(head)
        in_head = sum(known.get(w, 0) for w in head)
        self.counts = np.array([known.get(w, 0) for w in head] + [total - in_head + 1], np.float64)
        self.places = {w: k for k, w in enumerate(known)}
        times = np.fromiter(known.values(), np.float64, len(known))
        self.base_of = np.append(self.base(times), 0.0)
        rest = sorted(w for w in known if w not in self.ids)
        fan = next(k for k in range(1, len(rest) + 2) if BRANCHES * k**LEVELS >= len(rest))
        self.words, self.fan = len(head) + 1, fan
        self.firsts = rest[fan::fan]  # the first words of all twigs but the first
        code = {w: self.words + k // fan * (fan + 1) + k % fan for k, w in enumerate(rest)}
        self.model_of = np.array([*(self.ids[w] if w in self.ids else code[w] for w in known), self.other], np.int32)
        self.branches = max(1, -(-len(rest) // fan**LEVELS))
        self.weights = np.zeros((self.branches * fan ** (LEVELS - 1), fan + 1))
        self.weights.ravel()[[code[w] - self.words for w in rest]] = [known[w] + 1.0 for w in rest]
        self.set_far(np.zeros(len(self.firsts) + 1), np.zeros(len(self.firsts) + 1))

    def far(self, word: bytes) -> int:
        return bisect_right(self.firsts, word)

    def set_far(self, times: np.ndarray, distinct: np.ndarray) -> None:
        bottom = times + distinct + 1.0
        self.weights[: len(bottom), self.fan] = bottom
        tree = gru.Tree(self.branches, self.fan, LEVELS, self.weights)
        self.shape = gru.Shape(self.words, HIDDEN, gru.classes_of(self.counts, CLASSES), tree)
        self.share_of = -np.log10(bottom)  # of a word that never occurs, within its twig's far words

    def find(self, words: list[bytes]) -> np.ndarray:
        """The places of the words and of the end; -1 for unknown ones."""
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.places.get, words, repeat(-1)), np.int32, len(words))
        out[-1] = self.places.get(END, -1)
        return out

    def encode(self, places: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The model's ids of words, of which find() gave the places."""
        out = self.model_of[places]
        out[-1] = self.end
        if len(at := np.flatnonzero(places[:-1] < 0)):
            twigs = map(bisect_right, repeat(self.firsts), map(words.__getitem__, at.tolist()))
            out[at] = np.fromiter(twigs, np.int64, len(at)) * (self.fan + 1) + (self.words + self.fan)
        return out

    def far_share(self, places: np.ndarray, ids: np.ndarray) -> float:
        """What a document's far words (places and ids of it) have within their twigs, as if none occurred."""
        return float(self.share_of[(ids[:-1][places[:-1] < 0] - self.words) // (self.fan + 1)].sum())

    def base(self, n):
        return np.log10((n + 1.0) / (self.total + self.distinct + 1.0))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least count that at most KNOWN words reach: counts by their power-of-two class and leading bits, so few rows.
    n = F.col("n")
    low = F.expr("shiftleft(shiftright(n, cast(greatest(floor(log2(n)) - 10, 0) as int)), cast(greatest(floor(log2(n)) - 10, 0) as int))")
    edge, taken = None, 0
    for r in counts.groupBy(low.alias("low")).count().orderBy(F.desc("low")).collect():
        taken += r["count"]
        if taken > KNOWN:
            break
        edge = r["low"]
    rows = counts.filter(n >= edge).collect() if edge is not None else []  # at most KNOWN rows
    ranked = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    found = Vocabulary(ranked, int(total[0]), int(total[1]))
    shared = counts.sparkSession.sparkContext.broadcast(found.firsts)

    def by_twig(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = shared.value
        times, distinct = np.zeros(len(firsts) + 1, np.int64), np.zeros(len(firsts) + 1, np.int64)
        for b in batches:
            at = np.array([bisect_right(firsts, w) for w in b.column(0).cast(pa.binary()).to_pylist()], np.int64)
            np.add.at(times, at, b.column(1).to_numpy())
            distinct += np.bincount(at, minlength=len(distinct))
        own = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(times[own]), pa.array(distinct[own])], names=["twig", "n", "v"])

    far = counts.filter("length(word) > 0")  # the end is in the vocabulary
    far = (far.filter(n < edge) if edge is not None else far).mapInArrow(releasing(by_twig), "twig long, n long, v long")
    times, distinct = np.zeros(len(found.firsts) + 1), np.zeros(len(found.firsts) + 1)
    for r in far.groupBy("twig").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # at most one for each twig
        times[r["twig"]], distinct[r["twig"]] = r["n"], r["v"]
    found.set_far(times, distinct)
    return found


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    held, words, size = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            own = [_words(raw) for raw in b.column(column).cast(pa.binary()).to_pylist()]
            held.append(b)
            words += own
            size += sum(map(len, own))
            if size >= AT_ONCE:
                yield held, words
                held, words, size = [], [], 0
    if held:
        yield held, words


def train_model(training: DataFrame, vocab: Vocabulary, slice_of: Column) -> np.ndarray:
    """The averaged weights.  training: column text; slice_of: the round of each document, 0 to ROUNDS - 1."""
    spark = training.sparkSession
    shape = vocab.shape
    weights = gru.start(shape, vocab.counts)
    shared = spark.sparkContext.broadcast(vocab)
    for turn in range(ROUNDS):
        given = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            voc, v, seen = shared.value, given.value.copy(), 0
            square = np.zeros_like(v)
            for _, words in _portions(batches, 0):
                seen += gru.train(voc.shape, v, [voc.encode(voc.find(w), w) for w in words], voc.end, square)
            if seen:
                parts = [v[a : a + BLOCK].astype("<f4").tobytes() for a in range(0, len(v), BLOCK)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "tokens": pa.array([seen] * len(parts), pa.int64()), "weights": pa.array(parts, pa.binary())})

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple] = {}
            for b in batches:
                for k, n, x in zip(*(b.column(c).to_pylist() for c in ("block", "tokens", "weights")), strict=True):
                    s, m = sums.get(k, (0.0, 0))
                    sums[k] = (s + np.frombuffer(x, "<f4").astype(np.float64) * n, m + n)
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "weights": pa.array([(s / m).astype("<f4").tobytes() for s, m in sums.values()], pa.binary())})

        part = training.filter(slice_of == turn).select("text").mapInArrow(releasing(learn), "block int, tokens long, weights binary")
        rows = part.repartition(n_partitions(spark), "block").mapInArrow(releasing(average), "block int, weights binary").collect()  # one model
        weights = weights.copy()
        for r in rows:
            x = np.frombuffer(bytes(r["weights"]), "<f4")
            weights[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return weights


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) for every row of docs."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text"), F.coalesce(is_training, F.lit(False)).alias("training"))
    training = own.filter("training")
    counts = count_words(training)
    vocab = vocabulary(counts)
    weights = train_model(training, vocab, F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)))
    shared, model = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, v = shared.value, model.value
        row = TaskContext.get().partitionId() << 40
        no_end = 0.0 if END in voc.places else float(voc.base(0))
        for held, words in _portions(batches, 1):
            places = [voc.find(w) for w in words]
            ids = [voc.encode(x, w) for x, w in zip(places, words, strict=True)]
            found = gru.score(voc.shape, v, ids, voc.end, LANES) / np.log(10)
            flat = np.concatenate(places)
            starts = np.cumsum([0, *map(len, places[:-1])])
            n_known = np.add.reduceat((flat >= 0).astype(np.int64), starts)
            base_sum = np.add.reduceat(voc.base_of[flat], starts) + no_end
            more = found + np.array([voc.far_share(x, i) for x, i in zip(places, ids, strict=True)])
            size, flat_w, flat_n = [], [], []
            for ws, x in zip(words, places, strict=True):
                far = Counter([ws[k] for k in np.flatnonzero(x[:-1] < 0)])
                flat_w += far
                flat_n += far.values()
                size.append(len(far))
            at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype("i4"))
            pairs = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(flat_w, pa.binary()), pa.array(flat_n, pa.int64())], names=["word", "n"]))
            names = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(words))), names, pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(n_known), pa.array(base_sum), pa.array(more), pairs],
                names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "far"],
            )
            row += len(words)

    seen = materialise(own.select("doc_id", "text").mapInArrow(releasing(run), "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, far array<struct<word:binary,n:long>>"), "scored")
    far = seen.select("row", F.explode("far").alias("e")).select("row", F.col("e.word").alias("word"), F.col("e.n").alias("times"))
    met = far.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + 1.0) / F.lit(float(vocab.total + vocab.distinct + 1)))
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(base * F.col("times")).alias("b"),
        F.sum(F.log10(F.col("n") + 1.0) * F.col("times")).alias("s"),
    )
    x = seen.drop("far").join(met, "row", "left")
    zero = F.lit(0.0)
    return x.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
