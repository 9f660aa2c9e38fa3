"""Language identification by multilingual mixture inference.

A language is a distribution of character n-grams: at each letter the bigram and the trigram around it, where whatever
is no letter counts as a boundary.  A document is a mixture: each of its phrases (eight words) comes from one language,
drawn by the document's proportions.  Expectation-maximisation estimates the proportions from the n-gram likelihoods
of the phrases.  The set of languages is selected by penalised likelihood: from the best single language on, the
language that promises most is added while the likelihood rises by more than the penalty for one more proportion (half
the log of the number of phrases, and a floor).

Counts come from all training documents, by hash buckets (2^16 for each language), so their size is bounded by the
number of languages.  The score is the share of the predicted language in the document: 1.0 where one language alone was
selected.  Cases: null text, or text without letters: `und` with score 0; no training document at all:
`und` for all; a single language: that one; ties go to the language first by name; repeated rows count again; an empty
table gives an empty result; other columns aren't read; a very long text is one task's work, held whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import n_partitions, text_of

BUCKETS = 1 << 16
#: Parts of a language's buckets that are added up apart.
BLOCKS = 16
SMOOTH = 0.5
STEPS = 20
PHRASE = 8
LEAST_GAIN = 10.0
#: Characters handled at once; a longer document is handled whole.
AT_ONCE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all letters of the texts, one after another: buckets of the bigram and of the trigram, whether a word begins, and the text."""
    lower = [t.lower() for t in texts]
    size = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    c = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[c]
    s = np.where(is_letter, c, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    before, here, after = np.where(at > 0, s[at - 1], 0), s[at], s[at + 1]
    with np.errstate(over="ignore"):
        h2 = (here * np.uint64(0x9E3779B97F4A7C15)) ^ (after * np.uint64(0xC2B2AE3D27D4EB4F))
        h3 = h2 ^ ((before + np.uint64(1)) * np.uint64(0x165667B19E3779F9))
        h2, h3 = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48) for h in (h2, h3))
    doc = np.searchsorted(np.cumsum(size), at, side="right")
    return h2.astype(np.int64), h3.astype(np.int64), before == 0, doc


def _portions(texts: list[str]) -> Iterator[slice]:
    """Slices of a batch of about AT_ONCE characters."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= AT_ONCE:
            yield slice(first, k + 1)
            first, held = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages by name and their log probabilities (languages x buckets), from all rows with text and language."""
    rows = docs.filter(docs[text].isNotNull() & docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, texts = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_pylist()
            for name in dict.fromkeys(names):
                own = [t for n, t in zip(names, texts, strict=True) if n == name]
                for part in _portions(own):
                    h2, h3, _, _ = letter_grams(own[part])
                    sums[name] = sums.get(name, 0) + np.bincount(h2, minlength=BUCKETS) + np.bincount(h3, minlength=BUCKETS)
        for name, x in sums.items():
            parts = [zlib.compress(y.tobytes(), 1) for y in np.split(x.astype(np.int64), BLOCKS)]
            yield pa.RecordBatch.from_pydict({"lang": [name] * BLOCKS, "block": pa.array(range(BLOCKS), pa.int32()), "counts": parts})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for *key, x in zip(*(b.column(c).to_pylist() for c in ("lang", "block", "counts")), strict=True):
                sums[tuple(key)] = sums.get(tuple(key), 0) + np.frombuffer(zlib.decompress(x), np.int64)
        for (name, k), x in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "block": pa.array([k], pa.int32()), "counts": [zlib.compress(x.tobytes(), 1)]})

    kind = "lang string, block int, counts binary"
    parts = rows.mapInArrow(count, kind).repartition(n_partitions(docs.sparkSession), "lang", "block").mapInArrow(add, kind)
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in parts.collect():  # one array for each language, in blocks
        found.setdefault(r["lang"], {})[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    names = sorted(found)
    counts = np.array([np.concatenate([found[n][k] for k in range(BLOCKS)]) for n in names], dtype=np.float64).reshape(len(names), BUCKETS) + SMOOTH
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once.  p: words x languages (scaled by each word's best); chosen: documents x languages.
    Returns the proportions and the log-likelihood without the scales."""
    share = chosen / chosen.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(STEPS):
        own = p * share[doc]
        own *= (n / np.maximum(own.sum(axis=1), 1e-300))[:, None]
        new = np.add.reduceat(own, starts, axis=0) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, np.add.reduceat(n * np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-300)), starts)


def infer(ll: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages; 0 for languages not selected).

    ll: words x languages, documents one after another from `starts`, each with a word at least; n: how often a word occurs.
    """
    docs = len(starts)
    size = np.diff(np.append(starts, len(n)))
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    single = np.add.reduceat(n[:, None] * (ll - top), starts, axis=0)
    share = np.zeros_like(single)
    chosen = np.zeros(single.shape, bool)
    first = single.argmax(axis=1)
    chosen[np.arange(docs), first] = True
    share[chosen] = 1
    best = single.max(axis=1)
    penalty = np.maximum(LEAST_GAIN, 0.5 * np.log(np.add.reduceat(n, starts)))
    active = np.arange(docs)
    for _ in range(ll.shape[1] - 1):
        of = np.repeat(np.isin(np.arange(docs), active), size)
        a_size = size[active]
        a_starts = np.cumsum(a_size) - a_size
        doc = np.repeat(np.arange(len(active)), a_size)
        a_ll, a_n = ll[of], n[of]
        have = chosen[active]
        here = np.where(have[doc], a_ll, -np.inf).max(axis=1, keepdims=True)
        # What a language could add at most, were each word free to move to it: no EM where even that is below the penalty.
        rise = np.where(have, -np.inf, np.add.reduceat(a_n[:, None] * np.maximum(a_ll - here, 0), a_starts, axis=0))
        k = rise.argmax(axis=1)
        could = rise.max(axis=1) > penalty[active]
        if not could.any():
            break
        keep = could[doc]
        tried = have.copy()
        tried[np.arange(len(active)), k] = True
        c_size = a_size[could]
        s, l = _mixture(p[of][keep], a_n[keep], np.cumsum(c_size) - c_size, np.repeat(np.arange(len(c_size)), c_size), tried[could])
        active = active[could]
        won = l - best[active] > penalty[active]
        active, s, l, tried = active[won], s[won], l[won], tried[could][won]
        chosen[active], share[active], best[active] = tried, s, l
        if not len(active):
            break
    return share


def identify(docs: DataFrame, names: list[str], model: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the proportion of the language predicted), langs (all with their proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^16 floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.T)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for b in batches:
            texts = b.column(1).to_pylist()
            share = np.concatenate([_shares(texts[part], table) for part in _portions(texts)]) if texts else np.zeros((0, len(names)))
            ranked = [sorted(((p, k) for k, p in enumerate(x) if p > 0), key=lambda y: (-y[0], y[1])) for x in share.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([names[x[0][1]] if x else "und" for x in ranked], pa.string()),
                    pa.array([min(1.0, x[0][0]) if x else 0.0 for x in ranked], pa.float64()),
                    pa.array([[{"lang": names[k], "share": p} for p, k in x] for x in ranked], kind),
                ],
                names=["doc_id", "lang_pred", "score", "langs"],
            )

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return own.mapInArrow(predict, "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def _shares(texts: list[str], table: np.ndarray) -> np.ndarray:
    """texts x languages; a row of zeros where a text has no letters."""
    out = np.zeros((len(texts), table.shape[1]))
    h2, h3, begins, doc = letter_grams(texts)
    if not len(doc) or not table.shape[1]:
        return out
    words = np.flatnonzero(begins)
    of = doc[words]
    have, first = np.unique(of, return_index=True)
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    phrase = place % PHRASE == 0
    ll = np.add.reduceat(table[h2] + table[h3], words[phrase], axis=0).astype(np.float64)
    out[have] = infer(ll, np.ones(len(ll)), np.searchsorted(of[phrase], have))
    return out


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n
