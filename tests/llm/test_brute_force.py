"""The corpus operators and the pipeline against plain Python written from their contracts."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfreq.llm import ann, frames, gru, language, lines, lm_score, mixing, ngram_join, packing, quality, registry, shared, tokens

WS = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def pieces_of(rows, encode, most):
    """Counter of (doc_id, piece, start, length, crc)."""
    out = collections.Counter()
    for i, text in rows:
        ids = [*encode(text), 0]
        first = len(ids) if len(ids) <= most else len(ids) % most or most
        at, p = 0, 0
        while at < len(ids):
            n = first if p == 0 else most
            out[i, p, at, n, crc(ids[at : at + n])] += 1
            at, p = at + n, p + 1
    return out


def check_places(got, most):
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= most
    return len(places)


def test_packing_of_every_piece(spark, encode):
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(f"w{k}" for k in rng.integers(0, 99, rng.integers(0, 60)))) for i in range(400)]
    rows += [(None, None), (7, ""), (8, "long " * 900), (8, "long " * 900), (9, "x " * 255)]
    table = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, offset int, piece int")
    got = packing.pack(tokens.encode_pieces(table, public_tokenizers.path("byte_bpe_50k.json"), 0, 256), 256).collect()
    want = pieces_of(rows, encode, 256)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(k[3] * n for k, n in want.items())
    assert check_places(got, 256) <= -(-total // 256) + 1


def test_packing_replaces_columns_of_its_results(spark):
    table = spark.createDataFrame([(1, 3, "a"), (2, 2, "b"), (3, 1, "c")], "id long, length long, OFFSET string")
    got = packing.pack(table, 4).collect()
    assert {r.id for r in got} == {1, 2, 3} and check_places(got, 4) == 2


def test_ids_that_do_not_fit_are_refused(tmp_path):
    with (tmp_path / "s").open("wb") as f, pytest.raises(ValueError):
        frames.ShardWriter(f, 2).add(1, np.array([70_000]))


def _shape():
    return gru.Shape(7, 3, np.array([0, 2, 6, 7]))


def plain_log_likelihood(shape, v, doc, end):
    """One step after another, one word at a time."""
    p = {k: x.astype(float) for k, x in gru.unflat(shape, v).items()}
    h, out, word, sig, n = np.zeros(shape.hidden), 0.0, end, lambda a: 1 / (1 + np.exp(-a)), shape.hidden
    for t in doc:
        gx, gh = p["x"][word], h @ p["wh"]
        z, r = sig(gx[:n] + gh[:n]), sig(gx[n : 2 * n] + gh[n : 2 * n])
        c = np.tanh(gx[2 * n :] + r * gh[2 * n :])
        h = (1 - z) * c + z * h
        a = h @ p["wc"] + p["bc"]
        k = int(np.searchsorted(shape.edges, t, side="right")) - 1
        out += a[k] - np.log(np.exp(a).sum())
        lo, hi = shape.edges[k], shape.edges[k + 1]
        b = p["u"][lo:hi] @ h + p["b"][lo:hi]
        out += b[t - lo] - np.log(np.exp(b).sum())
        word = t
    return out


def test_model_scores_equal_plain_loops():
    shape, rng = _shape(), np.random.default_rng(4)
    v = gru.flat({k: rng.standard_normal(s).astype(np.float32) for k, s in shape.parts().items()})
    docs = [np.append(rng.integers(0, 7, n), 1).astype(np.int32) for n in (0, 1, 5, 40, 70, 3, 16, 15)]
    want = [plain_log_likelihood(shape, v, d, 1) for d in docs]
    for most in (1, 3, 8):  # lanes hold several documents, or one each
        assert np.allclose(gru.score(shape, v, docs, 1, most), want, atol=1e-3)


def test_model_gradients_equal_differences():
    shape, rng = _shape(), np.random.default_rng(5)
    v = gru.flat({k: (rng.standard_normal(s) * 0.5).astype(np.float32) for k, s in shape.parts().items()})
    docs = [np.append(rng.integers(0, 7, n), 1).astype(np.int32) for n in (5, 3, 9)]  # shorter than a window: nothing is cut off
    flat_g = np.zeros_like(v)
    target, of, size = gru.lanes(docs, 2)
    p = gru.unflat(shape, v)
    total = np.zeros_like(v)
    for w in gru._windows(shape, p, target, of, size, 1):
        gru.gradients(shape, p, w, gru.unflat(shape, flat_g))
        total += flat_g
    assert len(target) <= gru.WINDOW
    for k in range(len(v)):
        e = np.zeros(len(v))
        e[k] = 1e-4
        up, down = (-sum(plain_log_likelihood(shape, v.astype(float) + s * e, d, 1) for d in docs) for s in (1, -1))
        assert abs((up - down) / 2e-4 - total[k]) < 2e-3 * max(1, abs(total[k]))


def plain_targets(sizes):
    """sizes: {source: size} -> {source: target} by pouring again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, out = {s: k % 3 + 1 for k, s in enumerate(order)}, float(sum(sizes.values())), {}
    while True:
        live = [s for s in order if s not in out]
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in live}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(out.values())


def plain_tree_log_likelihood(shape, weights, v, doc, end):
    """As plain_log_likelihood(); words from id 7 on are leaves of 3 branches of 2 x 2 twigs of 3 leaves."""
    p = {k: x.astype(float) for k, x in gru.unflat(shape, v).items()}
    h, out, word, sig, n = np.zeros(shape.hidden), 0.0, end, lambda a: 1 / (1 + np.exp(-a)), shape.hidden
    pick = lambda a, at: a[at] - np.log(np.exp(a).sum())
    for t in doc:
        gx, gh = p["x"][word if word < 7 else 7 + (word - 7) // 12], h @ p["wh"]
        z, r = sig(gx[:n] + gh[:n]), sig(gx[n : 2 * n] + gh[n : 2 * n])
        h = (1 - z) * np.tanh(gx[2 * n :] + r * gh[2 * n :]) + z * h
        c = int(np.searchsorted(shape.edges, min(t, 6), side="right")) - 1
        out += pick(h @ p["wc"] + p["bc"], c)
        lo, hi = shape.edges[c], shape.edges[c + 1]
        out += pick(p["u"][lo:hi] @ h + p["b"][lo:hi], min(t, 6) - lo)
        if t >= 7:
            w, one = weights.reshape(3, 2, 2, 3), np.append(h, 1)
            b, i, j, k = np.unravel_index(t - 7, w.shape)
            below = one @ p["ut"][b]
            out += pick(np.log(w.sum(axis=(1, 2, 3))) + one @ p["ub"], b)
            out += pick(np.log(w[b].sum(axis=(1, 2))) + below[:2], i) + pick(np.log(w[b, i].sum(axis=1)) + below[2:4], j)
            out += pick(np.log(w[b, i, j]) + below[4:], k)
        word = t
    return out


def test_model_with_leaves_equals_plain_loops():
    rng = np.random.default_rng(14)
    weights = rng.random((12, 3)) + 0.1
    shape = gru.Shape(7, 3, np.array([0, 2, 6, 7]), gru.Tree(3, 2, 3, weights))
    v = gru.flat({k: (rng.standard_normal(s) * 0.5).astype(np.float32) for k, s in shape.parts().items()})
    ids = np.array([*range(6), *range(7, 43)])
    docs = [np.append(rng.choice(ids, n), 1).astype(np.int32) for n in (0, 1, 5, 40, 16, 15)]
    want = [plain_tree_log_likelihood(shape, weights, v, d, 1) for d in docs]
    for most in (1, 3):
        assert np.allclose(gru.score(shape, v, docs, 1, most), want, atol=1e-3)
    after = gru.score(shape, v, [np.array([8, t], np.int32) for t in ids], 1) - gru.score(shape, v, [np.array([8], np.int32)], 1)
    assert abs(np.exp(after).sum() - 1) < 1e-5  # one distribution over all words
    docs = [d for d in docs if len(d) <= 16][:3]
    flat_g, total = np.zeros_like(v), np.zeros_like(v)
    for w in gru._windows(shape, p := gru.unflat(shape, v), *gru.lanes(docs, 3), 1):
        gru.gradients(shape, p, w, gru.unflat(shape, flat_g))
        total += flat_g
    for k in range(len(v)):
        e = np.zeros(len(v))
        e[k] = 1e-4
        up, down = (-sum(plain_tree_log_likelihood(shape, weights, v.astype(float) + s * e, d, 1) for d in docs) for s in (1, -1))
        assert abs((up - down) / 2e-4 - total[k]) < 5e-3


def test_model_passes_do_not_grow_with_classes(monkeypatch):
    rng, calls = np.random.default_rng(17), []

    class Counted:
        def __getattr__(self, name):
            return (lambda *a, **k: calls.append(1) or np.exp(*a, **k)) if name == "exp" else getattr(np, name)

    shape = gru.Shape(61, 3, gru.classes_of(np.ones(61), 20), gru.Tree(8, 3, 2, rng.random((24, 4)) + 0.1))
    ids = np.array([*range(60), *range(61, 61 + 96)])
    docs = [np.append(rng.choice(ids, 63), 1).astype(np.int32) for _ in range(32)]
    v = gru.start(shape, np.ones(61))
    monkeypatch.setattr(gru, "np", Counted())
    # One for the gates of each step; for each of the 4 windows those of all classes, words, branches and leaves.
    for run in (lambda: gru.score(shape, v, docs, 1), lambda: gru.train(shape, v, docs, 1, np.zeros_like(v))):
        calls.clear()
        run()
        assert len(shape.edges) > 20 and len(calls) <= 64 + 4 * 4


def test_the_model_tells_rare_words_apart(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "MODEL", 6)
    monkeypatch.setattr(lm_score, "KNOWN", 30)
    rng, found, train = np.random.default_rng(15), [], lm_score.train_model
    monkeypatch.setattr(lm_score, "train_model", lambda training, vocab, slice_of: found.append((vocab, train(training, vocab, slice_of))) or found[-1][1])
    rows = []
    for i in range(400):  # after red come words that begin with a, after blue those that begin with z
        rows.append((i, " ".join(f"red a{x}" if y else f"blue z{x}" for x, y in zip(rng.integers(0, 10, 60), rng.integers(0, 2, 60), strict=True)) + (f" only{i}" if i % 9 == 0 else "")))
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 40).collect()}
    ((vocab, weights),) = found
    ids = lambda *ws: vocab.encode(vocab.find(list(ws)), list(ws))[:-1]
    score = lambda *ws: gru.score(vocab.shape, weights, [ids(*ws)], vocab.end)[0]
    in_red, in_blue = score(b"red", b"a7") - score(b"red", b"z7"), score(b"blue", b"a7") - score(b"blue", b"z7")
    assert in_red > 1 > -1 > in_blue
    count = collections.Counter(w for i, t in rows if i >= 40 for w in t.split())
    places = {i: vocab.find(t.encode().split()) for i, t in rows}
    far = {w for w in count if w.encode() not in vocab.places}
    assert far and len(vocab.ids) == 5
    twigs = collections.Counter()
    for w in far:
        twigs[vocab.far(w.encode())] += count[w] + 1
    for i, t in rows[:80]:
        ws = t.encode().split()
        want = gru.score(vocab.shape, weights, [vocab.encode(places[i], ws)], vocab.end)[0] / np.log(10)
        want += sum(np.log10((count[w.decode()] + 1) / (twigs[vocab.far(w)] + 1)) for w in ws if w not in vocab.places)
        assert abs(want - got[i].score) < 1e-3


def test_mix_against_its_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["hot", "b", None, "tiny"][int(rng.choice(4, p=[0.6, 0.25, 0.14, 0.01]))]) for i in range(3000)]
    rows += [(None, None, "b"), (1, "w", "B"), (1, "w", "B")]
    got = mixing.mix_sizes(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, times int")).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40  # the largest document


def test_languages_held_out(spark):
    got = registry.op8(spark, SF).filter("held_out").select("doc_id", "lang_pred", "score").collect()
    truth = dict(zip(*(pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang")), strict=True))
    known = [r for r in got if truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in known) >= 0.97 * len(known) and all(0 <= r.score <= 1 for r in got)


def plain_mixture(ll):
    """Languages of one document by the rule of the docstring, a set at a time."""
    size = len(ll)

    def em(chosen):
        share = np.array([1.0 / len(chosen)] * len(chosen))
        for _ in range(language.STEPS):
            p = np.exp(ll[:, chosen] - ll.max(axis=1, keepdims=True)) * share
            new = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-3:
                break
        return share, (np.log((np.exp(ll[:, chosen] - ll.max(axis=1, keepdims=True)) * share).sum(axis=1))).sum()

    chosen = [int(ll.sum(axis=0).argmax())]
    share, best = em(chosen)
    penalty = max(language.LEAST_GAIN, 0.5 * np.log(size))
    while len(chosen) < ll.shape[1]:
        here = ll[:, chosen].max(axis=1)
        rise = {k: np.maximum(ll[:, k] - here, 0).sum() for k in range(ll.shape[1]) if k not in chosen}
        k = max(rise, key=lambda k: (rise[k], -k))
        if rise[k] <= penalty:
            break
        tried = [*chosen, k]
        s, l = em(tried)
        if l - best <= penalty:
            break
        chosen, share, best = tried, s, l
    out = np.zeros(ll.shape[1])
    out[chosen] = share
    return out


def test_mixtures_equal_plain_em():
    rng = np.random.default_rng(8)
    docs = []
    for n in (1, 4, 30, 60, 25):
        ll = rng.normal(-40, 3, (n, 4))
        ll[: n // 2, 0] += 25
        ll[n // 2 :, int(rng.integers(0, 4))] += 25
        docs.append(ll)
    starts = np.cumsum([0, *map(len, docs[:-1])])
    got = language.infer(np.concatenate(docs), np.ones(sum(map(len, docs))), starts)
    for g, ll in zip(got, docs, strict=True):
        assert np.allclose(g, plain_mixture(ll), atol=1e-6)


def plain_line_dedup(rows, least=40, min_docs=5):
    """[(id, text)] -> [(id, n_lines, n_dropped, text)]."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))
    held, top = collections.Counter(), {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k] += 1
                top[k] = max(top.get(k, -1), -1 if i is None else i)
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        kept = [x for x in ls if held[key(x)] < min_docs or top[key(x)] == (-1 if i is None else i)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def shared_lines(rng, n):
    pool = [f"Line number {k} of a pool that many documents share" for k in range(30)]
    rows = []
    for i in range(n):
        own = [f"only in document {i} and in no other one, line {k}" for k in range(2)]
        text = [pool[k].upper() if k % 3 else f" {pool[k]}\t" for k in rng.zipf(1.3, 6) % 30] + own
        rows.append((i, "\n".join(text[int(k)] for k in rng.permutation(len(text)))))
    return [*rows, (None, pool[0]), (3, pool[0]), (n + 1, None), (n + 2, ""), (n + 3, "\n\n"), *[(n + 4, pool[1])] * 40]


@pytest.mark.parametrize("few", [0, 500_000])
def test_line_dedup_equals_plain_python(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)  # lists of lines to drop joined, or sent to all tasks
    rows = shared_lines(np.random.default_rng(9), 150)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_line_dedup(rows))


def test_line_dedup_in_slices(spark, monkeypatch):
    rows = shared_lines(np.random.default_rng(10), 60)
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lines, "SLICE", 7)
    got = lines.dedup_lines(table).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_line_dedup(rows))


def test_joins_hand_small_batches_to_python(spark, monkeypatch):
    conf, seen, sets = "spark.sql.execution.arrow.maxBytesPerBatch", [], ngram_join.document_sets
    before = spark.conf.get(conf)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])})

    def spied(docs, n):
        wide = spark.range(20_000).select(F.expr("repeat('x', 1000)").alias("t")).coalesce(1)
        seen.extend(r.n for r in wide.mapInArrow(shared.releasing(size), "n long").collect())
        return sets(docs, n)

    monkeypatch.setattr(ngram_join, "document_sets", spied)
    ngram_join.similar_components(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert sum(seen) >= 20_000_000 and max(seen) <= shared.BATCH_BYTES + 100_000
    assert spark.conf.get(conf) == before


def test_counters_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1 << 20), (500, 1 << 20), (50_000, 1 << 10)):
        x = np.sort(rng.integers(0, top, n).astype(np.uint32))
        assert ngram_join._from_gaps(ngram_join._gaps(x)).tolist() == x.tolist()
    assert (np.diff(ngram_join._level(np.arange(100_000)).astype(int)) >= 0).all() and ngram_join._level(np.arange(129)).tolist() == list(range(129))


def plain_components(texts, n, percent):
    """{key: text} -> {key: least key of its component}; keys without words stand alone."""
    sets = {}
    for i, t in texts.items():
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in texts}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(texts)
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i: top(i) for i in texts}


@pytest.mark.parametrize(("chunk", "partners"), [(32, 8)])
def test_frequent_ngrams_dealt_in_chunks(spark, monkeypatch, chunk, partners):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "PARTNERS", partners)
    rng = np.random.default_rng(12)
    texts = {}
    for i in range(300):  # groups whose members differ too much from the pivot, and yet link in chains
        base = [f"g{i % 4}w{k}" for k in range(60)]
        at = int(rng.integers(0, 60))
        base[at : at + i % 9] = [f"e{rng.integers(0, 9)}"] * (i % 9)
        texts[i] = " ".join(base)
    got = ngram_join.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == plain_components(texts, 3, 80)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0]), (3, []), (4, None), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 3.0]), (40, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = [tuple(r) for r in ann.search(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 7, 1.0), (0, 3, 20, 0.0), (20, 1, 7, 3.0), (20, 2, 1, 1.0), (20, 3, 0, 0.0)]
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def plain_verdict(text):
    w = words(text)
    n = len(w)
    if n < 20:
        return False
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    repeat = {k + j for k in range(n - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    if 100 * len(repeat) > 30 * n:
        return False
    ls = [x for x in text.split("\n") if words(x)]
    return (
        2 <= sum(map(len, w)) / n <= 20
        and sum(c in "#*$%&|<>" for c in text) / n <= 0.1
        and sum(x.endswith("!!") for x in w) / n <= 0.2
        and sum(x.lower() in quality.STOP_WORDS for x in w) / n >= 0.02
        and (len(ls) - len(set(ls))) / max(len(ls), 1) <= 0.4
    )


def pipeline_rows():
    rng = np.random.default_rng(21)
    shared = "This line stands in very many documents of the corpus, word for word"
    rows = []
    for i in range(140):
        body = " ".join(f"{'the' if k % 5 == 0 else 'w'}{'' if k % 5 == 0 else int(rng.integers(0, 4000))}" for k in range(int(rng.integers(15, 120))))
        rows.append([i, body + ("\n" + shared if i % 3 == 0 else "")])
    for i in range(0, 30, 3):  # exact and near copies
        rows.append([200 + i, rows[i][1]])
        rows.append([300 + i, rows[i + 1][1] + " tail"])
    rows += [[None, rows[2][1] + " of no id"], [None, rows[7][1]], [5, rows[8][1] + " the other text of id five " * 4], [90, rows[90][1]], [400, None], [401, ""], [402, "too short"], [403, "again and again it is the same " * 30], [404, "# " * 300], [405, "the and of to in that this with from have " + " ".join(f"long{k}" for k in range(3000))]]
    return [(i, t, ["a", "b", None, "c"][k % 4], 1, f"x{k}") for k, (i, t) in enumerate(rows)]


def test_pipeline_equals_plain_python(spark, tmp_path, monkeypatch, encode):
    rows = pipeline_rows()
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, hash string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def kept(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir).localCheckpoint()  # a test's own copy, on one machine
            assert name == "pack_sequences" or out.columns == ["doc_id", "text", "source", "n_lines", "hash"]
            seen[name] = [tuple(r) for r in out.collect()]
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, kept(n, f)) for n, f in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = [r for r in rows if plain_verdict(r[1])]
    assert collections.Counter(seen["quality_rules"]) == collections.Counter(first) and len(first) < len(rows)
    dedup = [(i, text, *r[2:]) for (i, _, _, text), r in zip(plain_line_dedup([r[:2] for r in first]), first, strict=True)]
    assert collections.Counter(seen["line_dedup"]) == collections.Counter(dedup) and dedup != first
    texts = {(r[0] is None, r[0] or 0, hashlib.sha1(r[1].encode()).hexdigest()): r[1] for r in dedup}
    label = plain_components(texts, 5, 80)
    one = seen["jaccard_join"]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha1(r[1].encode()).hexdigest())
    assert not collections.Counter(one) - collections.Counter(dedup)
    assert len(one) == len(set(label.values())) < len(dedup) and {label[key(r)] for r in one} == set(label.values())
    least = {}  # the least id of each component stays; null ids only where all are null
    for k, c in label.items():
        least[c] = min(least.get(c, k), k)
    assert {(label[key(r)], r[0]) for r in one} == {(c, None if k[0] else k[1]) for c, k in least.items()}
    mix, sizes = collections.Counter(seen["mix_sources"]), collections.Counter()
    for r in one:
        sizes[r[2]] += len(words(r[1]))
    largest = max(len(words(r[1])) for r in one)
    taken = collections.Counter()
    for r, n in mix.items():
        assert r in one and n <= 3
        taken[r[2]] += n * len(words(r[1]))
    assert all(abs(taken[s] - t) <= largest for s, t in plain_targets(sizes).items())
    want = pieces_of([r[:2] for r in seen["mix_sources"]], encode, 2048)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(k[3] * n for k, n in want.items())
    assert check_places(got, 2048) <= -(-total // 2048) + 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scores_and_languages_of_odd_tables(spark, tmp_path):
    rows = [(i, f"the words of text number {i} and the rest of it " * (1 + i % 3), "en", 1.0, "z") for i in range(40)] + [(None, "the words", "en", 1.0, "z"), (50, None, None, None, None), (51, "", "de", 1.0, "z"), (52, "der die das " * 20_000, "de", 1.0, "z")]
    kind = "doc_id long, text string, lang string, score double, lang_pred string"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    scores = {r.doc_id: r for r in registry.op5(spark, f"{tmp_path}/some").collect()}
    assert len(scores) == len(rows) and scores[50].n_tokens == scores[51].n_tokens == 1 and scores[52].n_tokens == 60_001
    assert scores[None].held_out is False and all(np.isfinite(r.score) and r.score < 0 for r in scores.values())
    found = {r.doc_id: r for r in registry.op8(spark, f"{tmp_path}/some").collect()}
    assert len(found) == len(rows) and found[50].lang_pred == found[51].lang_pred == "und" and found[None].held_out is False
    assert found[52].held_out or found[52].lang_pred == "de"
    assert registry.op5(spark, f"{tmp_path}/none").count() == 0 and registry.op8(spark, f"{tmp_path}/none").count() == 0


def test_no_operator_keeps_local_checkpoints():
    for f in [*Path(ngram_join.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]:
        assert "localCheckpoint" not in f.read_text()
