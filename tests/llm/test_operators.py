"""The corpus operators on small tables with nulls, empty texts, repeated rows and clashing columns, against plain Python."""

import collections
import io
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenfreq.llm import ann, frames, gru, html_text, language, lines, lm_score, mixing, ngram_join, packing, perfect, quality, tokens

LINE = "A line that is long enough to be a key of forty characters"
TEXT = " ".join(f"word{i} the of and" for i in range(30))
ROWS = (
    [(i, f"{LINE}\nown {i}\n {LINE.upper()} ", "en", "a", 1) for i in range(6)]
    + [(10, None, None, None, 1), (11, "", "en", "b", 1), (12, " \n\t", "de", "b", 1), (13, TEXT, "en", "b", 1), (14, TEXT + " more", "en", None, 1), (14, TEXT + " more", "en", None, 1)]
    + [(15, "x " * 5000, "de", "c", 1), (16, "naïve ünïcode <|endoftext|> don't stop 'S ß", "de", "c", 1), (None, "no id here", "de", "c", 1)]
)
SCHEMA = "doc_id long, text string, lang string, source string, n_lines long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_shards_round_trip(spark, docs, none):
    m = tokens.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    got = sorted(map(tuple, tokens.read_shards(spark, m).collect()), key=lambda r: r[1])
    enc, at, want = tokenizer("word_bpe_49k.json"), 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*enc(t), 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.read_documents(m, [13]).count() == 1
    assert tokens.read_shards(spark, tokens.write_shards(none, public_tokenizers.path("word_bpe_49k.json"), 1)).count() == 0


def test_a_damaged_frame_is_noticed():
    out = io.BytesIO()
    w = frames.ShardWriter(out)
    w.add(1, np.arange(1000))
    w.add(None, np.zeros(0))
    w.close()
    r = frames.ShardReader(io.BytesIO(out.getvalue()))
    assert r.document(0).tolist() == list(range(1000)) and not len(r.document(1)) and r.ids == [1, None]
    bad = bytearray(out.getvalue())
    bad[40] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's own checksum or ours
        frames.ShardReader(io.BytesIO(bytes(bad))).document(0)


def test_perfect_hash_is_minimal():
    a, b = np.random.default_rng(1).integers(0, 2**63, (2, 5000)).astype("u8")
    m, _ = perfect.load(perfect.save(perfect.PerfectHash.build(a, b)))
    assert sorted(m.find(a, b)) == list(range(5000))


def test_line_dedup(docs, none):
    got = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(r.n_dropped for r in got if r.doc_id is not None and r.doc_id < 6) == [0, 2, 2, 2, 2, 2]
    assert {r.doc_id: r.n_dropped for r in got}[5] == 0
    assert {r.doc_id: r.text for r in got}[3] == "own 3"
    assert len(got) == len(ROWS) and {r.doc_id: r.n_lines for r in got}[10] == 1
    assert lines.dedup_lines(none).count() == 0


def test_packing(docs, none):
    enc = tokenizer("byte_bpe_50k.json")
    got = packing.pack(tokens.encode_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 256), 256).collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 256
    assert sum(r.length for r in got) == sum(len(enc(r[1] or "")) + 1 for r in ROWS)
    assert packing.pack(tokens.encode_pieces(none, public_tokenizers.path("byte_bpe_50k.json"), 0, 256), 256).count() == 0


def test_two_for_one():
    plan = packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)
    assert plan[0] == (1, {6: 1, 2: 2})


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    assert got[13].kept and not got[15].kept and got[15].n_repeat_words == 5000 and got[10].n_words == 0 and got[10].base_failed
    assert quality.keep_quality(docs).columns == docs.columns and quality.keep_quality(none).count() == 0


def test_language(docs, none):
    names, model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, names, model).collect()}
    assert names == ["de", "en"] and got[13].lang_pred == "en" and got[10].lang_pred == "und" and got[12].lang_pred == "und" and got[11].score == 0
    names, model = language.train(none)
    assert {r.lang_pred for r in language.identify(docs, names, model).collect()} == {"und"}


def test_lm_scores(docs):
    got = {(r.doc_id, r.n_tokens): r for r in lm_score.score(docs, docs["doc_id"] != 16).collect()}
    c = collections.Counter()
    for i, t, *_ in ROWS:
        if i is not None and i != 16:
            c.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    w = [*ROWS[-2][1].encode().lower().split(), b""]
    r = got[16, len(w)]
    assert r.n_known == sum(c[x] > 0 for x in w) and r.train_tokens == n
    assert abs(r.base_score - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-9 and r.score < 0


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    found, train = [], lm_score.train_model
    monkeypatch.setattr(lm_score, "train_model", lambda training, vocab, slice_of: found.append((vocab, train(training, vocab, slice_of))) or found[-1][1])
    lm_score.score(spark.createDataFrame([(i, f"own{i} the of " * 4) for i in range(40)], "doc_id long, text string"), __import__("pyspark").sql.functions.col("doc_id") < 36)
    ((vocab, weights),) = found
    before, after = (gru.unflat(vocab.shape, w)["x"] for w in (gru.start(vocab.shape, vocab.counts), weights))
    assert all((before[vocab.ids[b"own%d" % i]] != after[vocab.ids[b"own%d" % i]]).any() for i in range(36))


def test_components(docs, none):
    got = {r.doc_id: r for r in ngram_join.similar_components(docs, 3, 90).collect()}
    assert got[13].component_id == got[14].component_id == 13 and got[10].n_shingles == 0 and got[10].component_id == 10
    assert ngram_join.similar_components(none, 3, 90).count() == 0
    assert ngram_join.keep_one_of_each(docs, 3, 90).filter("doc_id in (13, 14)").count() == 1


def test_one_of_each_keeps_what_is_no_copy(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("e")), (9, text("e") + " more"), (9, text("e") + " more"), (3, ""), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, ngram_join.keep_one_of_each(table, 3, 90).collect()))
    one_of = {r for r in got if r[1] in (rows[1][1], rows[2][1])}
    assert len(one_of) == 1 and got == collections.Counter([rows[0], rows[3], rows[4], rows[5], rows[9], rows[10], *one_of])


def test_mix(docs, none):
    got = mixing.mix_sizes(docs).collect()
    by = collections.defaultdict(int)
    for r in got:
        by[r.source] += r.taken
        assert r.taken <= 3 * r.size
    total = sum(len((r[1] or "").split()) for r in ROWS)
    assert abs(sum(r.target for r in {r.source: r for r in got}.values()) - total) < 30
    assert sorted(map(tuple, mixing.mix_sizes(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix_sizes(none).count() == 0


def test_html():
    page = "<title>t</title><nav><a href=x>m</a></nav><article><h1>T</h1><p>One,  two &amp; three<p>Four<br>five</article><footer>f</footer><p"
    assert html_text.extract(page) == "T\nOne, two & three\nFour five"
    assert html_text.extract(None) == html_text.extract("<p") == ""


@pytest.mark.parametrize("attrs", [
    'class="site-content no-sidebar"', 'class="content has-sidebar"', 'class="layout with-sidebar"', 'class="post has-comments"', 'class="page menu-open"', 'class="post overflow-hidden"', 'data-title="the hidden city"', "class=sidebar-layout",
])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_wrappers_that_only_sound_like_something_else(attrs, inner):
    rest = '<div class="ad">Buy, buy, buy</div><p hidden>Unseen</p><p style="display:none">Unseen too</p><div class="related-posts"><p>Other, more</p></div><div class="comments"><p>First, comment</p></div>'
    page = f"<body><div {attrs}><{inner}><h1>T</h1><p>One, two, three, four</p><p>Five, six, seven</p></{inner}>{rest}</div></body>"
    assert html_text.extract(page) == "T\nOne, two, three, four\nFive, six, seven"


def test_html_scores_decide_without_names():
    filler = "<p>One, two, three, four and more words of a sentence, as they come.</p>" * 3
    page = (
        "<head><title>t</title></head><body><ul><li><a href=a>Home</a></li><li><a href=b>More</a></li></ul><div>Buy this.</div>"
        f"<TAG><h1>Title</h1>{filler}</TAG><div>Copyright, all rights.</div></body>"
    )
    want = "Title" + "\nOne, two, three, four and more words of a sentence, as they come." * 3
    for tag in ("article", "main", "div", "section"):
        assert html_text.extract(page.replace("TAG", tag)) == want
        assert html_text.extract(page.replace("TAG", tag), blacklist=False) == want
    # An article element is no trump: here it holds a teaser, and the text is elsewhere.
    assert html_text.extract(f"<body><article><p>Teaser.</p></article><div><h1>T</h1>{filler * 2}</div></body>").startswith("T\nOne, two")


def test_html_given_pages_by_scores_alone():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        want = html_text.extract(page)
        assert html_text.extract(page.replace("<article", "<div").replace("</article", "</div"), blacklist=False) == want


@pytest.mark.parametrize("page", ["<div>x, " * 100_000, "<b>" + "<div>x</b></p></span>" * 50_000, "<center><li>" * 50_000, "<span>x " * 100_000 + "<p>y" * 50_000])
def test_html_deep_pages_take_time_in_line_with_their_length(page):
    t = time.process_time()
    html_text.extract(page)
    assert time.process_time() - t < 20


def test_html_tables(spark):
    rows = [(1, "u", "<article><p>a &amp; b</p></article>", "old"), (2, None, None, None), (None, "v", "", "x"), (1, "u", "<article><p>a &amp; b</p></article>", "old")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = html_text.extract_pages(t)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "a & b", 5), (2, None, "", 0), (None, "v", "", 0), (1, "u", "a & b", 5)], key=str)
    assert html_text.extract_pages(t.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8)]
    got = collections.defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), __import__("pyspark").sql.functions.col("vec_id") % 20 == 0, 20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 400, 20):
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(400), -s))[:20]) & set(got[q]))
        assert len(got[q]) == 20
    assert hit >= 0.9 * 400 and 400 not in got and 402 not in got


def test_neighbours_of_vectors_without_clusters(spark, monkeypatch):
    """Many short lists stand for a large table: no fixed number of lists is enough."""
    monkeypatch.setattr(ann, "LIST", 8)
    x = np.random.default_rng(5).standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, __import__("pyspark").sql.functions.col("vec_id") % 40 == 0, 20).collect()
    s = x[::40] @ x.T
    s[np.arange(150), np.arange(0, 6000, 40)] = -np.inf
    want = {(40 * q, int(i)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :20]) for i in row}
    recall = len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)
    assert recall >= 0.9


def _brute_components(texts: dict[int, str], n: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in texts}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: top(i) for i in texts}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_groups_that_share_frequent_ngrams(spark, n, percent):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(80)]
    texts = {}
    for i in range(260):
        words = list(base[: 80 - i % 7]) if i % 3 else base[:20] + [f"v{i % 2}x{k}" for k in range(60)]
        for k in rng.integers(0, len(words), i % 5):
            words[k] = f"e{rng.integers(0, 40)}"
        texts[1000 - i] = " ".join(words)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n, percent).collect()}
    assert got == _brute_components(texts, n, percent)
    assert len(set(got.values())) < len(got)
