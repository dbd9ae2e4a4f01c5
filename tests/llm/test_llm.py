import collections
import html
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import hmm_lm, html_text, language, mixing, near_dedup, piece_scan, quality, token_store, topk_search, url_filter
from pointloom.llm import queries as Q
from pointloom.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, ids string"
PROSE = "the quick brown fox jumps over the lazy dog and runs to the river with all of its friends in the morning light"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty texts, ties, repeated rows and columns that clash."""
    long = " ".join(f"{PROSE} {i}" for i in range(400))
    rows = [
        (1, PROSE, "en", "b", 1, 9, "x", "y"), (1, PROSE, "en", "b", 1, 9, "x", "y"), (2, PROSE, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "", ""),
        (4, None, "de", None, None, None, None, None), (None, "das ist ein kurzer Satz und der Hund ist müde", "de", "a", 3, 3, "k", "z"), (5, " \n\t ", None, "b", 2, 2, "k", "z"),
        (6, long, "en", "b", 5, 5, "k", "z"), (7, "!!! 123 ###", "en", "é", 5, 5, "k", "z"), (8, "x" * 3000, "en", "é", 5, 5, "k", "z"), (-9, "le chat est sur la table et le chien est dans la maison", "fr", "z", 1, 1, "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, duck, name):
    same_rows(Q.queries()[name](spark, SF), duck.execute(Q.oracle_sql()[name]))


# 1
def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts, similarity=0.8):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_near_duplicates_as_brute_force(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(12):
        base = rng.choice(vocab, 150).tolist()
        for _ in range(8):
            t = list(base)
            for i in rng.choice(150, int(rng.integers(0, 6)), replace=False):
                t[i] = str(rng.choice(vocab))
            texts[len(texts)] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == classes(texts)


def test_large_group_of_near_copies_as_brute_force(spark):
    """One base with 0 to 30 % of its words replaced: some copies link, some only through others, some to none."""
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    base, texts = rng.choice(vocab, 150).tolist(), {}
    for k in range(240):
        t = list(base)
        for i in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            t[i] = str(rng.choice(vocab))
        texts[k] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    want = classes(texts)
    assert got == want and 20 < len(set(want.values())) < 220


def test_marks_bound_the_difference():
    rng = np.random.default_rng(10)
    for n in (5, 150, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 7).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        odd = int(np.bitwise_count((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64)).sum())
        assert odd <= len(np.setxor1d(a, b)) and (n > 150 or odd >= 0.7 * len(np.setxor1d(a, b)))


def test_near_duplicates_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, PROSE, "a", 1, 2, 3, 4, 5), (2, PROSE, "b", 1, 2, 3, 4, 6), (3, "", None, None, None, None, None, None)], "doc_id long, text string, _id string, _th int, _n int, id int, node int, _own int")
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.filter("doc_id <> 2").collect()))
    assert near_dedup.near_duplicates(df).count() == 3


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[2]["class_size"] == 3 and not by[2]["is_first"]
    assert all(by[i]["class_id"] == i and by[i]["is_first"] for i in (3, 4, 5, 6, 7, 8)) and by[None]["is_first"]
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "None", "5", "6", "7", "8", "-9"])
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("counted", [False, True])
def test_sketch_agrees_with_weighted_similarity(counted):
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa = rng.integers(1, 9, 300).astype(float) if counted else np.ones(300)
    wb = wa.copy()
    wb[:80] = rng.integers(1, 9, 80) if counted else 1
    ia, ib = np.arange(0, 260), np.arange(40, 300)
    full_a, full_b = np.zeros(300), np.zeros(300)
    full_a[ia], full_b[ib] = wa[ia], wb[ib]
    truth = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    s = near_dedup.dart_sketch([e[ia], e[ib]], [wa[ia], wb[ib]], 2000)
    assert abs((s[0] == s[1]).mean() - truth) < 0.05


# 2
def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.mix(none).count() == 0


def test_mix_targets(spark):
    df = Q.op2_mixing(spark, SF)
    rows, again = df.collect(), Q.op2_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for k, d in docs.items()}
    total = collections.Counter()
    for k, d in docs.items():
        total[d["source"]] += size[k]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, whole = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = whole - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * total[s] for s in free if share[s] > 2 * total[s]}
        if not over:
            break
        fixed |= over
    want = fixed | share
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)


def test_rates_are_the_entropy_optimum(spark):
    """The optimum of the sum of binary entropies under a token constraint: odds tilted by one number for each source, and the constraint met."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r["source"]].append((r["size"], r["rate"], r["target"], r["source_size"]))
    for rows in by.values():
        size, rate = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
        target, total = rows[0][2], rows[0][3]
        if target >= 2 * total * (1 - 1e-9):
            assert (rate == 2).all()
            continue
        assert (rate * size).sum() == pytest.approx(target, rel=1e-3)
        inner = (size > 0) & (rate > 1e-9) & (rate < 2 - 1e-9)
        tilt = np.log(rate[inner] / (2 - rate[inner])) / size[inner]
        assert tilt == pytest.approx(np.full(inner.sum(), np.median(tilt)), rel=1e-6, abs=1e-12)
        # no exchange of tokens between two documents raises the entropy
        h = lambda x: -(x / 2) * np.log(x / 2) - (1 - x / 2) * np.log(1 - x / 2)
        some = np.flatnonzero(inner)[:40]
        for i, j in itertools.combinations(some.tolist(), 2):
            step = 1e-4 * min(rate[i], 2 - rate[i], rate[j], 2 - rate[j]) * min(size[i], size[j])
            for s in (step, -step):
                assert h(rate[i] + s / size[i]) + h(rate[j] - s / size[j]) <= h(rate[i]) + h(rate[j]) + 1e-12


# 3
def test_quality_of_odd_rows(odd, none):
    rows = quality.quality(odd).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["base_failed"] for r in rows}[4] is True
    assert quality.quality(none).count() == 0


def test_repeat_words(spark):
    cases = ["a b c d e a b c d e", "a a a a a a", "a b c d e", "a b c d e f g x a b c d e f y", ""]

    def brute(t):
        w = t.split()
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)})

    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality(df).collect()} == {i: brute(t) for i, t in enumerate(cases)}


# 4
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li>m</li></ul></nav>
<div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One  two<br><p>Three&nbsp;&eacute; x &lt; y</p><div class="related-links">more</div><form>f<input></form><section id="comments"><p>nice</p></section></article>
<aside>side</aside><div class="cookie-notice">ok</div><footer>&copy; end</footer></body></html>"""


def test_article():
    assert [t for _, t in html_text.blocks(PAGE)] == ["Head & line", "One two", "Three é x < y"]


def test_parts_by_name():
    text = lambda p: [t for _, t in html_text.blocks(p)]
    assert text('<article class="post has-sidebar"><div class="entry-header"><h1>H</h1></div>a<br>b<hr>c<article class="comment">no</article></article>') == ["H", "a b", "c"]
    assert text('<div class="siteFooter">x</div><div class="side-by-side">y</div><div id="page_comments">z</div>') == ["y"]


def test_broken_and_unquoted_markup():
    text = lambda p: [t for _, t in html_text.blocks(p)]
    assert text("<article><p title=it's>Hello world</p><p>He doesn't know</p></article>") == ["Hello world", "He doesn't know"]
    assert text("<article><p data=5'>one</p><p data='6>two</p><p>three</p></article>") == ["one", "two", "three"]
    assert text('<div class="content-header"><h1>Head</h1></div><div class="site-header">Top</div><div class="header">Top</div><p>x</p>') == ["Head", "x"]
    assert text('<article><p class="promo-code-text">use it</p><p class="promo">buy</p><p><label>Name</label> of it</p></article>') == ["use it", "Name of it"]
    import time

    began = time.time()
    assert len(text("<article>" + "<a href=\"x>y " * 40_000 + "</article>")) <= 1 and time.time() - began < 5


def reference_text(page):
    """The article of a page by Python's own parser: outer parts left out, one block for each block element."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.held, self.inside, self.skip = [], [], 0, []

        def flush(self):
            t = " ".join("".join(self.held).split())
            self.held = []
            if t and self.inside:
                self.blocks.append(t)

        def handle_starttag(self, tag, attrs):
            if tag in ("article", "main"):
                self.flush()
                self.inside += 1
            elif tag == "br":
                self.held.append(" ")
            elif tag in ("p", "h1", "h2", "h3", "div", "ul", "ol", "li", "section", "table", "tr", "td", "blockquote", "pre", "figure"):
                self.flush()
            if tag in ("script", "style", "nav", "aside", "form", "footer", "header") or any(w in (dict(attrs).get("class") or "").split() for w in ("ad", "comments", "cookie", "sidebar", "share", "related")):
                self.flush()
                self.skip.append(tag)
            elif self.skip and tag == self.skip[-1]:
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if self.skip and tag == self.skip[-1]:
                self.held = []
                self.skip.pop()
            elif tag not in ("b", "i", "em", "strong", "a", "span", "br"):
                self.flush()
            if tag in ("article", "main"):
                self.inside -= 1

        def handle_data(self, data):
            if not self.skip:
                self.held.append(data)

    r = Reader()
    r.feed(page or "")
    r.flush()
    return "\n\n".join(r.blocks)


def test_pages_as_another_parser_reads_them(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = Q.op4_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == reference_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_short_blocks_go_if_half_of_the_host_has_them(spark):
    rng = np.random.default_rng(15)
    own = [" ".join(f"word{k}" for k in rng.integers(0, 10**6, 20)) for _ in range(8)]
    rows = [(i, "http://s.org/", f"<div>Read more</div><p>{w}</p>" + ("<p>Chapter one</p>" if i < 3 else "")) for i, w in enumerate(own)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    assert got == {i: w + ("\n\nChapter one" if i < 3 else "") for i, w in enumerate(own)}


def test_pages(spark):
    boiler = "this site belongs to the league of examples and keeps all rights for itself"
    rows = [(i, "http://a.org/x", f"<div>{boiler}</div><div>unique words of page number {i} which nobody else has {i} {i}</div>") for i in range(6)]
    rows += [(10, "http://b.org/", PAGE), (11, None, None), (12, "http://b.org/", ""), (10, "http://b.org/", PAGE), (None, "http://a.org/y", "<p>short</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert len(got) == len(rows) and len(by[10]) == 2 and by[11] == [""] and by[12] == [""] and by[None] == ["short"]
    assert all("rights" not in by[i][0] and f"page number {i}" not in by[(i + 1) % 6][0] for i in range(6))
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_open_pages_keep_sentences_and_mirrors(spark):
    boiler = "all rights of this site are held by the league of examples until further notice is given"
    own = [" ".join(f"word{k}" for k in np.random.default_rng(i).integers(0, 10**6, 30)) for i in range(5)]
    sentence = [f"{w} at the end of the long day {w[::-1]}" for w in own]  # seven tokens that recur inside sentences
    text = [f"{s}\n\n{boiler} {w}" for s, w in zip(sentence, own, strict=True)]  # a repeat that covers a part of a block
    page = [f"<div>{s}</div><p>{boiler} {w}</p><p>{boiler}</p>" for s, w in zip(sentence, own, strict=True)]
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(page)]
    rows += [(10 + k, f"http://h.org/mirror/{k}", page[0]) for k in range(4)] + [(20 + k, f"http://m.org/{k}", page[1]) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(5)] == text and all(got[10 + k] == text[0] for k in range(4))
    assert all(got[20 + k] == f"{text[1]}\n\n{boiler}" for k in range(4))  # one text on its host, though four pages


def test_intervals_count_distinct_pages():
    words = " ".join(f"w{k}" for k in range(html_text.RUN))
    batch = pa.RecordBatch.from_pydict({"key": pa.array([5, 5, 7, 8, 9, 1], pa.int64()), "host": ["a"] * 5 + ["b"], "open": [[words, words]] * 6})
    (out,) = html_text._intervals(iter([batch]))
    assert not any(r["short"] for r in out.to_pylist())
    rows = [(r["host"], r["page"]) for r in out.to_pylist()]
    assert sorted(rows) == [("a", 5), ("a", 7), ("a", 8), ("b", 1)] and len({r["h"] for r in out.to_pylist()}) == 1


def test_suffix_intervals_as_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        codes, owner = rng.integers(0, 3, 60), np.sort(rng.integers(0, 4, 60))
        order, rank, whole = html_text.truncated_suffix_array(codes, owner, 5)
        key = lambda i: [c for c, o in zip(codes[i : i + 5].tolist(), owner[i : i + 5].tolist(), strict=True) if o == owner[i]]
        assert all(key(a) <= key(b) for a, b in zip(order.tolist(), order.tolist()[1:], strict=False))
        assert whole.tolist() == [len(key(i)) == 5 for i in range(60)]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_plain_text_survives(t):
    want = [" ".join(html.unescape(x).split()) for x in [html.escape(t)]]
    assert [x for _, x in html_text.blocks(f"<article><p>{html.escape(t)}</p></article>")] == [x for x in want if x]


# 5
@pytest.fixture(scope="module")
def pieces():
    return piece_scan.Pieces(Q.tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abethion rs\n é日▁\t", min_size=1, max_size=120), st.integers(3, 40))
def test_scan_is_the_library(pieces, t, size):
    want = pieces.sp.encode(t)
    assert pieces.encode(t).tolist() == want and piece_scan.scan(pieces, t, size).tolist() == want


def test_matrices_combine_in_any_order(pieces):
    prepared = piece_scan.prepare("theinterationsofnothing " * 6)
    m = [set(piece_scan.Chunk(pieces, *piece_scan.chunk_of(pieces, prepared, n, 9)).matrix()) for n in range(-(-len(prepared) // 9))]
    left = m[0]
    for x in m[1:]:
        left = piece_scan.product(left, x)
    right = m[-1]
    for x in m[-2::-1]:
        right = piece_scan.product(x, right)
    assert left == right == {(0, 0)}


def test_encode_odd_rows(spark, odd, none, pieces):
    model = Q.tokenizer_path("piece_bpe_32k.model")
    got = piece_scan.encode(odd, model, size=500).collect()
    assert len(got) == odd.count() and max(r["n_chunks"] for r in got) > 50
    assert all(r["ids"] == pieces.sp.encode(r["text"] or "") for r in got)
    assert all(r["round_trip"] for r in piece_scan.with_digest(piece_scan.encode(odd, model, size=500), model).collect())
    assert piece_scan.encode(none, model).count() == 0
    plain = lambda df: sorted(map(str, df.select("doc_id", "n_chunks", "n_tokens", "ids_crc32", "round_trip").collect()))
    assert plain(piece_scan.encode_to_digest(odd, model, size=500)) == plain(piece_scan.with_digest(piece_scan.encode(odd, model, size=500), model))


def test_piece_digest_as_whole_texts(spark, pieces):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op5_piece_scan(spark, SF).collect()
    assert len(rows) == len(texts) and any(r["n_chunks"] > 1 for r in rows)
    for r in rows:
        ids = pieces.sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert r["n_chunks"] == max(1, -(-(len(texts[r["doc_id"]]) + 1) // piece_scan.CHUNK)) or r["n_chunks"] == 1
        assert r["round_trip"] == (pieces.sp.decode(ids) == texts[r["doc_id"]].replace("▁", " "))


# 6
def test_languages(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert held["a"] > 0.95 and 0 <= held["lo"] and held["hi"] <= 1
    model = language.fit(odd, "text", "lang", "doc_id")
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["lang_pred"] for r in rows}[4] == "und" and {r["doc_id"]: r["lang_pred"] for r in rows}[7] == "und"
    assert language.predict(odd, language.fit(none, "text", "lang", "doc_id")).filter("lang_pred <> 'und'").count() == 0


def test_language_as_a_second_scorer(spark):
    """Every label and score by plain sums over the model, and the model by plain counts; capitals outside A-Z count as small ones."""
    rows = [(1, "Élan vital élan été", "fr"), (2, "the end the END", "en"), (3, "été the", "fr"), (4, "xy zq the", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, gram string")
    model = language.fit(df, "text", "lang", "doc_id")
    assert model.langs == ["en", "fr"] and set(model.words) == {"élan", "the", "end", "été"}
    c = {l: collections.Counter(w for _, t, x in rows if x == l for w in t.lower().split()) for l in ("en", "fr")}  # noqa: E741
    total = {l: sum(c[l][w] + 0.5 for w in model.words) for l in c}  # noqa: E741
    for w, i in model.words.items():
        assert model.word_scores[i] == pytest.approx([math.log((c[l][w] + 0.5) / total[l]) for l in ("en", "fr")], rel=1e-5)  # noqa: E741
    g = {l: collections.Counter(x for w, k in c[l].items() for n in range(1, 5) for x in language.grams_of(w, n) for _ in range(k)) for l in c}  # noqa: E741
    assert set(model.grams) == set(g["en"]) | set(g["fr"])
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    for i, t, _ in rows:
        sums = np.zeros(2)
        shares = []
        for w in t.lower().split():
            if w in model.words:
                v = model.word_scores[model.words[w]]
            else:
                order = next((n for n in range(4, 0, -1) if any(x in model.grams for x in language.grams_of(w, n))), None)
                v = np.zeros(2) if order is None else np.mean([model.gram_scores[model.grams[x]] for x in language.grams_of(w, order) if x in model.grams], axis=0)
            sums += v
            shares.append(np.exp(v) / np.exp(v).sum())
        best = int(np.argmax(sums))
        assert got[i]["lang_pred"] == model.langs[best] and got[i]["score"] == pytest.approx(np.mean(shares, axis=0)[best], rel=1e-5)


# 7
def test_top_k_as_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).round(1)
    x[200:260] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1100, [1.0, 2.0])]
    got = collections.defaultdict(list)
    for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    v = np.floor(1024 * x).astype(int)
    for q in range(0, 900, 100):
        s = v @ v[q]
        want = sorted(((int(a), i) for i, a in enumerate(s) if i != q), key=lambda p: (-p[0], p[1]))[:10]
        assert got[q] == want
    assert set(got) == set(range(0, 900, 100))


def test_top_k_of_large_components(spark):
    """Components of 1e9, 1e13 and 1e300 take part, exactly, beside small ones and columns that clash."""
    rng = np.random.default_rng(13)
    x = [rng.normal(size=4).tolist() for _ in range(40)] + [(rng.normal(size=4) * 1e9).tolist() for _ in range(4)] + [(rng.normal(size=4) * 1e13).tolist() for _ in range(4)]
    x[0], x[45], x[5] = [1e9, -3.0, 2.5, 0.0], [1e300, 0.0, 0.0, 0.0], [-1e300, 1.0, 0.0, 0.0]
    rows = [(i * 5, v, "a", 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, pivot int")
    ints = [[math.floor(c * 1024) if abs(c) < 2.0**43 else int(c) * 1024 for c in v] for v in x]
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, every=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 240, 20))
    for q in got:
        scores = sorted(((-sum(a * b for a, b in zip(ints[q // 5], v, strict=True)), i * 5) for i, v in enumerate(ints) if i * 5 != q))[:10]
        assert got[q] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scores]


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(14)
    x = (rng.normal(size=(12, 6)) * 5)[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(1024 * x).astype(np.int64)
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, every=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in range(0, 1500, 20):
        assert got[q] == sorted(((int(a), i) for i, a in enumerate(v @ v[q]) if i != q), key=lambda p: (-p[0], p[1]))[:10]


def test_top_k_of_nothing(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(4).normal(size=(500, 3))
    root = topk_search.cover_tree(x)
    todo, seen = [root], []
    while todo:
        n = todo.pop()
        assert (np.linalg.norm(x[n.points] - n.centre, axis=1) <= n.radius + 1e-9).all()
        if n.children:
            assert sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points)
            todo += n.children
        else:
            seen += n.points.tolist()
    assert sorted(seen) == list(range(500))


# 8
def test_likelihood_is_the_sum_over_paths():
    rng = np.random.default_rng(5)
    p = hmm_lm.first_params(np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES))
    seqs = [rng.integers(0, hmm_lm.CLASSES, n) for n in (1, 2, 4, 3)]
    want = []
    for s in seqs:
        total = 0.0
        for path in itertools.product(range(hmm_lm.STATES), repeat=len(s)):
            v = p.start[path[0]] * p.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                v *= p.move[a, b] * p.emit[o, b]
            total += v
        want.append(math.log10(total))
    assert hmm_lm.log_likelihoods(p, seqs) == pytest.approx(want)


def test_training_raises_likelihood():
    rng = np.random.default_rng(6)
    freq = np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES)
    seqs = [rng.integers(0, 50, 100) + 1000 * (i % 2) for i in range(20)]
    p, last = hmm_lm.first_params(freq), -np.inf
    for _ in range(5):
        *counts, log = hmm_lm.expected(p, seqs)
        assert log > last - 1e-6 and counts[2].sum() == pytest.approx(2000)
        last, p = log, hmm_lm.updated(*counts, freq * 1e-9)


def test_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(11)
    p = hmm_lm.first_params(np.full(hmm_lm.CLASSES, 1 / hmm_lm.CLASSES))
    seqs = [rng.integers(0, hmm_lm.CLASSES, n) for n in (1, 700, 256, 257, 30, 2000, 512)]
    cut = hmm_lm.expected(p, seqs)
    monkeypatch.setattr(hmm_lm, "SEGMENT", 10**6)
    for a, b in zip(cut, hmm_lm.expected(p, seqs), strict=True):
        assert np.asarray(a) == pytest.approx(np.asarray(b), rel=1e-9, abs=1e-12)
    assert cut[3] == pytest.approx(math.log(10) * hmm_lm.log_likelihoods(p, seqs).sum())


def test_matrices_only_between_the_ends_of_a_text(monkeypatch):
    # a text of two segments needs no matrix, one of five needs those of three; the counts are those of whole texts
    rng, asked, transfer = np.random.default_rng(3), [], hmm_lm._transfer
    p = hmm_lm.first_params(rng.dirichlet(np.ones(hmm_lm.CLASSES)))
    seqs = [rng.integers(0, hmm_lm.CLASSES, n) for n in (3, 20, 31, 33, 70)]
    whole = hmm_lm.expected(p, seqs)
    monkeypatch.setattr(hmm_lm, "SEGMENT", 16)
    monkeypatch.setattr(hmm_lm, "_transfer", lambda p, flat, starts, active: asked.append(len(starts)) or transfer(p, flat, starts, active))
    for a, b in zip(hmm_lm.expected(p, seqs), whole, strict=True):
        assert np.allclose(a, b, rtol=1e-9)
    assert asked == [1 + 3]


def test_score_as_plain_sums(spark, monkeypatch):
    """score and base_score of small texts by the formulas, with few known tokens, so that the join serves the rest."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(hmm_lm, "KNOWN", 5)
    texts = [" ".join(f"T{k}" for k in rng.geometric(0.08, int(rng.integers(0, 40)))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 4 == 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, out boolean, h string")
    counts = hmm_lm.token_counts(docs.filter("not out"), "text")
    model = hmm_lm.fit(docs.filter("not out"), "text", counts)
    c = {r["h"]: r["c"] for r in counts.collect()}
    for r in hmm_lm.score(docs, F.col("out")).collect():
        words = texts[r["doc_id"]].encode().lower().split()
        cls = [model.vocabulary.head.get(hmm_lm.hash_of(w), hmm_lm.HEAD + hmm_lm.tail_of(w)) for w in words] + [hmm_lm.END_CLASS]
        want = hmm_lm.log_likelihoods(model.params, [np.array(cls)])[0]
        for w, k in zip([*words, hmm_lm.END], cls, strict=True):
            want += math.log10(c.get(hmm_lm.hash_of(w), 0) + 1) - model.vocabulary.log_d[k]
        assert r["score"] == pytest.approx(want)


def test_scores(spark, odd, none):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [hmm_lm.END] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = zlib.crc32
    held = {k: out(str(k).encode()) % 7 == 2 for k in docs}
    c = collections.Counter(t for k, ts in docs.items() if not held[k] for t in ts)
    n, v = sum(c.values()), len(c)
    rows = Q.op8_hmm_lm(spark, SF).collect()
    assert len(rows) == len(docs)
    better = 0
    for r in rows:
        ts = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(t in c for t in ts), n, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        better += r["held_out"] and r["score"] > r["base_score"]
    assert better > 0.8 * sum(held.values())
    assert hmm_lm.score(odd, crc_mod(F.col("doc_id"), 7) == 2).count() == odd.count()
    assert hmm_lm.score(odd, F.lit(True)).filter("base_score <> 0").count() == 0
    assert hmm_lm.score(none, F.lit(False)).count() == 0


def test_every_step_sees_all_texts(spark):
    rng = np.random.default_rng(7)
    texts = ["one text that a third of the rows copy"] * 2000 + [" ".join(f"w{k}" for k in rng.integers(0, 40, 6) + 40 * (i % 3)) for i in range(4000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = hmm_lm.fit(docs, "text", hmm_lm.token_counts(docs, "text"))
    freq = model.vocabulary.freq
    codes = [np.array([model.vocabulary.head[hmm_lm.hash_of(w)] for w in t.encode().split()] + [hmm_lm.END_CLASS]) for t in texts]
    p = hmm_lm.first_params(freq)
    for _ in range(14):
        p = hmm_lm.updated(*hmm_lm.expected(p, codes)[:3], freq)
    for name in ("start", "move", "emit"):
        assert getattr(model.params, name) == pytest.approx(getattr(p, name), rel=1e-6, abs=1e-12)


# 9
def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    assert len(cascade.levels) > 1
    assert url_filter.with_member(keys.withColumnRenamed("listed", "truth"), "key", cascade).filter("truth <> listed").count() == 0


def test_urls(spark):
    rows = [(1, "http://Example.COM/en/7x"), (2, "https://a.example.com/en/1"), (3, "ftp://x.net/de/1?q"), (4, "http://example.net/de/8#f"), (5, None), (6, "nothing"), (7, "http://bad.org/fr"), (8, "x://notexample.com"), (9, "http://com/en/"), (9, "http://com/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, spark.createDataFrame([("bad.org",), ("unused.org",)], "host string")).collect()}
    assert got == {
        1: ("example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("a.example.com", "/en/1", "com/en/", "block"), 3: ("x.net", "/de/1", "net/de/", "allow"),
        4: ("example.net", "/de/8", "example.net/de/8", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("bad.org", "/fr", None, "block"),
        8: ("notexample.com", "", None, "allow"), 9: ("com", "/en/", "com/en/", "block"),
    }
    assert url_filter.filter_urls(df.limit(0), spark.createDataFrame([], "host string")).count() == 0


def test_many_listed_hosts_take_several_cascades(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 1500, F.lit(".org/")).alias("url"))
    listed = spark.range(0, 1500, 3).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"))
    for bits in (1 << 20, 2048):
        out = url_filter.filter_urls(df, listed, most_bits=bits)
        assert out.count() == 3000 and out.filter((F.col("verdict") == "block") != (F.col("page_id") % 1500 % 3 == 0)).count() == 0


# 10
def test_part_round_trip(tmp_path):
    import zstandard

    rng = np.random.default_rng(7)
    docs = [(i if i % 5 else None, rng.integers(0, 60000, int(n)).astype("<u2")) for i, n in enumerate([0, 1, 500, 7000, 3, 0, 2500])]
    data = token_store.part_bytes(docs, 2, 1000)
    f = tmp_path / "p.zst"
    f.write_bytes(data)
    with f.open("rb") as file:
        r = token_store.Reader(file, len(data))
        for i in (3, 0, 6, 2, 1, 5, 4):
            assert r.document(i).tolist() == docs[i][1].tolist() and bool(r.nulls[i]) == (docs[i][0] is None)
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    got = b""
    while len(got) < 2 * sum(len(d[1]) for d in docs):
        got += plain.read(1 << 20)
    assert got == b"".join(d[1].tobytes() for d in docs)
    n = struct.unpack_from("<I", data, len(data) - 9)[0]
    broken = bytearray(data)
    broken[len(data) - 9 - 12 * n + 8] ^= 1  # the first frame's checksum
    f.write_bytes(broken)
    with f.open("rb") as file, pytest.raises(ValueError):
        token_store.Reader(file, len(broken)).document(1)


def test_store(spark, odd, none):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = token_store.stored(odd, path, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, -9, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    texts, at = {r["doc_id"]: r["text"] or "" for r in odd.collect()}, 0
    for r in rows:
        ids = [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.stored(none, path, 2).count() == 0
    same = spark.createDataFrame([(None, f"text {i}", "x", 1) for i in range(400)], "doc_id long, text string, part string, start int")
    many = token_store.stored(same, path, 2)
    assert many.count() == 400 and many.agg(F.max("start")).first()[0] == many.agg(F.sum("n_tokens") - F.max_by("n_tokens", "start")).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBc'tsé.,!É \n\tßẞΣH̱日", max_size=60))
def test_words_are_the_library(t):
    c = token_store.coder(Q.tokenizer_path("word_bpe_49k.json"), None)
    assert c.many([t])[0].tolist() == c.tok.encode(t, add_special_tokens=False).ids


def test_frames_of_article_pages_tell_boilerplate(spark):
    line = "this site belongs to the league of examples and keeps all rights for itself"
    own = [" ".join(f"word{k}" for k in np.random.default_rng(70 + i).integers(0, 10**6, 20)) for i in range(5)]
    rows = [(i, "http://f.org/", f"<article><p>{own[i]}</p><p>{own[4]}</p></article><footer>{line} <b>{i}</b></footer><div class='ad'>{line}</div>") for i in range(3)]
    rows += [(3, "http://f.org/", f"<div>{own[3]}</div><p>{line}</p><p>{own[4]}</p>"), (4, "http://g.org/", f"<div>{own[3]}</div><p>{line}</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert [got[i] for i in range(3)] == [f"{own[i]}\n\n{own[4]}" for i in range(3)]
    # the line goes where the host's frames repeat it, what its articles repeat stays
    assert got[3] == f"{own[3]}\n\n{own[4]}" and got[4] == f"{own[3]}\n\n{line}"
