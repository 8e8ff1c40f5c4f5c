"""HTML extraction, n-gram join, decontamination and the pipeline against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import pairwise

import pytest

from tidewatch.llm import common, decontamination, html_extract, ngram_join
from tidewatch.llm.common import stored
from tidewatch.llm.components import connected_components

PAGE = """<html><head><title>t</title><style>p{x}</style></head><body><header class="site-header"><h1>Site</h1><a href="/">Home</a></header>
<div id="cookie-notice">We use cookies on this site. Please accept them to go on.</div><div class="sidebar"><h3>Popular</h3><ul><li><a href=a>One thing</a><li><a href=b>Two</a></ul></div>
<article><h2>The  story
title</h2><p>First &amp; longest paragraph of the text, with several words.<p>Second one with <a href=x>a link</a> in it.<ul><li>point one<li>point two</ul><script>var t="</p>";</script>
<form><label>Mail <input></label><button>Send</button></form><section id="comments"><div class="comment"><p>I really liked this article, it was very good. Thanks a lot!</p></div></section></article><footer>&copy; me <a>Imprint</a></footer></body></html>"""
MAIN = "The story title\nFirst & longest paragraph of the text, with several words.\nSecond one with a link in it.\npoint one\npoint two"


def test_main_text():
    assert html_extract.extract(PAGE)[0] == MAIN


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<p>", "a < b", "<!-- x", "<script>", '<a href="', "</p></div>", "&#0;&#x110000;&bogus;", "<b>" * 3000, "<ul>" + "<li>x" * 2000])
def test_odd_pages(html):
    html_extract.extract(html)


@pytest.mark.parametrize("n", [10, 5_000])
@pytest.mark.parametrize("quote", "\"'")
def test_long_attributes(n, quote):
    other = "'" if quote == '"' else '"'
    page = f"<article><p data-x={quote}{'<b>leak</b> > ' * n}{other}{quote}>The first sentence of it.</p><p title=don't>It isn't the last one.</p></article>"
    assert [b.text for b in html_extract.read_blocks(page)] == ["The first sentence of it.", "It isn't the last one."]
    assert [b.text for b in html_extract.read_blocks(f"<p class={quote}x>Never closed.</p>")] == ["Never closed."]


@pytest.mark.parametrize(
    "piece, text",
    [
        ('<svg class="i"/>', "Before after."), ("<math/>", "Before after."), ("<svg><g><path d=x/><text>no</text></g></svg>", "Before after."),
        ("<svg><svg><text>no</text></svg><text>no</text></svg>", "Before after."), ("<template><p>no</p><template>no</template>no</template>", "Before after."),
        ("<template>", "Before after."), ("<svg><g>", "Before after."), ("<object data=x>", "Before after."), ("<object>shown</object> ", "Before shown after."),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math> ", "Before x=2 after."),
    ],
)
def test_embedded_elements(piece, text):
    page = f"<body><article><p>Before {piece}after.</p><p>Next.</p></article><svg><text>no</text></svg></body>" if "<svg><g>" != piece else f"<body><p>Before {piece}after.</p><p>Next.</p></body>"
    assert [b.text for b in html_extract.read_blocks(page)] == [text, "Next."]


def test_references_end_with_their_text():
    page = "<article><h2>On markup</h2><p>Write &<b>lt</b>; for a sign, and R&amp;D, 5 &lt; 6 &copy; or &amp;lt; in this sentence.</p></article>"
    assert html_extract.extract(page)[0] == "On markup\nWrite &lt; for a sign, and R&D, 5 < 6 \u00a9 or &lt; in this sentence."


@pytest.mark.parametrize("name", ["kommentar-bereich", "kommentar-liste", "espace-commentaire", "comments-area"])
def test_comments_by_identifier(name):
    page = f'<article><h2>The headline of it</h2><p>A first paragraph of the article, which has some words.</p><p>Another one follows it, with more of them.</p></article><section class="{name}"><p>I agree with this.</p><p>Me too, thanks a lot!</p></section>'
    assert html_extract.extract(page)[0] == "The headline of it\nA first paragraph of the article, which has some words.\nAnother one follows it, with more of them."


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "<p>Some long text without much around it, really.</p>" * 4000, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(rows).collect()
    assert sorted(r["n_chars"] for r in got) == [0, len(MAIN), len(MAIN), 4000 * 47 - 1]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(rows.limit(0)).isEmpty()


def test_pages_of_the_tables(spark, sf_dir):
    from html import unescape

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)[^>]*>", article))
        assert html_extract.extract(r["html"])[0] == "\n".join(b for b in blocks if b)


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 8)
        s, t = ([rng.random() * 2 for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side, s=s, t=t, edges=edges):
            return sum(t[i] if side[i] else s[i] for i in range(len(side))) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(n, s, t, edges)) == pytest.approx(best)


@pytest.mark.parametrize("n", [1_000, 40_000])
def test_long_pages(n):
    import time

    rng = random.Random(n)
    page = "<main>" + "".join(f"<p>{'Some sentence of words that go on. ' * rng.randint(0, 3)}x</p>" if rng.random() < 0.6 else f"<p><a href=u>link {k}</a></p>" for k in range(n)) + "</main>"
    blocks = html_extract.read_blocks(page)
    odds = [rng.gauss(-1, 3) for b in blocks]
    began = time.process_time()
    cut = html_extract.minimum_cut(len(blocks), [max(0.0, -v) for v in odds], [max(0.0, v) for v in odds], html_extract.smoothness(blocks))
    assert time.process_time() - began < 5 and 0 < sum(cut) < len(blocks) == n


LONG = "This is a paragraph of the article that goes on for some words, as articles do."


@pytest.mark.parametrize(
    "page, text",
    [
        # One word of an identifier does not decide.
        (f'<article><div class="search-results-explained"><p>{LONG}</p></div><p id="main-form-of-address">{LONG}</p></article>', f"{LONG}\n{LONG}"),
        (f'<div class="post comments-open"><h1>Head line</h1><p>{LONG}</p></div>', f"Head line\n{LONG}"),
        # Nor does a page without any.
        (f"<div><a href=x>Home</a> | <a href=y>About</a></div><div>{LONG} {LONG}</div><div>{LONG}</div><div>All rights reserved 2020</div>", f"{LONG} {LONG}\n{LONG}"),
        (f"<div>{LONG}</div><div>{LONG}</div><div>Copyright © 2020 Example Ltd</div>", f"{LONG}\n{LONG}"),
        (f'<header class="top"><a href=x>Site</a></header><article><header><h1>Head line</h1></header><p>{LONG}</p></article>', f"Head line\n{LONG}"),
        # Words of shape say nothing beside others.
        (f'<main><p>{LONG}</p><div class="ad-slot-top"><p>{LONG}</p></div><div id="promo-teaser">{LONG}</div></main>', LONG),
        # Long identifiers whose last word names the thing.
        (f'<main><p>{LONG}</p><div class="article-comments"><p>{LONG} Nice!</p></div><div id="cookie-notice"><p>{LONG}</p></div></main>', LONG),
        (f'<div role="main"><p>{LONG}</p><ul class="related-links"><li><a href=x>One more story</a><li><a href=y>Another story here</a></ul></div>', LONG),
        (f'<div class="site-footer-inner"><p>{LONG}</p></div><section><p>{LONG} Yes.</p><p>{LONG}</p></section>', f"{LONG} Yes.\n{LONG}"),
    ],
)
def test_evidence_is_combined(page, text):
    assert html_extract.extract(f"<html><body>{page}</body></html>")[0] == text


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    sets = [(d, word_set(t)) for d, t in rows if d is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return components(links, {d for d, _ in sets})


def corpus():
    rng = random.Random(6)

    def words(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    def edited(base, k):
        out = list(base)
        for _ in range(k):
            out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
        return out

    passage = words(12)
    texts = [None, "", " \t", "one", "ONE", "a b c d", "A b\nc d", "a b c d e"]
    texts += [" ".join(words(60) + passage + words(20)) for _ in range(40)]
    base = words(150)
    texts += [" ".join(edited(base, rng.randint(0, 4))) for _ in range(80)]  # one large group, not all alike
    for _ in range(12):
        b = words(rng.randint(5, 90))
        texts += [" ".join(edited(b, k)) for k in (0, 0, 1, 2)]
    texts += [" ".join(base).upper()] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_join_by_definition(spark):
    rows = corpus() + [(None, "a b c d e"), (3, "x y z"), (4, "x y z"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l")]
    docs = spark.createDataFrame([(d, t, "comp", b"s") for d, t in rows], "doc_id long, text string, comp string, sid binary")
    got = ngram_join.link_documents(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"])) for r in got) == sorted(repr((d, len(word_set(t)))) for d, t in rows)
    want = expected(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [*{d for d, c in want.items() if d == c}, None]))


@pytest.mark.parametrize("task_rows", [0, 10_000])
def test_join_of_hot_groups(spark, monkeypatch, task_rows):
    monkeypatch.setattr(common, "TASK_ROWS", task_rows)
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    long, base, passage = words(30_000), words(80), words(40)
    rows = [" ".join(long), " ".join([*long[:-20], *words(20)]), " ".join(words(30_000))]
    rows += [" ".join(base)] * 400  # exact copies
    rows += [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(80)] * 2  # near copies of one origin
    rows += [" ".join(passage + words(15)) for _ in range(120)]  # unlike texts with one hot passage
    rows += [" ".join(passage + words(6)) for _ in range(40)]  # like texts with it
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(docs).collect()}
    assert got == expected(list(enumerate(rows)))


@pytest.mark.parametrize("task_rows", [0, 10_000])
def test_spread_join(spark, monkeypatch, task_rows):
    monkeypatch.setattr(common, "TASK_ROWS", task_rows)
    rng = random.Random(2)
    rows = [(k, None if k % 5 == 0 else "hot" if k % 2 else f"k{rng.randrange(50)}", k % 3) for k in range(4000)] + [(1, "hot", 1)] * 500
    values = [(f"k{k}", j, f"v{k}.{j}") for k in range(0, 60, 2) for j in range(2)] + [("hot", 1, "v")]
    df = spark.createDataFrame(rows, "id long, a string, b long").repartition(4)
    given = spark.createDataFrame(values, "a string, b long, v string")
    for how in ("inner", "left"):
        got, want = common.spread_join(df, given, ["a", "b"], df.count(), how), df.join(given, ["a", "b"], how)
        assert sorted(map(repr, got.select("id", "a", "b", "v").collect())) == sorted(map(repr, want.select("id", "a", "b", "v").collect()))
    assert common.spread_join(df.limit(0), given, ["a", "b"], 0, "left").isEmpty()


def test_join_random_pairs(spark):
    # Similarities close to the threshold on both sides.
    rng = random.Random(9)
    rows = []
    for k in range(60):
        n = rng.randint(6, 60)
        base = [f"b{k}-{i}" for i in range(n)]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base[: n - rng.randint(0, n // 4)] + [f"z{k}"] * rng.randint(0, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(docs).collect()} == expected(rows)
    assert ngram_join.link_documents(docs.limit(0)).isEmpty()
    assert ngram_join.link_documents(docs.where("doc_id < 1")).first()["component_id"] == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + list(pairwise(range(100, 160)))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    want = components([e for e in edges if e[0] != e[1]], {x for a, b in edges if a != b for x in (a, b)})
    assert got == want


def hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        size = min(10, len(p))
        for i in range(len(p) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == p[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [10**6, 150])
def test_decontamination_by_definition(spark, pass_bytes):
    rng = random.Random(8)

    def words(n):
        return [rng.choice(["The", "cat", "sat", "ü", "x9", "on", "mat"]) for _ in range(n)]

    items = [(k, rng.choice([" ", "-", "\n"]).join(words(n))) for k, n in enumerate([12, 30, 10, 9, 3, 11, 200])] + [(50, None), (51, "!!"), (52, ""), (2, "again and again"), (None, "null item here is long enough to have ten words in all")]
    texts = [None, "", "?", "The CAT sat"] + [", ".join(words(rng.randint(1, 60))) for _ in range(60)] + [f"{' '.join(words(5))} {t or ''} {' '.join(words(4))}" for _, t in items]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.find_contamination(docs, bench, pass_bytes=pass_bytes).collect()}
    assert got == {k: hits(t, items) for k, t in enumerate(texts)}
    clean = decontamination.find_contamination(docs, bench, pass_bytes=pass_bytes, keep=True)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, v in got.items() if not v[4]}


def test_passes(spark):
    items = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([30, 30, 50, 10, 200, 5, 5])] + [(7, "天" * 40)], "item_id long, text string").coalesce(1)
    assert [[i for i, _ in p] for p in decontamination.passes_of(items, 120)] == [[0, 1, 2, 3], [4], [5, 6], [7]]
    assert list(decontamination.passes_of(items.limit(0))) == [[]]


def test_tables_of_a_benchmark_are_small():
    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(30_000)}" for _ in range(150))) for k in range(1200)]
    size = sum(len(t) for _, t in items)
    search = decontamination.BenchmarkSearch(items)
    held = len(search.text) + sum(a.nbytes for s in search.searches for a in (s.block, s.shift, s.key, s.start, s.end, s.owner))
    assert held < 10 * size
    assert all(search.hits(decontamination.words_of(t))[1] >= {str(k)} for k, t in items[::100])


def test_decontamination_of_long_and_repeated_texts(spark):
    shared = " ".join(f"w{k}" for k in range(12))
    # Many patterns that begin or end alike, and windows that many items share.
    items = [(k, f"{shared} end{k}") for k in range(3000)] + [(5000 + k, f"start{k} {shared}") for k in range(3000)]
    long = "filler words here " * 60_000
    rows = [(1, f"{long} {shared} end7 {long}"), (2, long)] + [(3, f"start9 {shared}")] * 50 + [(None, shared)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, item_id long, contaminated string")
    got = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    shown = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in got}
    assert len(got) == len(rows) and shown == {(1, 13, 6000), (2, 0, 0), (3, 13, 6000), (None, 12, 6000)}


@pytest.mark.parametrize("pass_bytes", [10**6, 12])
def test_null_and_named_items(spark, pass_bytes):
    """An item without id and one called `None` are one item, in one pass or several."""
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta"), ("None", "gamma delta"), ("x", "天天天 天天")], "item_id string, text string")
    got = decontamination.find_contamination(docs, items, pass_bytes=pass_bytes).first()
    assert (got["n_items"], got["n_hit"], got["items_sha256"]) == (1, 4, hashlib.sha256(b"None").hexdigest())


def test_decontamination_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.find_contamination(docs.limit(0), bench).isEmpty()
    row = decontamination.find_contamination(docs, bench.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["items_sha256"]) == (2, 0, hashlib.sha256(b"").hexdigest())


def test_stored_tables_are_shared(spark):
    out = stored(spark.range(3), "x")
    assert out.stored_at.startswith(spark.conf.get("spark.checkpoint.dir")) and out.count() == 3
