"""URL filter and quality rules: SQL, plain definitions, odd inputs, and no Python in their plans."""

from __future__ import annotations

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import arrays
from tidewatch.llm import common, queries, quality_rules, url_filter
from tidewatch.llm.common import table

SQL_TABLES = ("pages", "documents", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in SQL_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in places]) for r in want.fetchall())


def verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[1], min(fits)[2]) if fits else (host, path, None, "allow")


def test_urls_by_definition(spark):
    rng = random.Random(2)
    rules = [*url_filter.RULES, ("a.b.example.net", "/en/x/", "block"), ("net", "", "allow"), ("example.org", "/fr/deep/er", "block"), ("com", "/d", "block")]
    urls = [None, "", "no scheme.net/", "http://", "HTTP://WWW.Example.NET/en/1", "http://example.net", "x://net/?q", "http://a//b", "http://ünï.net/é/", "http://.net/", "http://net./", "http://a.b.example.net/en/x/y#z://", "http://c.example.org/fr/deep/erst", "http://e.com/dx"]
    urls += ["http://" + ".".join(rng.choices(["a", "b", "example", "net", "org", "com", "NET"], k=rng.randint(1, 5))) + rng.choice(["", "/"]) + "/".join(rng.choices(["en", "de", "fr", "x", ""], k=rng.randint(0, 4))) + rng.choice(["", "?a/b", "#f"]) for _ in range(600)]
    rows = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(None, urls[4], "x", "y"), (3, urls[3], "x", "y")], "page_id long, url string, rule string, host string")
    got = url_filter.filter_urls(rows, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = sorted(repr((k, *verdict(u, rules))) for k, u in [*enumerate(urls), (None, urls[4]), (3, urls[3])])
    assert sorted(repr(tuple(r)) for r in got) == want


def test_hot_and_long_urls(spark, monkeypatch):
    long = "http://a.example.com/de/" + "x/" * 20_000 + "?q"
    urls = [None] * 700 + ["no scheme"] * 300 + ["http://hot.net/one"] * 900 + [long, f"http://{'s.' * 5_000}net/"] + [f"http://h{k}.org/fr/{k}" for k in range(50)]
    rules = [*url_filter.RULES, *[(f"h{k}.org", "/", "block") for k in range(40)]]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(repr((k, *verdict(u, rules))) for k, u in enumerate(urls))
    assert sorted(repr(tuple(r)) for r in url_filter.filter_urls(rows, listed).collect()) == want
    # Keys that are dealt to several tasks, and a filter that is too large to broadcast.
    monkeypatch.setattr(common, "TASK_ROWS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    assert sorted(repr(tuple(r)) for r in url_filter.filter_urls(rows, listed).collect()) == want


def test_urls_empty(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(rows.limit(0), rules).isEmpty()
    assert url_filter.filter_urls(rows, rules.limit(0)).first()[:] == (1, "a.net", "/", None, "allow")


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def documents(spark, rows):
    full = [(*r[:3], "kept", 1) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, kept string, place int")


def test_base_counts_by_definition(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "ä\u00a0b c#d\n\n x | y\n x | y\r\n", "a b c d e f g h " * 3, "x " * 30, "😀 $ " * 9, "\x0b\x0c\n"]
    for _ in range(60):
        texts.append(" ".join(rng.choices("a b c".split(), k=rng.randint(1, 40))) + rng.choice(["\n", " "]) + "\n".join(rng.choices(["k l", "", "m"], k=5)))
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge_quality(documents(spark, rows)).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_frequent_lines(spark):
    rng = random.Random(1)
    common, other = prose(rng, 12), prose(rng, 12)
    rows = [(k, f"{prose(rng, 30)}\n{common.upper()}  \n{other}", "big") for k in range(40)]
    rows += [(100, f"{common}\n{other}\n{prose(rng, 3)}", "big"), (101, f"{common}\n{prose(rng, 25)}", "small")]
    copy = prose(rng, 40) + "\n" + prose(rng, 20)
    rows += [(200 + k, copy, "big") for k in range(60)] + [(None, copy, None), (1, None, "big"), (1, None, "big")]
    got = quality_rules.judge_quality(documents(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[k]["removed"] == 24 and by_id[k]["kept"] for k in range(2, 40))
    # Most of it is the frequent line, which another host has once.
    assert (by_id[100]["removed"], by_id[100]["base_failed"], by_id[100]["kept"]) == (24, False, False)
    assert by_id[101]["removed"] == 0 and by_id[101]["kept"]
    # Sixty copies are one document, so their lines are not frequent.
    assert by_id[200]["removed"] == 0 and by_id[200]["kept"]
    kept = quality_rules.judge_quality(documents(spark, rows), keep=True)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_frequent_lines_leave_the_texts(spark):
    rng = random.Random(3)
    common, own = prose(rng, 12), [f"  {prose(rng, 30)}\t" for _ in range(30)]
    rows = [(k, f"{common.upper()}  \n{own[k]}\n\n {common}\n", "big") for k in range(30)]
    rows += [(100, f"{common}\n{prose(rng, 25)}", "small"), (101, f"a  b\n\n{prose(rng, 25)}", "big"), (102, common + " " + prose(rng, 20), "big")]
    df = documents(spark, rows)
    got = {r["doc_id"]: r["text"] for r in quality_rules.judge_quality(df, keep=True).collect()}
    assert got == {k: f"{own[k]}\n\n" for k in range(30)} | {k: t for k, t, _ in rows[30:]}
    sized = quality_rules.judge_quality(df.selectExpr("*", "length(text) AS n_chars"), keep=True)
    assert sized.where("n_chars <> length(text)").isEmpty() and sized.count() == len(rows)


def test_documents_are_told_apart_by_their_texts(spark):
    rng = random.Random(4)
    # The shared line is the longest of its documents; exact copies are one document.
    notice, licence, copy = prose(rng, 60), prose(rng, 30), f"{prose(rng, 20)}\n{prose(rng, 30)}"
    rows = [(k, f"{prose(rng, 24)}\n{notice}", "one") for k in range(200)]
    rows += [(1000 + k, f"{licence}\n{prose(rng, 3)}", "two") for k in range(30)] + [(2000 + k, copy, "two") for k in range(300)]
    got = {r["doc_id"]: (r["removed"], r["kept"]) for r in quality_rules.judge_quality(documents(spark, rows)).collect()}
    assert all(got[k] == (60, True) for k in range(200))
    assert all(got[1000 + k] == (30, False) for k in range(30))
    assert all(got[2000 + k] == (0, True) for k in range(300))


def test_many_frequent_lines_of_hot_hosts(spark, monkeypatch):
    rng = random.Random(8)
    common = [prose(rng, 12) for _ in range(4)]
    rows = [(k, f"{prose(rng, 30)}\n{common[k % 2]}", "hot" if k < 900 else None) for k in range(1000)]
    rows += [(1000 + k, f"{prose(rng, 30)}\n{common[2]}", f"h{k // 20}") for k in range(40)]
    want = [tuple(r) for r in quality_rules.judge_quality(documents(spark, rows)).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality_rules, "BROADCAST_KEYS", 0)
    assert [tuple(r) for r in quality_rules.judge_quality(documents(spark, rows)).orderBy("doc_id").collect()] == want
    assert sum(r[-1] for r in want) == 12 * 1040


def test_texts_of_many_frequent_lines(spark):
    """The time of texts of one host that share n lines grows about as n."""
    def seconds(n):
        shared = "\n".join(f"shared line number {k} of the host" for k in range(n))
        docs = documents(spark, [(k, f"own words of document {k}\n{shared}", "h") for k in range(12)])
        began = time.perf_counter()
        found = quality_rules.judge_quality(docs, keep=False).collect()
        assert {r["removed"] for r in found} == {7 * n} and not any(r["kept"] for r in found)
        return time.perf_counter() - began

    seconds(100)
    few, many = seconds(3_000), seconds(12_000)
    assert many < 5 * few + 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
def test_places_by_halving(spark, n):
    values = [3 * k - 50 for k in range(n)]
    rows = spark.createDataFrame([(values, x) for x in range(-60, 3 * n)], "v array<long>, x long")
    assert all(r["hit"] == (r["x"] in values) for r in rows.select("v", "x", arrays.among(F.col("v"), arrays.halvings(F.col("v")), F.col("x")).alias("hit")).collect())


def test_rules_empty_and_long(spark):
    assert quality_rules.judge_quality(documents(spark, [(1, "a", "s")]).limit(0)).isEmpty()
    long = prose(random.Random(1), 60_000)
    row = quality_rules.judge_quality(documents(spark, [(1, long, "s")])).first()
    assert (row["n_words"], row["kept"]) == (60_000, True)


def test_plans_have_no_python(spark, sf_dir):
    for name in ("op3_url_filter", "op5_quality_rules"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert table(spark, sf_dir, "pages").count()
