"""Tokens, packing, token files, language models, and the two classifiers."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import language_id, lm_scoring, packing, quality_classifier, token_files, tokens
from tidewatch.llm.common import hash_share, held_out, table

PATH = tokens.default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)
ENCODER = tokens.ChunkEncoder(PATH, 50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aZé́ßİǅ 's'lL0٣.,!_<|>\x1c\x85 \n\t日👍"), st.characters(exclude_categories=["Cs"]))) | st.sampled_from(["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't. IT'S,", "Hello <|endoftext|> World ABC Straße,"]), max_size=4))
def test_chunks_encode_as_whole_texts(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_table_encodes_as_whole_texts(spark, sf_dir):
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    assert [x.tolist() for x in tokens.ChunkEncoder(PATH).encode(texts)] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def ids_of(text, end):
    return np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 200, 900]))), "x", 7) for k in range(60)]
    rows += [(100, None, "x", 7), (101, "", "x", 7), (102, "long text here " * 30_000, "x", 7), (103, "same", "x", 7), (103, "same", "x", 7), (None, "no id", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3).cache()


def test_packing(odd_docs):
    pieces = packing.pack_documents(odd_docs, window_tokens=20_000, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"] > 0
    padded = 0
    for rows in by_sequence.values():
        rows.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in rows] == [sum(q["length"] for q in rows[:k]) for k in range(len(rows))]
        total = sum(p["length"] for p in rows)
        assert total <= 4096
        padded += total not in packing.TIERS
    assert padded <= 3  # one a partition at most
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for doc, rows in by_doc.items():
        ids = ids_of(texts[doc], 2)
        if doc == 103:
            assert sorted(p["length"] for p in rows) == [len(ids)] * 2 or sum(p["length"] for p in rows) == 2 * len(ids)
            continue
        rows.sort(key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in rows) == ids.tobytes()
        assert [p["start"] for p in rows] == [sum(q["length"] for q in rows[:k]) for k in range(len(rows))]
        assert all(p["doc_tokens"] == len(ids) for p in rows)
    assert set(by_doc) == set(texts)


def test_packing_empty_and_groups(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    groups = packing.step_groups([4096] * 40 + [512] * 64, 32_768)
    sums = Counter()
    for g, n in zip(groups, [4096] * 40 + [512] * 64, strict=True):
        sums[g] += n
    assert max(sums.values()) - min(sums.values()) <= 4096


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=6), st.randoms())
def test_blocks(documents, rng):
    arrays = [np.array(d, "<u4") for d in documents]
    names = [None if k == 1 else k - 3 for k in range(len(arrays))]
    block = token_files.Block(token_files.encode_block(names, arrays))
    every = np.concatenate(arrays) if arrays else np.zeros(0, "<u4")
    assert block.doc_ids == names and block.n_tokens == len(every)
    assert [block.document(k).tolist() for k in range(len(arrays))] == documents
    for _ in range(20 if len(every) else 0):
        i = rng.randrange(len(every))
        j = rng.randrange(i, len(every) + 1)
        assert block.id(i) == every[i]
        assert block.ids(i, j).tolist() == every[i:j].tolist()


def test_token_files(spark, odd_docs):
    got = sorted(token_files.round_trip(odd_docs).collect(), key=lambda r: r["start"])
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    for r, d in zip(got, rows, strict=True):
        ids = ids_of(d["text"], 1)
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(odd_docs.limit(0)).isEmpty()


def test_single_ids_of_token_files(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 100_000)
    path = token_files.shared_path(spark, "tokens")
    token_files.write_token_files(odd_docs, path, block_tokens=3_000)
    files = spark.read.parquet(path)
    assert files.select("part").distinct().count() > 3 and files.count() > 8
    texts = {r["doc_id"]: ids_of(r["text"], 1) for r in odd_docs.collect() if r["doc_id"] != 103}
    rng = random.Random(4)
    places = [(d, rng.randrange(-1, len(x) + 2)) for d, x in texts.items() for _ in range(5)] + [(555, 0), (None, 0), (5, None)]
    got = token_files.read_ids(spark, path, spark.createDataFrame(places, "doc_id long, place long")).collect()
    want = [(d, p, int(texts[d][p])) for d, p in places if d in texts and d is not None and p is not None and 0 <= p < len(texts[d])]
    assert sorted(map(tuple, got)) == sorted(want)
    # Only the part files of the wanted documents are read.
    some = token_files.read_ids(spark, path, spark.createDataFrame([want[0][:2]], "doc_id long, place long"))
    assert [tuple(r) for r in some.collect()] == [want[0]]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(part," in plan or "In(part," in plan


def test_frequent_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 2_000)
    rows = [(None if k % 3 else 7, f"text number {k % 150} of many") for k in range(900)] + [(8, "a"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 600 + [6] + [7] * 300 + [8]
    want = Counter((d, len(ids_of(t, 1)), zlib.crc32(ids_of(t, 1).tobytes())) for d, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def backoff(rows, order):
    """Scores by definition: the longest n-gram that another document has, own counts left out."""
    ids = [["<"] * order + WHOLE.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    # N-grams ending at each id and at the last start mark.
    own = [{n: Counter(tuple(x[j - n + 1 : j + 1]) for j in range(order - 1, len(x))) for n in range(1, order + 1)} for x in ids]
    every = {n: sum((o[n] for o in own), Counter()) for n in range(1, order + 1)}
    total = sum(len(x) - order for x in ids)
    out = []
    for (d, _), x, o in zip(rows, ids, own, strict=True):
        score = 0.0
        for j in range(order, len(x)):
            for n in range(order, 0, -1):
                g = tuple(x[j - n + 1 : j + 1])
                if every[n][g] > o[n][g]:
                    rest = every[n - 1][g[:-1]] - o[n - 1][g[:-1]] if n > 1 else total - (len(x) - order)
                    score += (order - n) * math.log(0.4) + math.log((every[n][g] - o[n][g]) / rest)
                    break
            else:
                score += order * math.log(0.4) - math.log(max(1, total - (len(x) - order)))
        out.append((str(d), len(x) - order, score))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_by_definition(spark, order, monkeypatch):
    rng = random.Random(order)
    rows = [(k, " ".join(rng.choices("the cat sat on a mat again".split(), k=rng.randint(0, 30)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "unseen zebra"), (203, "long one " * 3000), (None, "the cat"), (0, "the cat"), (0, "the cat")]
    docs = spark.createDataFrame([(d, t, 1.0, 5) for d, t in rows], "doc_id long, text string, log_score double, lot long").repartition(3)
    for module, grams in ((lm_scoring, 500), (lm_scoring, 10**6)):
        got = module.score_documents(docs, order=order, partition_grams=grams).collect()
        shown, want = sorted((str(r["doc_id"]), r["n_tokens"], r["log_score"]) for r in got), backoff(rows, order)
        assert [g[:2] for g in shown] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in shown], [w[2] for w in want])
        assert all(r["mean_log_score"] is None if not r["n_tokens"] else math.isclose(r["mean_log_score"], r["log_score"] / r["n_tokens"]) for r in got)
    assert lm_scoring.score_documents(docs.limit(0), order=order).isEmpty()


def test_scores_set_repeated_documents_apart(spark):
    rng = random.Random(3)
    words = [f"{rng.randrange(16**6):06x}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_score"] for r in lm_scoring.score_documents(docs).collect()}
    twice, once = [got[k] for k in [*range(20), *range(300, 320)]], [got[k] for k in range(20, 300)]
    assert min(twice) > max(once)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=50))
def test_packed_numbers(values):
    assert lm_scoring.unpack(lm_scoring.pack(np.array(values, np.uint64)), len(values)).tolist() == values


def test_held_out_ids(spark):
    ids = [None, -5, 0, 1, 2, 3, 10**12]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out(F.col("doc_id"))).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    extra = spark.createDataFrame([(90001, None, "en"), (90002, "", "en"), (90003, "123 !?", "en"), (90004, "the", None), (None, "une phrase avec des mots", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(extra)
    got = {r["doc_id"]: r for r in language_id.predict_language(rows).collect()}
    assert len(got) == docs.count() + 5
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in truth if got[d]["held_out"]]
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.97
    assert all(got[d]["lang_pred"] == "und" for d in (90001, 90002, 90003))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict_language(rows.limit(0)).isEmpty()
    assert language_id.predict_language(rows.withColumn("lang", F.lit(None).cast("string")).limit(5)).first()["lang_pred"] == "und"


def test_language_ignores_other_columns(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    one = language_id.predict_language(docs, model).orderBy("doc_id").collect()
    two = language_id.predict_language(docs.withColumn("lang", F.lit("xx")), model).orderBy("doc_id").collect()
    assert one == two


def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    extra = spark.createDataFrame([(90001, None), (90002, ""), (None, "some text")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    more = labels.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1), (0, 0)], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in quality_classifier.score_quality(rows, more).collect()}
    assert len(got) == docs.count() + 3 and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [d for d in truth if got[d]["held_out"]]
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    kept = quality_classifier.score_quality(docs, labels, keep=True)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}
    assert {r["score"] for r in quality_classifier.score_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()} == {1.0}
    assert quality_classifier.score_quality(docs.limit(0), none).isEmpty()


def test_shapes():
    assert [quality_classifier.shape(w) for w in (b"Word,", b"LOUD!!", b"x9--", "é".encode())] == [b"Aa aa,", b"AA A!!", b"a0 0--", b"aa aa"]


def test_word_vectors_by_definition(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "The", "cat", "sat!", "x9", "é", "mat"]
    texts = [None, "", "one"] + [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    reader = quality_classifier.Reader()

    def buckets(word):
        value = reader.buckets[word.encode()]
        both, form = divmod(value, quality_classifier.SHAPES)
        return *divmod(both, quality_classifier.BUCKETS), form

    assert buckets("the")[:2] == buckets("The")[:2] != buckets("cat")[:2]
    sums, n = np.zeros((quality_classifier.BUCKETS, quality_classifier.SIZE)), Counter()
    for t in texts:
        every = [buckets(w) for w in (t or "").split()]
        for i, (one, two, _) in enumerate(every):
            for bucket in (one, two):
                n[bucket] += 1
                for other, _, form in [every[j] for j in (i - 1, i + 1) if 0 <= j < len(every)]:
                    for k in range(2):
                        sums[bucket, reader.word_places[other, k]] += reader.word_signs[other, k]
                        sums[bucket, reader.form_places[form, k]] += reader.form_signs[form, k]
    total, used = sum(n.values()), sorted(n)
    mean = {b: sums[b] / n[b] for b in used}
    centre = sum(n[b] * mean[b] for b in used) / total
    spread = np.sqrt(sum(n[b] * (mean[b] - centre) ** 2 for b in used) / total) + 1e-6
    monkeypatch.setattr(quality_classifier, "TASKS_AT_ONCE", 2)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = quality_classifier.word_vectors(docs)
    assert np.allclose(got[used], [(mean[b] - centre) / spread for b in used], atol=1e-4)
    assert not np.delete(got, used, axis=0).any()
    # Pooling, by definition, with these vectors.
    features = quality_classifier.pooled(reader, got, texts)
    size = quality_classifier.SIZE
    for row, t in zip(features, texts, strict=True):
        every = [buckets(w) for w in (t or "").split()]
        if not every:
            assert not row[:-1].any() and row[-1] == 1
            continue
        seen = np.array([got[a] + got[b] for a, b, _ in every])
        assert np.allclose(row[:size], seen.mean(axis=0), atol=1e-4)
        assert np.allclose(row[size : 2 * size], seen.std(axis=0), atol=2e-2)
        assert np.allclose(row[2 * size : 3 * size], np.mean([reader.form_index[f] for *_, f in every], axis=0), atol=1e-5)
        assert np.allclose(row[-3:], [np.mean([k > 0 and every[k][:2] == every[k - 1][:2] for k in range(len(every))]), np.log1p(len(every)), 0], atol=1e-5)


def test_network_slopes_are_differences():
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(30, 5)), (rng.random(30) > 0.5).astype(float)
    values = [rng.normal(size=s) for s in ((5, 4), (4,), (4,), (1,))]
    _, slopes = quality_classifier.gradient(values, z, y)
    for v, slope in zip(values, slopes, strict=True):
        for at in np.ndindex(v.shape):
            kept, sides = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = kept + step
                sides.append(quality_classifier.gradient(values, z, y)[0])
            v[at] = kept
            assert slope[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_quality_of_odd_inputs(spark):
    rng = random.Random(1)
    good, bad = [["alpha beta gamma", "delta epsilon"][k % 2] for k in range(2)], ["zz!! 99", "## zz"]
    rows = [(k, " ".join(rng.choices(good if k % 2 else bad, k=20)), "x", 0.5, True, 3) for k in range(200)]
    rows += [(3, rows[5][1], "x", 0.5, True, 3)] * 40 + [(900, "alpha beta " * 60_000, "x", 0.5, True, 3), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, held_out boolean, predicted int")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(200)] * 3, "doc_id long, quality int, text string")
    got = quality_classifier.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 3 and r["predicted"] == 1}) <= 2
    by_id = {r["doc_id"]: r for r in got}
    assert np.mean([by_id[k]["predicted"] == k % 2 for k in range(200)]) > 0.95 and by_id[900]["predicted"] == 1
    kept = quality_classifier.score_quality(docs, labels, keep=True)
    assert kept.columns == docs.columns and kept.schema == docs.schema


def test_sample_of_any_share(spark):
    ids = spark.range(200_000)
    for share, least, most in ((1.0, 200_000, 200_000), (7.0, 200_000, 200_000), (0.01, 1_800, 2_200), (1e-9, 0, 3)):
        assert least <= ids.where(hash_share(F.col("id"), F.lit(share))).count() <= most


@pytest.mark.parametrize("block", [1 << 14, 50])
def test_kernel_by_definition(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK_GRAMS", block)
    rng = random.Random(3)
    texts = ["a", "é", "Ab  C\n"] + ["".join(rng.choices("abcé \n日x", k=rng.randint(1, 60))) for _ in range(30)]

    def parts(text):
        raw = b" " + " ".join(text.lower().split()).encode() + b" "
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    found = [language_id.grams(t) for t in texts]
    marks = language_id.Landmarks.of(found[:9])
    assert len(marks.vocabulary) == len(set().union(*map(parts, texts[:9])))
    want = [[len(parts(t) & parts(m)) / math.sqrt(len(parts(t)) * len(parts(m))) for m in texts[:9]] for t in texts]
    assert np.allclose(marks.kernel(found), want, atol=1e-5)
    # The weights solve the ridge problem on Nystroem features: on the landmarks alone this is kernel ridge regression.
    target = np.array([0, 1, 2] * 3)
    own, weights = language_id.solve(found[:9], target, 3, 9)
    k = own.kernel(found[:9]).astype(float)
    order = np.concatenate([np.flatnonzero(target == c) for c in range(3)])
    signs = np.where(target[:, None] == np.arange(3), 1.0, -1.0)
    square = k[:, np.argsort(order)]
    want = square @ np.linalg.solve(square + language_id.RIDGE * np.eye(9), signs)
    assert np.allclose(k @ weights, want, atol=1e-2)


def test_languages_of_repeated_rows(spark):
    rows = [(k, f"{'abc'[k % 3] * 3} {'abc'[k % 3]}{k % 50} words", "abc"[k % 3] * 2) for k in range(600)]
    ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5][:6]
    rows += [(i, f"{'defghi'[k] * 4} only text", "defghi"[k] * 2) for k, i in enumerate(ids) for _ in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, train_texts=90)
    assert list(model.languages) == [c * 2 for c in "abcdefghi"]
    got = language_id.predict_language(docs, model).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == {d: lang for d, _, lang in rows}[r["doc_id"]] for r in got[-100:])


def test_many_languages_and_odd_texts(spark):
    rng = random.Random(2)
    names = [f"l{k:03d}" for k in range(450)]
    words = {n: [f"{n}{rng.randrange(99)}" for _ in range(8)] for n in names}
    rows = [(k, " ".join(rng.choices(words[names[k % 450]], k=30)), names[k % 450], 0.1, "x") for k in range(2700)]
    rows += [(5000, "zz " * 300_000, "l001", 0.1, "x")] + [(7, rows[7][1], rows[7][2], 0.1, "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.fit(docs)
    assert set(names) == set(model.languages)
    got = language_id.predict_language(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.9
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 7}) == 1
    # More languages than landmarks: those with most texts are learned.
    assert set(language_id.fit(docs, most_landmarks=20).languages) <= set(names)
