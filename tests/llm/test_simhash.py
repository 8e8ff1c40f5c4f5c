"""Fingerprints, their links and components, against plain definitions."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import simhash
from tidewatch.llm.queries import op13_simhash


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plain_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of (doc_id, fingerprint) by comparing all of them."""
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    named = [(d, f) for d, f in rows if d is not None]
    for i, (d, f) in enumerate(named):
        for e, g in named[:i]:
            if (f ^ g).bit_count() <= 3:
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return sorted(((d, f"{f:016x}", None if d is None else root(d)) for d, f in rows), key=repr)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(op13_simhash(spark, sf_dir)) == plain_components(rows)


def test_odd_documents(spark):
    texts = [None, "", " \t\n", "One", "one", "ONE two", "é É x", "a b c", "A\tb\rC", "a b c", "a b c d " * 30_000, "ſ K", "a b c d"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b c"), (None, None), (3, "a b c"), (3, None), (3, "One")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, fp string, comp int, key int")
    assert found(simhash.link_documents(df)) == plain_components([(d, plain_fingerprint(t)) for d, t in rows])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = simhash.link_documents(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_hash_is_that_of_spark(spark):
    text = "one two three"
    assert signed(xxhash.xxh64_intdigest(text.encode(), simhash.SEED)) == spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def graph(kind: str) -> list[int]:
    rng = random.Random(7)
    if kind == "ball":  # one dense group, all within a few bits of a point
        centre = rng.getrandbits(64)
        return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(250)]
    if kind == "half":  # one half is the same in all
        return [rng.getrandbits(7) | (rng.getrandbits(5) << 20) | (0xABCDEF << 32) for _ in range(250)]
    if kind == "chain":  # neighbours differ in three bits, others in more
        out = [rng.getrandbits(64)]
        for k in range(80):
            out.append(out[-1] ^ sum(1 << (7 * k + j * 5) % 64 for j in range(3)))
        return out
    return [rng.getrandbits(64) for _ in range(200)]


@pytest.mark.parametrize("kind, ball_rows, pair_rows", [("ball", 0, 0), ("ball", 5, 0), ("ball", 99, 0), ("half", 0, 99), ("half", 99, 99), ("chain", 99, 0), ("random", 99, 8)])
def test_components(spark, kind, ball_rows, pair_rows):
    """By stars, pairs and balls, whichever of them the bounds choose."""
    values = sorted(set(graph(kind)))
    rows = [(k, v) for k, v in enumerate(values)]
    want = {v: c for (_, v), (_, _, c) in zip(rows, sorted(plain_components(rows)), strict=True)}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r["fp"]: r["comp"] for r in simhash.fingerprint_components(fps, ball_rows, pair_rows).collect()}
    assert len(got) == len(values)
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(got[signed(v)])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
