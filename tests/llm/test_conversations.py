"""Repaired conversations against an exhaustive definition, whole and by segments."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tidewatch.llm import conversations as cv
from tidewatch.llm.queries import op11_conversation_repair

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, turns) of the cheapest edits of (initial, role, text, must_go, truncated), the audit least; runs of inserts up to three."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == n and state in "0a" else []
        role = {"0": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if inserts < 3 and (rest := best(i, role[0], inserts + 1)):
            found.append((rest[0] + 5, "I" + rest[1], ((role, ""), *rest[2])))
        if i < n:
            initial, own, text, must_go, truncated = rows[i]
            if rest := best(i + 1, state, 0):
                found.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if not must_go:
                more = 5 * truncated
                if (initial == role[0] or (initial == "s" and state == "0")) and (rest := best(i + 1, initial, 0)):
                    found.append((rest[0] + more, "K" + rest[1], ((own, text), *rest[2])))
                if rest := best(i + 1, role[0], 0):
                    found.append((rest[0] + 1 + more, "R" + rest[1], ((role, text), *rest[2])))
        return min(found, default=None)

    return best(0, "0", 0)


def plain_report(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = duplicate = truncated = 0
        seen, judged = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(BLANK)
            first = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            blank, duplicate, truncated = blank + (first == "blank"), duplicate + (first == "duplicate"), truncated + (first == "truncated")
            seen.add((role, text))
            judged.append((role[:1], role, text, first in ("blank", "duplicate"), first == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, repaired = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_conversation_repair(spark, sf_dir)) == plain_report(damaged(rows), {r[0] for r in rows})


def odd_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Yes. \n", "é.", "a\nb."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ulysses", "Assistant"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, 2, None, -5]), rng.choice(roles), rng.choice(texts)))
    return rows + [(99, None, None, None), (100, 1, "system", "Only this.")]


@pytest.mark.parametrize("piece_rows, segment_rows", [(20_000, 20_000), (0, 1), (2, 3)])
def test_odd_conversations(spark, piece_rows, segment_rows):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, key string, place int").repartition(5)
    pieces = cv.repair_conversations(cv.damage(df), "copies", piece_rows, segment_rows=segment_rows)
    assert found(cv.report(pieces)) == plain_report(damaged(rows), {r[0] for r in rows})


def test_long_conversation_of_few_texts(spark):
    """One conversation with most of the rows, many of them equal, by segments and as one piece."""
    rng = random.Random(3)
    rows = [(1, rng.randrange(400), rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", "Well."]) + str(rng.randrange(300)) + rng.choice(".a")) for _ in range(1500)] + [(1, 7, "user", "Same.")] * 500 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = cv.report(cv.repair_conversations(df))
    cut = cv.repair_conversations(df, piece_rows=100, segment_rows=40)
    assert found(cv.report(cut)) == found(whole)
    assert cut.where("pieces > 10").count() > 10
    assert max(len(r["roles"]) for r in cut.select("roles").collect()) <= 90


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.report(cv.repair_conversations(cv.damage(df), "copies")).count() == 0


def test_dropped_conversation(spark):
    df = spark.createDataFrame([(5, 1, "user", "Hi.", 0)], "conv_id long, turn long, role string, text string, copies int")
    assert found(cv.report(cv.repair_conversations(df, "copies"))) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_distances_are_shortest():
    """Against relaxing all arcs until nothing changes."""
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.3) for _ in range(rng.randint(0, 7))]
        ends = [rng.choice([cv.FAR, rng.randrange(12)]) for _ in range(4)]
        n = len(rows)
        want = [cv.FAR] * (4 * n) + list(ends)
        for _ in range(8 * n + 8):
            for p in range(n + 1):
                for q in range(4):
                    found = [want[4 * p + q], want[4 * p + cv.AFTER[q]] + 5]
                    if p < n:
                        more = 5 * rows[p][1]
                        found += [want[4 * p + 4 + q] + 2, want[4 * p + 4 + cv.AFTER[q]] + 1 + more]
                        if (kept := cv.KEPT.get((rows[p][0], q))) is not None:
                            found.append(want[4 * p + 4 + kept] + more)
                    want[4 * p + q] = min(min(found), cv.FAR)
        assert cv.distances(rows, ends) == want
