"""Repair of conversation structure by Dial's bucket-queue shortest paths.

A conversation is repaired to the role pattern (s?(ua)+)? by the cheapest edits. Nodes of its graph are
places between rows together with what the repaired part ends in (nothing, system, user or assistant
turn); arcs keep, re-role or delete the next row or insert a turn, at costs of 0 to 6. Distances to the
end are found backwards with one bucket for each cost, without a heap. Then the audit is read off
forwards: at each node the alphabetically first edit whose arc is tight, that is, costs what the
distances differ by. Blank and duplicate rows must go: D is the first letter, so theirs comes at once and
they are no part of the graph.

A conversation is one piece, worked on in one task, as long as it is of bounded size. Longer ones are
cut to segments of bounded size, in order: each gives the distances between the four states at its ends,
these are composed from the back to distances to the end of the conversation, each segment then says where
its walk from each state ends, these are composed from the front, and each segment writes its own edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_few, chunks, map_arrow, spread_join, stored

#: Costs of edits; an undeleted truncated row costs as much as given more.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
MOST_COST = REROLE + TRUNCATED
#: What the repaired part ends in.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that is inserted or re-roled, and its role.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
BEFORE = [[p for p in range(4) if AFTER[p] == q] for q in range(4)]
#: The state after a kept turn by its role's initial.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Rows and bytes of a conversation that is worked on as one piece, and rows of a segment of a longer one.
PIECE_ROWS, PIECE_BYTES, SEGMENT_ROWS = 20_000, 16_000_000, 20_000

#: White space, and the characters that end a turn.
_BLANK, _ENDS = " \t\n\x0b\x0c\r", ".!?"


def distances(rows: list[tuple[str, bool]], ends: list[int]) -> list[int]:
    """Costs from (place, state), at 4 * place + state, to the end of rows (initial, truncated), which itself costs ends by state."""
    n = len(rows)
    dist = [FAR] * (4 * n + 4)
    known = [(e, q) for q, e in enumerate(ends) if e < FAR]
    if not known:
        return dist
    now, most = min(known)[0], max(known)[0]
    size = max(MOST_COST, most - now) + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    for e, q in known:
        dist[4 * n + q] = e
        buckets[e % size].append(4 * n + q)
    left = len(known)
    while left:
        bucket = buckets[now % size]
        while bucket:
            node = bucket.pop()
            left -= 1
            if dist[node] != now:
                continue
            place, state = divmod(node, 4)
            arcs = [(4 * place + p, INSERT) for p in BEFORE[state]]
            if place:
                initial, truncated = rows[place - 1]
                back, more = 4 * place - 4, TRUNCATED * truncated
                arcs.append((back + state, DELETE))
                for p in range(4):
                    if KEPT.get((initial, p)) == state:
                        arcs.append((back + p, more))
                arcs += [(back + p, REROLE + more) for p in BEFORE[state]]
            for node, cost in arcs:
                if now + cost < dist[node]:
                    dist[node] = now + cost
                    buckets[(now + cost) % size].append(node)
                    left += 1
        now += 1
    return dist


class Segment:
    """Rows of one conversation in order, as (turn, role, text, copies, seen): seen ones occurred before."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = [r for r in rows if r[3]]
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.deleted = 0
        #: Rows that may stay, as (initial, truncated) and (role, text), and rows that must go before each and at the end.
        self.free: list[tuple[str, bool]] = []
        self.texts: list[tuple[str, str]] = []
        self.forced = [0]
        before = turn = None
        for at, role, text, copies, seen in self.rows:
            initial, bare = role[:1], text.rstrip(_BLANK)
            self.illegal += copies - 1 + (before is not None and before + initial not in LEGAL)
            self.distinct += at is not None and at != turn
            before, turn = initial, at
            gone = copies - 1
            if not bare:
                self.blank, gone = self.blank + copies, copies
            elif seen:
                self.duplicate, gone = self.duplicate + copies, copies
            else:
                self.duplicate += copies - 1
                self.truncated += bare[-1] not in _ENDS
                self.free.append((initial, bare[-1] not in _ENDS))
                self.texts.append((role, text))
                self.forced.append(0)
            self.forced[-1] += gone
            self.deleted += gone

    def ends(self) -> tuple:
        """Initials and turns at both ends."""
        turns = [r[0] for r in self.rows if r[0] is not None]
        return self.rows[0][1][:1] if self.rows else None, self.rows[-1][1][:1] if self.rows else None, turns[0] if turns else None, turns[-1] if turns else None

    def walk(self, state: int, dist: list[int], last: bool) -> tuple[str, list[tuple[str, str]], int]:
        """The audit, the repaired turns and the final state of the first of the cheapest edits from a state on."""
        n, place, audit, turns = len(self.free), 0, ["D" * self.forced[0]], []
        while True:
            here = dist[4 * place + state]
            if place == n:
                if not last or state in (START, ASSISTANT):
                    return "".join(audit), turns, state
                letter = "I"
            else:
                ahead = 4 * place + 4
                initial, truncated = self.free[place]
                kept = KEPT.get((initial, state))
                if dist[ahead + state] + DELETE == here:
                    letter = "D"
                elif dist[4 * place + AFTER[state]] + INSERT == here:
                    letter = "I"
                elif kept is not None and dist[ahead + kept] + TRUNCATED * truncated == here:
                    letter = "K"
                else:
                    letter = "R"
            audit.append(letter)
            if letter == "I":
                state = AFTER[state]
                turns.append((ROLE[state], ""))
                continue
            if letter == "K":
                state = kept
                turns.append(self.texts[place])
            elif letter == "R":
                state = AFTER[state]
                turns.append((ROLE[state], self.texts[place][1]))
            place += 1
            audit.append("D" * self.forced[place])


#: Costs at the end of a conversation, which nothing or an assistant's turn may be.
GOAL = [0, FAR, FAR, 0]

#: One row a piece of a conversation. place: its number from 0, of `pieces`; roles and texts: the repaired turns.
PIECES = [
    ("place", "long", pa.int64()), ("pieces", "long", pa.int64()), ("rows", "long", pa.int64()), ("blank", "long", pa.int64()), ("duplicate", "long", pa.int64()),
    ("truncated", "long", pa.int64()), ("illegal", "long", pa.int64()), ("distinct_turns", "long", pa.int64()), ("first_turn", "long", pa.int64()), ("last_turn", "long", pa.int64()),
    ("first_initial", "string", pa.string()), ("last_initial", "string", pa.string()), ("cost", "long", pa.int64()), ("audit", "string", pa.string()),
    ("roles", "array<string>", pa.list_(pa.string())), ("texts", "array<string>", pa.list_(pa.string())),
]


def _piece(s: Segment, place: int, pieces: int, cost: int, audit: str, turns: list[tuple[str, str]]) -> tuple:
    first, last, low, high = s.ends()
    return place, pieces, sum(r[3] for r in s.rows), s.blank, s.duplicate, s.truncated, s.illegal, s.distinct, low, high, first, last, cost, audit, [r for r, _ in turns], [t for _, t in turns]


def _batch(keys: list, rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.schema([("key", pa.string()), *[(n, k) for n, _, k in PIECES]])
    columns = [keys, *[[r[i] for r in rows] for i in range(len(PIECES))]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


_PIECE_DDL = "key string, " + ", ".join(f"{n} {k}" for n, k, _ in PIECES)


def repair_whole(rows: list[tuple]) -> tuple:
    """The piece of a whole conversation: (turn, role, text, copies) in order."""
    known, marked = set(), []
    for turn, role, text, copies in rows:
        marked.append((turn, role, text, copies, (role, text) in known))
        if copies:
            known.add((role, text))
    s = Segment(marked)
    dist = distances(s.free, GOAL)
    audit, turns, _ = s.walk(START, dist, True)
    return _piece(s, 0, 1, dist[START] + DELETE * s.deleted, audit, turns)


def _order() -> list:
    return ["key", F.asc_nulls_first("turn"), "role", "text"]


def _short(rows: DataFrame) -> DataFrame:
    """Pieces of conversations of bounded size; rows of one meet in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, done, size = None, [], [], [], 0
        for chunk in chunks(batches, 2048):
            for key, *row in zip(*[chunk.column(i).to_pylist() for i in range(5)], strict=True):
                if key != now:
                    if held:
                        keys.append(now)
                        done.append(repair_whole(held))
                    now, held = key, []
                held.append(row)
                size += len(row[2])
                if size > PIECE_BYTES and keys:
                    yield _batch(keys, done)
                    keys, done, size = [], [], 0
        if held:
            keys.append(now)
            done.append(repair_whole(held))
        yield _batch(keys, done)

    dealt = rows.select("key", "turn", "role", "text", "copies").repartition("key").sortWithinPartitions(*_order())
    return map_arrow(dealt, run, _PIECE_DDL)


_ROW = "array<struct<turn: bigint, role: string, text: string, copies: bigint, seen: boolean>>"


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """key, place (in order, with gaps) and rows of the segments of long conversations; equal rows are one with copies."""
    runs = stored(rows.where("copies > 0").groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "runs")
    n = runs.count()
    least = F.struct(F.col("turn").isNotNull().alias("named"), F.col("turn").alias("turn"))
    firsts = runs.groupBy("key", "role", "text").agg(F.min(least).alias("first"))
    marked = spread_join(runs, firsts, ["key", "role", "text"], n).withColumn("seen", F.coalesce(F.col("turn"), F.lit(-(1 << 62))) != F.coalesce("first.turn", F.lit(-(1 << 62)))).drop("first")
    parts = max(1, n // segment_rows)
    kinds = pa.schema([("key", pa.string()), ("place", pa.int64()), ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("seen", pa.bool_())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close(key: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([place]), pa.array([held], kinds.field("rows").type)], schema=kinds)

        now = None
        for batch in batches:
            for row in batch.to_pylist():
                key = row.pop("key")
                if held and (key != now or len(held) >= segment_rows or size >= PIECE_BYTES):
                    yield close(now)
                    place, held, size = place + 1, [], 0
                now = key
                held.append(row)
                size += len(row["text"])
        if held:
            yield close(now)

    ordered = marked.select("key", "turn", "role", "text", "copies", "seen").repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    return stored(map_arrow(ordered, run, f"key string, place long, rows {_ROW}"), "segments")


def _each(segments: DataFrame, fn, schema: str) -> DataFrame:
    """fn of each segment's (key, place, Segment, further columns)."""
    names = segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment([(r["turn"], r["role"], r["text"], r["copies"], r["seen"]) for r in row["rows"]])
                yield fn(*[s if n == "rows" else row[n] for n in names])

    return map_arrow(segments, run, schema)


def _long(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Pieces of conversations of any size, by segments."""
    segments = _segments(rows, segment_rows)
    vector = pa.list_(pa.int64())

    def across(key: str, place: int, s: Segment) -> pa.RecordBatch:
        # From each state at the front to each at the back.
        found = [distances(s.free, [0 if q == end else FAR for q in range(4)])[:4] for end in range(4)]
        return pa.RecordBatch.from_pydict({"key": [key], "place": pa.array([place]), "costs": pa.array([[found[end][q] for q in range(4) for end in range(4)]], vector)})

    def from_back(group: pd.DataFrame) -> pd.DataFrame:
        # A few numbers a segment, so a conversation's are few even where its rows are many.
        group = group.sort_values("place", ascending=False)
        ahead, out = distances([], GOAL), []
        for k, (key, place, costs) in enumerate(zip(group["key"], group["place"], group["costs"], strict=True)):
            out.append((key, place, len(group) - 1 - k, len(group), ahead))
            ahead = [min(FAR, *[costs[4 * q + end] + ahead[end] for end in range(4)]) for q in range(4)]
        return pd.DataFrame(out, columns=["key", "place", "number", "pieces", "ahead"])

    costs = _each(segments, across, "key string, place long, costs array<bigint>")
    ahead = stored(costs.groupBy("key").applyInPandas(from_back, "key string, place long, number long, pieces long, ahead array<bigint>"), "ahead")
    known = segments.join(broadcast_if_few(ahead.drop("key")), "place")

    def final(segment: Segment, number: int, pieces: int, ahead: list[int]) -> tuple[list[int], bool]:
        last = number == pieces - 1
        return distances(segment.free, GOAL if last else ahead), last

    def exits(place: int, key: str, s: Segment, number: int, pieces: int, ahead: list[int]) -> pa.RecordBatch:
        dist, last = final(s, number, pieces, ahead)
        found = [s.walk(q, dist, last)[2] if dist[q] < FAR else START for q in range(4)]
        return pa.RecordBatch.from_pydict({"key": [key], "place": pa.array([place]), "exits": pa.array([found], vector)})

    def from_front(group: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for key, place, found in group.sort_values("place")[["key", "place", "exits"]].itertuples(index=False):
            out.append((place, state))
            state = int(found[state])
        return pd.DataFrame(out, columns=["place", "state"])

    chain = _each(known, exits, "key string, place long, exits array<bigint>")
    entry = stored(chain.groupBy("key").applyInPandas(from_front, "place long, state long"), "entry")

    def write(place: int, key: str, s: Segment, number: int, pieces: int, ahead: list[int], state: int) -> pa.RecordBatch:
        dist, last = final(s, number, pieces, ahead)
        audit, turns, end = s.walk(state, dist, last)
        return _batch([key], [_piece(s, number, pieces, dist[state] - (0 if last else ahead[end]) + DELETE * s.deleted, audit, turns)])

    return _each(known.join(broadcast_if_few(entry), "place"), write, _PIECE_DDL)


def repair_conversations(rows: DataFrame, copies: str | None = None, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Pieces of the repaired conversations of rows(conv_id, turn, role, text, ...): key, conv_id and PIECES.

    Rows are ordered by turn (nulls first), of one turn by role and text. copies may name a column that
    says how often a row occurs, one after the other; conversations whose rows all occur 0 times get an
    empty piece. A null role or text is one space, and thus another role or blank; rows of the null
    conv_id are one conversation. A row's first fault counts: blank, duplicate (role and text occurred
    before in any row), truncated. Texts are kept whole. Other columns are left out, whatever their names;
    an empty table gives no rows.
    """
    name = F.col("conv_id")
    key = F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    held = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), *space, (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    sizes = held.groupBy("key").agg(F.sum("copies").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    large = stored(sizes.where((F.col("rows") > piece_rows) | (F.col("bytes") > piece_bytes)).select("key"), "large")
    if large.isEmpty():
        found = _short(held)
    else:
        few = broadcast_if_few(large)
        found = _short(held.join(few, "key", "left_anti")).unionByName(_long(held.join(few, "key", "left_semi"), segment_rows))
    out = found.withColumn("conv_id", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType))
    out.whole = large.isEmpty()  # saves the report a look for conversations of several pieces
    return out


def _gaps(first: str, last: str, distinct: str) -> F.Column:
    return F.coalesce(F.col(last) - F.col(first) + 1 - F.col(distinct), F.lit(0)).cast("long").alias("gaps")


def _turns() -> F.Column:
    return F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text))


def report(pieces: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text` lines).

    pieces: what repair_conversations returns. The lines of a conversation of several pieces pass one
    after the other through one hash, without being gathered.
    """
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    digest = F.sha2(F.array_join(_turns(), "\n"), 256)
    whole = pieces.where("pieces = 1").select("conv_id", _gaps("first_turn", "last_turn", "distinct_turns"), *sums, "audit", digest.alias("repaired_sha256"))
    if getattr(pieces, "whole", False):
        return whole
    parts = stored(pieces.where("pieces > 1"), "pieces")
    w = W.partitionBy("key").orderBy("place")
    before = parts.select("key", "place", "conv_id", *sums, "audit", "distinct_turns", "first_turn", "last_turn", "first_initial", F.lag("last_initial").over(w).alias("initial"), F.max("last_turn").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("turn"))
    legal = F.concat("initial", "first_initial").isin(*sorted(LEGAL))
    before = before.withColumn("illegal", F.col("illegal") + F.coalesce((~legal).cast("int"), F.lit(0))).withColumn("distinct_turns", F.col("distinct_turns") - F.coalesce((F.col("turn") == F.col("first_turn")).cast("int"), F.lit(0)))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "").alias("audit")
    totals = before.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], audit, F.sum("distinct_turns").alias("distinct"), F.min("first_turn").alias("low"), F.max("last_turn").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, begun, out = None, hashlib.sha256(), False, []
        for batch in batches:
            for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest, begun = key, hashlib.sha256(), False
                for line in lines:
                    digest.update(b"\n" * begun + line.encode())
                    begun = True
        if now is not None:
            out.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.string()), "repaired_sha256": pa.array([d for _, d in out], pa.string())})

    lines = parts.select("key", "place", _turns().alias("lines")).repartition("key").sortWithinPartitions("key", "place").select("key", "lines")
    hashes = map_arrow(lines, run, "key string, repaired_sha256 string")
    return whole.unionByName(totals.join(hashes, "key").select("conv_id", _gaps("low", "high", "distinct"), *sums, "audit", "repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) with faults chosen by a hash of `conv_id:turn`, and copies.

    Of twenty hashes 0 drops a row, 1 empties its text, 2 takes away full stops, question and exclamation
    marks, 3 repeats the row, 4 makes its role user. Nulls are one space, but turn and conv_id stay null.
    """
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(space["conv_id"], F.lit(":"), space["turn"])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space["text"], "[.!?]", "")).otherwise(space["text"])
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(space["role"]).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies")
    )
