"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its 3-word shingles' hashes have it. Different
fingerprints are linked if at most three bits differ, so one of their two halves differs in one bit at
most. Each fingerprint has an entry in the tables of both halves and looks up the small Hamming ball
round each half; as a pair whose halves differ in one bit is met from the side that has the bit,
only set bits need clearing. What meets in a table is verified by the complete distance.

1. Equal fingerprints are one; only buckets of a table that several of them meet in are kept.
2. Stars: while buckets would make many pairs, each one's members meet one leader. Buckets of a single
   component leave, so near copies of one text are never all paired with each other.
3. Pairs of different components that still share a bucket are compared. A bucket that would make more
   pairs than balls of radius two have points is searched by these instead: whoever is within two bits
   of a point and whoever is within one of it differ in at most three, so all of them are linked with
   one of the latter, at a fixed number of rows a fingerprint.

Stars, pairs and balls give true links only, and between different components lose none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_few, chunks, discard, map_arrow, spread_join, stored
from .components import connected_components

SHINGLE_WORDS = 3
#: Bits that linked fingerprints differ in at most; the halves and balls here are made for three.
MOST_BITS = 3
#: Fixed value: seed of the shingles' hashes.
SEED = 42
#: Points of a ball of radius one and two among 64 bits.
BALLS = (1 + 64, 1 + 64 + 64 * 63 // 2)
#: Pairs of different components that an entry may have, on average, for all pairs to be compared.
PAIR_ROWS = 8
#: Shingles whose bits are counted at once.
COUNTED_SHINGLES = 65_536


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as an unsigned number; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), COUNTED_SHINGLES):
        spans = zip(starts[at : at + COUNTED_SHINGLES].tolist(), ends[at : at + COUNTED_SHINGLES].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row of docs(doc_id, text, ...)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = np.array([fingerprint(t) for t in chunk.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], schema=kinds)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _halves(fp: Column) -> list[Column]:
    """The halves' values, those of the upper half marked by a bit above."""
    return [fp.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fp, 32).bitwiseOR(1 << 32)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _flips(bits: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), _bit)


def _cleared(half: Column) -> Column:
    """The half's value with each of its set bits cleared in turn."""
    return F.transform(F.filter(_flips(32), lambda bit: half.bitwiseAND(bit) != 0), lambda bit: half.bitwiseXOR(bit))


def _table_entries(fps: DataFrame) -> DataFrame:
    """fp, key and home: where each fingerprint is in the two tables (home), and where else it looks."""
    halves = _halves(F.col("fp"))
    looks = F.transform(F.concat(*map(_cleared, halves)), lambda key: F.struct(key.alias("key"), F.lit(False).alias("home")))
    homes = F.array(*[F.struct(half.alias("key"), F.lit(True).alias("home")) for half in halves])
    return fps.select("fp", F.explode(F.concat(homes, looks)).alias("e")).select("fp", "e.key", "e.home")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _buckets(entries: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """The entries of buckets in counts(key, members), with members."""
    few = broadcast_if_few(counts)
    return entries.join(few, "key") if few is not counts else spread_join(entries, counts, ["key"], n, counts=counts.withColumnRenamed("members", "_n"))


def _shared_entries(fps: DataFrame, n: int) -> DataFrame:
    """Entries of the buckets where a fingerprint that is at home there meets another."""
    entries = _table_entries(fps)
    counts = entries.groupBy("key").agg(F.count("*").alias("members"), F.max("home").alias("home")).where("members > 1 AND home").select("key", "members")
    return _buckets(entries, stored(counts, "buckets"), 34 * n).drop("members")


def _stars(entries: DataFrame, turn: int, n: int) -> DataFrame:
    """Links (a, b) of fingerprints with their buckets' leaders, which a hash chooses anew each turn."""
    order = F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), F.col("fp").alias("to_fp"), F.col("comp").alias("to_comp"))
    leaders = entries.groupBy("key").agg(F.min(order).alias("x")).select("key", "x.to_fp", "x.to_comp")
    met = spread_join(entries, leaders, ["key"], n).where((F.col("comp") != F.col("to_comp")) & (_distance("fp", "to_fp") <= MOST_BITS))
    return met.select(F.col("comp").alias("a"), F.col("to_comp").alias("b")).distinct()


def _pairs(entries: DataFrame) -> DataFrame:
    """Links (a, b) of components by all pairs of those that share a bucket, one of them at home there."""
    here = entries.where("home").select("key", F.col("fp").alias("x"), F.col("comp").alias("a"))
    there = entries.select("key", F.col("fp").alias("y"), F.col("comp").alias("b"))
    return here.join(there, "key").where((F.col("a") != F.col("b")) & (_distance("x", "y") <= MOST_BITS)).select("a", "b").distinct()


def ball_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that join all of fps(fp, comp; n rows) whose fingerprints differ in at most three bits.

    Points are shared by at most as many fingerprints as lie round them, but rows are always so many a
    fingerprint: each of n meets one leader at each point of its ball.
    """
    one, two = F.transform(_flips(), lambda bit: F.col("fp").bitwiseXOR(bit)), F.col("fp")
    near = F.concat(F.array(two), one)
    leaders = fps.select("fp", "comp", F.explode(near).alias("z")).groupBy("z").agg(F.min(F.struct("fp", "comp")).alias("x")).select("z", F.col("x.comp").alias("b"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(i, F.lit(63)), lambda j: _bit(i).bitwiseOR(_bit(j))))
    far = F.concat(F.array(two), F.transform(F.flatten(steps), lambda bits: F.col("fp").bitwiseXOR(bits)))
    points = fps.select(F.col("comp").alias("a"), F.explode(far).alias("z"))
    return spread_join(points, leaders, ["z"], BALLS[1] * n).where("a <> b").select("a", "b").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(fp, comp) with components that links(a, b) join made one."""
    found = connected_components(links).withColumnsRenamed({"node": "comp", "component": "found"})
    return spread_join(labels, found, ["comp"], labels.count(), "left").select("fp", F.coalesce("found", "comp").alias("comp"))


def fingerprint_components(fps: DataFrame, ball_rows: int = BALLS[1], pair_rows: int = PAIR_ROWS) -> DataFrame:
    """fp and comp (a fingerprint that stands for all reachable by links) of fps(fp), which are different.

    Stars go on until at most pair_rows pairs an entry are left, or until they join few. Buckets that
    then have more than ball_rows pairs a member are searched by balls.
    """
    n = fps.count()
    labels = fps.select("fp", F.col("fp").alias("comp"))
    entries = stored(_shared_entries(fps, n), "entries")
    size, found, turn = entries.count(), n, 0
    while size:
        here = spread_join(entries.select("key", "fp", "home"), labels, ["fp"], size)
        each = here.groupBy("key", "comp").agg(F.count("*").alias("k"), F.max("home").alias("home"))
        mixed = each.groupBy("key").agg(F.sum("k").alias("members"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("comps"), F.max("home").alias("home"))
        mixed = stored(mixed.where("home AND comps > 1").select("key", "members", (F.col("members") * F.col("members") - F.col("same")).alias("pairs")), "mixed")
        left = stored(_buckets(here, mixed.select("key", "members"), size).select("key", "fp", "home", "comp"), "left")
        discard(entries)
        pairs = mixed.agg(F.sum("pairs")).first()[0] or 0
        entries, size = left, left.count()
        if not size:
            break
        last = pairs <= 2 * pair_rows * size or 100 * found < size
        links = stored(_last_links(left, mixed, size, ball_rows) if last else _stars(left, turn, size), "links")
        found, turn = links.count(), turn + 1
        if found:
            labels = stored(_merged(labels, links), "fingerprints")
        discard(links)
        discard(mixed)
        if last:
            break
    discard(entries)
    return labels


def _last_links(left: DataFrame, mixed: DataFrame, size: int, ball_rows: int) -> DataFrame:
    """Links (a, b) of all components that share a bucket of left(key, fp, home, comp; size rows), by pairs or balls."""
    heavy = mixed.where(F.col("pairs") > ball_rows * F.col("members")).select("key", "members")
    if heavy.isEmpty():
        return _pairs(left)
    light = left.join(broadcast_if_few(heavy.select("key")), "key", "left_anti")
    dense = stored(_buckets(left, heavy, size).select("fp", "comp").distinct(), "dense")
    return _pairs(light).union(ball_links(dense, dense.count())).distinct()


def _joined_by_id(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with the components of the rows(doc_id, fp) of one doc_id made one."""
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("to"), F.max("fp").alias("z")).where("to <> z").select("doc_id", "to")
    links = stored(rows.join(broadcast_if_few(several), "doc_id").where("fp <> to").select("fp", "to").distinct(), "repeated")
    if links.isEmpty():
        return labels
    a, b = (labels.select(F.col("fp").alias(k), F.col("comp").alias(c)) for k, c in (("fp", "a"), ("to", "b")))
    return _merged(labels, links.join(a, "fp").join(b, "to").where("a <> b").select("a", "b"))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links reach, its own included. Null, empty and blank texts
    have the fingerprint zero and are linked like any other. Rows of one doc_id are one document: its
    links are those of all its rows, each of which is returned. A row with a null doc_id is linked with
    nothing and has a null component. Texts of any length are read whole. Other columns are left out,
    whatever their names; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs), "documents")
    named = rows.where(F.col("doc_id").isNotNull())
    reps = stored(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")), "reps")
    labels = _joined_by_id(named, fingerprint_components(reps.select("fp")))
    n = rows.count()
    both = spread_join(reps, labels, ["fp"], n)
    names = both.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_fp = spread_join(both.select("fp", "comp"), names, ["comp"], n).select("fp", "component_id")
    out = spread_join(rows, by_fp, ["fp"], n, "left", counts=reps.select("fp", "_n"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
