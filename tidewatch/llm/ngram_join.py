"""Exact n-gram Jaccard join by grouped prefixes.

1. Census. Every document's set of 5-word shingles is hashed; the shingles whose hashes are low meet
   by hash partition and are counted. A document more than a fifth of whose shingles no other has
   cannot be like any other, and leaves. What moves are packed hashes of lots of documents; a shingle
   that several documents of a lot have moves once, without them.
2. The few documents left are read again; equal sets become one, and a second census among the
   sets drops those that had only exact copies.
3. The sets' shingles are ordered by frequency, rarest first; of each set the prefix stays that two
   like sets must share a shingle of. Sets with the same prefix and size form a group.
4. Groups that share a prefix shingle and have fitting sizes are candidates. While it joins many sets,
   each group meets one leader of its shingles and its members meet their first; verified pairs make
   their components one. What is left are pairs of groups that are not of one component: they are
   filtered by size and position, expanded to members of different components, and all verified. No
   link between components is lost, and no large group of copies is paired with itself.

All sets of a pair are compared shingle by shingle (by 64-bit hashes) before they count as linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_few, chunks, discard, map_arrow, spread_join, stored, word_hashes
from .components import connected_components

SHINGLE_WORDS = 5
#: Similarity of linked documents, as hundredths.
SIMILARITY = 80
#: Part of all hashes that the census looks at; above a fifth, so that unlike documents show.
CENSUS_SHARE = 0.4
#: Bytes of text that one hash partition of the census is made for.
PARTITION_BYTES = 16_000_000
#: Shingles and documents of one lot.
LOT_SHINGLES, LOT_DOCS = 600_000, 60_000
#: Stands for the documents of a shingle that several of a lot have.
_SEVERAL = 0xFFFFFFFF

#: Odd factors of the hash of a shingle.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)

_PACKED = pa.schema([("part", pa.int32()), ("lot", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("doc_ids", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
PACKED = "part int, lot long, docs binary, keys binary, doc_ids array<binary>, sizes array<bigint>"
_ANSWERS = pa.schema([("lot", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
ANSWERS = "lot long, docs binary, counts binary, doc_ids array<binary>, sizes array<bigint>"
_COUNTED = pa.schema([("id", pa.binary()), ("n", pa.int64()), ("alone", pa.int64())])
COUNTED = "id binary, n long, alone long"


def _mix(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, given the words' hashes."""
    count = len(words) - n + 1
    out = words[:count] * _FACTORS[0] + np.uint64(n)
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _FACTORS[k] + words[k : k + count]
    out = (out ^ (out >> np.uint64(32))) * _FACTORS[2]
    out = (out ^ (out >> np.uint64(29))) * _FACTORS[4]
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, hashes: dict[bytes, int] | None = None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: of n words, or of the whole text if it has fewer."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = word_hashes() if hashes is None else hashes
    return np.unique(_mix(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), min(n, len(words))))


def _census(rows: DataFrame, sets_of, total_bytes: int) -> DataFrame:
    """id, n (size of the set) and alone (low shingles that no other row has) of every row.

    rows has the columns id (binary) and a second one that sets_of turns to a list of sets.
    """
    parts = max(1, -(-total_bytes // PARTITION_BYTES))
    low = int(CENSUS_SHARE * 2**64)
    width = np.uint64(low // parts + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() << 32
        names: list[bytes | None] = []
        sizes: list[int] = []
        kept: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            key = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(kept), dtype="<u4"), [len(k) for k in kept])
            order = np.argsort(key, kind="stable")
            doc, key = doc[order], key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            doc = np.where(np.diff(np.r_[new, len(key)]) > 1, np.uint32(_SEVERAL), doc[new]).astype("<u4")
            key = key[new]
            part = (key // width).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(part)].astype(int)
            out = [(int(part[a]), lot, doc[a:b].tobytes(), key[a:b].astype("<u8").tobytes(), None, None) for a, b in zip(starts, ends, strict=True)]
            out.append((lot % parts, lot, None, None, names, sizes))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)

        held = 0
        for chunk in chunks(batches):
            for name, found in zip(chunk.column(0).to_pylist(), sets_of(chunk.column(1)), strict=True):
                names.append(name)
                sizes.append(len(found))
                kept.append(found[: np.searchsorted(found, np.uint64(low))])
                held += len(found)
            if held >= LOT_SHINGLES or len(names) >= LOT_DOCS:
                yield close()
                names, sizes, kept, held = [], [], [], 0
                lot += 1
        if names:
            yield close()

    def count(batch: pa.Table) -> pa.Table:
        lots, docs_of, keys = (batch.column(c).to_pylist() for c in ("lot", "docs", "keys"))
        filled = [i for i, k in enumerate(keys) if k is not None]
        _, place, times = np.unique(np.frombuffer(b"".join(keys[i] for i in filled), "<u8"), return_inverse=True, return_counts=True)
        alone = times[place] == 1
        alone &= np.frombuffer(b"".join(docs_of[i] for i in filled), "<u4") != _SEVERAL
        out, at = [], 0
        for i in filled:
            doc = np.frombuffer(docs_of[i], "<u4")
            which, counts = np.unique(doc[alone[at : at + len(doc)]], return_counts=True)
            out.append((lots[i], which.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), None, None))
            at += len(doc)
        out += [(lots[i], None, None, batch.column("doc_ids")[i].as_py(), batch.column("sizes")[i].as_py()) for i, k in enumerate(keys) if k is None]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_ANSWERS)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWERS, strict=True)], schema=_ANSWERS)

    def add(batch: pa.Table) -> pa.Table:
        docs_of, counts = batch.column("docs").to_pylist(), batch.column("counts").to_pylist()
        head = next(i for i, d in enumerate(docs_of) if d is None)
        names, sizes = batch.column("doc_ids")[head].as_py(), batch.column("sizes")[head].as_py()
        doc = np.frombuffer(b"".join(d for d in docs_of if d), "<u4")
        alone = np.bincount(doc, np.frombuffer(b"".join(c for c in counts if c), "<u4"), len(names)).astype(np.int64)
        return pa.table([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(alone)], schema=_COUNTED)

    answers = map_arrow(rows, pack, PACKED).groupBy("part").applyInArrow(count, ANSWERS)
    return answers.groupBy("lot").applyInArrow(add, COUNTED)


def _may_link(n: Column, alone: Column) -> Column:
    """Whether a set with so many shingles of its own can still have another as similar as asked."""
    return (n > 0) & (100 * alone <= (100 - SIMILARITY) * n)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, sid (128-bit hash of the set), n and shingles of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary())])
        for chunk in chunks(batches):
            found = [shingles(t) for t in chunk.column(1).to_pylist()]
            raw = [f.astype("<u8").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array([len(f) for f in found], pa.int64()), pa.array(raw, pa.binary())], schema=kinds)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, sid binary, n long, shingles binary")


def _tokens(sets: DataFrame) -> DataFrame:
    """sid, rep, n and shingles, the latter as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("sid", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for chunk in chunks(batches):
            found = pa.array([np.frombuffer(r, "<i8") for r in chunk.column(3).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), chunk.column(2), found], schema=kinds)

    return map_arrow(sets.select("sid", "rep", "n", "shingles"), run, "sid binary, rep long, n long, shingles array<bigint>")


def _prefixes(sets: DataFrame) -> DataFrame:
    """sid, rep, n, own, gid and prefix (array of place and shingle) of every set whose prefix has a shared shingle.

    Shingles are ordered by frequency, then hash. Those of one set alone come first and fill the
    prefix, but they can't match and are only counted, as own.
    """
    every = sets.select("sid", "rep", "n", F.explode("shingles").alias("s"))
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    n = sets.agg(F.sum("n")).first()[0] or 0
    shared = spread_join(every, counts, ["s"], n, counts=counts.withColumnRenamed("df", "_n"))
    shared = shared.groupBy("sid").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    long = F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") / F.lit(100)) + 1
    first = F.col("n") - F.size("x")
    cut = shared.withColumn("room", (long - first).cast("int")).withColumn("first", first).where("room > 0")
    prefix = F.transform(F.slice("x", F.lit(1), F.col("room")), lambda e, i: F.struct((F.col("first") + i).alias("i"), e["s"].alias("s")))
    cut = cut.select("sid", "rep", "n", F.col("first").cast("long").alias("own"), prefix.alias("prefix"))
    name = F.md5(F.concat_ws(",", F.col("n").cast("string"), F.array_join(F.transform("prefix", lambda e: e["s"].cast("string")), ",")))
    return cut.withColumn("gid", name)


def _fits(a: str, b: str) -> Column:
    """Sizes of two sets that can be as similar as asked."""
    return (F.lit(100) * F.least(a, b) >= F.lit(SIMILARITY) * F.greatest(a, b)) & F.col(a).isNotNull()


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) of sids whose sets are as similar as asked. pairs are stored; those of one leader are dealt to several tasks."""
    one = tokens.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = tokens.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    n = pairs.count()
    counts = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    return spread_join(spread_join(pairs, one, ["a"], n), two, ["b"], n, counts=counts).where(100 * both >= SIMILARITY * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _star_pairs(postings: DataFrame, turn: int, n: int) -> DataFrame:
    """For each of about n groups' postings the leader, of another component, that shares most prefix shingles with it.

    Leaders are the groups with fewest shingles of their own, which are nearest to what copies were
    made from; from turn to turn more of them count alike, and a hash chooses among them.
    """
    banded = postings.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))))
    rank = F.struct(F.floor(F.col("own") / (1 + 4 * turn)).alias("own"), F.xxhash64("gid", F.lit(turn)).alias("h"), F.col("sid").alias("to_sid"), F.col("n").alias("to_n"), F.col("comp").alias("to_comp"))
    leaders = banded.groupBy("s", "band").agg(F.min(rank).alias("x")).select("s", "band", "x.to_sid", "x.to_n", "x.to_comp")
    near = banded.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    # An entry is its set's, its band's and its neighbours'.
    met = spread_join(near, leaders, ["s", "band"], 3 * n).where((F.col("comp") != F.col("to_comp")) & _fits("n", "to_n"))
    best = met.groupBy("sid", "to_sid").agg(F.count("*").alias("k")).groupBy("sid").agg(F.max(F.struct("k", "to_sid")).alias("x"))
    return best.select(F.greatest("sid", "x.to_sid").alias("a"), F.least("sid", "x.to_sid").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(sid, gid, comp) with components that new links join made one."""
    a, b = (labels.select(F.col("sid").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    n = links.count()
    joined = spread_join(spread_join(links, a, ["a"], n), b, ["b"], n).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = connected_components(joined).withColumnsRenamed({"node": "comp", "component": "found"})
    return spread_join(labels, found, ["comp"], labels.count(), "left").select("sid", "gid", F.coalesce("found", "comp").alias("comp"))


def _group_pairs(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of sids of different components, of groups that may be alike by prefix, size and position."""
    groups = postings.groupBy("s", "gid").agg(F.first("n").alias("n"), F.first("i").alias("i"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    here, there = (groups.select("s", *[F.col(c).alias(f"{x}_{c}") for c in ("gid", "n", "i", "c", "d")]) for x in "xy")
    # From the first shared shingle on no more can be shared than either set has left.
    enough = 9 * (F.least(F.expr("x_n - x_i"), F.expr("y_n - y_i"))) >= 4 * (F.col("x_n") + F.col("y_n"))
    apart = ~((F.col("x_c") == F.col("x_d")) & (F.col("y_c") == F.col("y_d")) & (F.col("x_c") == F.col("y_c")))
    met = here.join(there, (here["s"] == there["s"]) & (F.col("x_gid") >= F.col("y_gid")) & apart & _fits("x_n", "y_n") & enough)
    met = met.select("x_gid", "y_gid").distinct()
    one, two = (labels.select(F.col("gid").alias(f"{x}_gid"), F.col("sid").alias(f"{x}_sid"), F.col("comp").alias(f"{x}_comp")) for x in "xy")
    both = met.join(one, "x_gid").join(two, "y_gid").where((F.col("x_comp") != F.col("y_comp")) & ((F.col("x_gid") != F.col("y_gid")) | (F.col("x_sid") > F.col("y_sid"))))
    return both.select(F.greatest("x_sid", "y_sid").alias("a"), F.least("x_sid", "y_sid").alias("b")).distinct()


def set_components(sets: DataFrame) -> DataFrame:
    """sid and comp (the smallest rep reachable by links) of sets(sid, rep, n, shingles) that may have links.

    rep is the smallest doc_id of a set. Every link is verified; of links inside a component some are
    not looked for.
    """
    members = stored(_prefixes(sets), "prefixes")
    labels = members.select("sid", "gid", F.col("rep").alias("comp"))
    slow, last, tried, turn, before, finished = False, False, None, 0, [], []
    every = members.select("sid", "gid", "n", "own", F.explode("prefix").alias("p")).select("sid", "gid", "n", "own", "p.s", "p.i")
    while True:
        # Buckets of a prefix shingle where more than one component is left.
        postings = every.join(labels.select("sid", "comp"), "sid")
        buckets = postings.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("_n"))
        mixed = buckets.where("x <> y").select("s")
        postings = stored(spread_join(postings, mixed, ["s"], every.count(), counts=buckets.select("s", "_n")), "postings")
        every = postings.drop("comp")
        for done in before:
            discard(done)
        before = [postings]
        sizes = postings.groupBy("s", "comp").count().groupBy("s").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("same"))
        n, left = sizes.agg(F.sum("all"), F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()
        if not n:
            break
        # Leaders go on as long as they join sets, however often that is.
        last = turn > 0 and (slow or left <= 4 * n)
        if last:
            pairs = _group_pairs(postings, labels)
        else:
            # One posting a group and component stands for its members; members meet their group's first.
            stand = postings.groupBy("s", "gid", "comp").agg(F.min("sid").alias("sid"), F.first("n").alias("n"), F.min("own").alias("own"))
            pairs = _star_pairs(stand, turn, n)
            if turn == 0:
                firsts = labels.groupBy("gid").agg(F.min("sid").alias("b"), F.max("sid").alias("z")).where("b <> z").select("gid", "b")
                pairs = pairs.union(labels.join(firsts, "gid").where("sid <> b").select(F.col("sid").alias("a"), "b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        finished.append(pairs)
        links = stored(_verified(pairs, sets), "links")
        old, labels = labels, stored(_merged(labels, links), "labels")
        finished += [old] * (turn > 0)
        before += [links]
        if last:
            break
        slow = 1000 * links.count() < n
        turn += 1
    if turn or last:
        finished.append(members)
    for done in before + finished:
        discard(done)
    return labels.select("sid", "comp")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text, ...).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one doc_id are
    one document: its links are those of all its rows. A row with a null doc_id is linked with
    nothing and has a null component. Texts of any length are read whole. Other columns are left out;
    an empty table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("string").cast("binary").alias("id"), "text")
    counted = stored(_census(rows, lambda column: map(shingles, column.to_pylist()), total), "census")
    counted = counted.select(F.col("id").cast("string").cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), "alone")
    maybe = counted.where(_may_link(F.col("n_shingles"), F.col("alone")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    found = stored(_sets(docs.select("doc_id", "text").join(broadcast_if_few(maybe), "doc_id", "left_semi")).where("n > 0"), "sets")
    members = stored(found.select("doc_id", "sid").distinct(), "members")
    different = found.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    different = stored(different, "different")
    reps = stored(different.select("sid", "rep"), "reps")
    discard(found)
    held = different.agg(F.sum("n")).first()[0] or 0
    alone = _census(different.select(F.col("sid").alias("id"), "shingles"), lambda column: (np.frombuffer(r, "<u8") for r in column.to_pylist()), 6 * held)
    alike = alone.where(_may_link(F.col("n"), F.col("alone"))).select(F.col("id").alias("sid"))
    tokens = stored(_tokens(different.join(alike, "sid", "left_semi")), "tokens")
    discard(different)
    comps = set_components(tokens)
    every = reps.join(comps, "sid", "left").select("sid", F.coalesce("comp", "rep").alias("comp"))
    labelled = stored(spread_join(members, every, ["sid"], members.count()), "labels")
    # Rows of one document in several components make these one.
    several = labelled.groupBy("doc_id").agg(F.min("comp").alias("b"), F.max("comp").alias("z")).where("b <> z").select("doc_id", "b")
    if not several.isEmpty():
        more = labelled.join(several, "doc_id").where("comp <> b").select(F.col("comp").alias("a"), "b")
        found = connected_components(more).withColumnsRenamed({"node": "comp", "component": "found"})
        labelled = spread_join(labelled, found, ["comp"], members.count(), "left").withColumn("comp", F.coalesce("found", "comp"))
    by_doc = labelled.groupBy("doc_id").agg(F.min("comp").alias("component_id"))
    without = counted.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return counted.where("doc_id IS NOT NULL").join(by_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).union(without)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component; of equal ids one row stays."""
    found = stored(link_documents(docs), "components")
    out = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_few(out), "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
