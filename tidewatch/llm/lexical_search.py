"""Ranked lexical search by Block-Max WAND over an inverted index in a table.

1. Counts. One pass over the documents gives their number and the number of their terms.
2. Index. Documents are dealt to lots. A lot has a row for each of its terms: postings in the order of
   documents, cut to blocks of 128, each packed in as few bytes as its gaps and counts need. Beside the
   packed blocks lie each block's first and last documents and its largest impact. A row without a term has the
   documents' ids and lengths. The index has all terms of all documents, whatever the queries are.
3. Search. Only rows of query terms move, to the task of their lot. There, for each query, the blocks'
   ends cut a lot's documents to spans in which the same blocks are open, so that the sum of their
   largest impacts bounds every score. A shallow move goes, by these bounds alone, to the next spans
   that can reach the lowest score among the best so far; only the blocks open there are unpacked, and
   their documents scored. The best of one lot are the threshold of the next one of the same task.
4. Of each task's best documents of a query the best of all are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_few, chunks, map_arrow, stored
from .decontamination import words_of

#: Documents returned for each query.
BEST = 50
#: Postings of a block.
BLOCK_POSTINGS = 128
#: Bytes of text and documents of a lot, and lots searched by one task.
LOT_BYTES, LOT_DOCS, TASK_LOTS = 16_000_000, 60_000, 4
#: Spans that are scored before the threshold is looked at again.
WAVE_SPANS = 256
#: (query, term) pairs that are broadcast and searched for in one pass over the index.
PASS_TERMS = 500_000

_INDEX = pa.schema([("lot", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("reach", pa.binary()), ("high", pa.binary()), ("width", pa.binary()), ("payload", pa.binary())])
INDEX = "lot long, term binary, df long, reach binary, high binary, width binary, payload binary"


class _Vocabulary(dict):
    """term -> number, in the order of first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count gives in documents of the given lengths (in hundredths of the mean, damped)."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each block: values fit in one, two or four bytes."""
    high = np.maximum.reduceat(values, starts)
    return (high > 0xFF).astype(np.uint8) + (high > 0xFFFF)


def lot_rows(lot: int, ids: list[int | None], words: list[list[bytes]], n_docs: int, n_terms: int) -> list[tuple]:
    """The index rows of one lot of documents, n_docs and n_terms being those of all documents."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    ids, words = [ids[i] for i in order], [words[i] for i in order]
    vocabulary = _Vocabulary()
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.fromiter((vocabulary[x] for w in words for x in w), np.int64, int(lengths.sum()))
    m = 50 + 50 * lengths * n_docs // max(n_terms, 1)
    held = np.array([i is not None for i in ids], np.uint8)
    named = np.array([i or 0 for i in ids], "<i8")
    out = [(lot, None, len(ids), named.tobytes(), held.tobytes(), None, m.astype("<i8").tobytes())]
    if not len(codes):
        return out
    pairs, tf = np.unique(codes * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    code, doc = np.divmod(pairs, len(ids))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    df = np.diff(np.r_[first, len(code)])
    place = np.arange(len(code)) - np.repeat(first, df)
    starts = np.flatnonzero(place % BLOCK_POSTINGS == 0)
    ends = np.r_[starts[1:], len(code)]
    gaps = np.where(place % BLOCK_POSTINGS > 0, doc - np.r_[0, doc[:-1]] - 1, 0)
    gap_width, tf_width = _widths(gaps, starts), _widths(tf, starts)
    reach = np.stack([doc[starts], doc[ends - 1]], axis=1).astype("<i4").tobytes()
    high = np.maximum.reduceat(impact(tf, m[doc]), starts).astype("<i4").tobytes()
    width = (gap_width * 3 + tf_width).astype(np.uint8).tobytes()
    packed = [[v.astype(f"<u{1 << k}").tobytes() for k in range(3)] for v in (gaps, tf)]
    blocks = [packed[0][g][a << g : b << g] + packed[1][t][a << t : b << t] for a, b, g, t in zip(starts.tolist(), ends.tolist(), gap_width.tolist(), tf_width.tolist(), strict=True)]
    at = 0
    for term, n in zip(vocabulary, df.tolist(), strict=True):
        to = at - (-n // BLOCK_POSTINGS)
        out.append((lot, term, n, reach[8 * at : 8 * to], high[4 * at : 4 * to], width[at:to], b"".join(blocks[at:to])))
        at = to
    return out


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index of all rows of docs(doc_id, text, ...), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        words: list[list[bytes]] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            rows = lot_rows(lot, ids, words, n_docs, n_terms)
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096], strict=True), _INDEX, strict=True)], schema=_INDEX)

        for chunk in chunks(batches):
            for name, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                ids.append(name)
                words.append(words_of(text))
                held += len(text or "")
                if held >= LOT_BYTES or len(ids) >= LOT_DOCS:
                    yield from close()
                    ids, words, held = [], [], 0
                    lot += 1
        if ids:
            yield from close()

    return stored(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, INDEX), "index")


def count_terms(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    kinds = pa.schema([("docs", pa.int64()), ("terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for chunk in chunks(batches):
            for text in chunk.column(0).to_pylist():
                found = len(words_of(text))
                n, terms = n + (found > 0), terms + found
        yield pa.RecordBatch.from_pydict({"docs": [n], "terms": [terms]}, kinds)

    row = map_arrow(docs.select("text"), run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


class Postings:
    """The packed blocks of one term in a lot."""

    def __init__(self, df: int, reach: bytes, high: bytes, width: bytes, payload: bytes, m: np.ndarray) -> None:
        self.first, self.last = np.frombuffer(reach, "<i4").reshape(-1, 2).T.astype(np.int64)
        self.high = np.frombuffer(high, "<i4").astype(np.int64)
        self.width, self.payload, self.m = np.frombuffer(width, np.uint8), payload, m
        sizes = np.full(len(self.last), BLOCK_POSTINGS)
        sizes[-1] = df - BLOCK_POSTINGS * (len(sizes) - 1)
        self.sizes = sizes
        self.offsets = np.cumsum(np.r_[0, sizes * ((1 << self.width // 3) + (1 << self.width % 3))])
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, unpacked when first asked for."""
        if k not in self.open:
            n, at, (g, t) = int(self.sizes[k]), int(self.offsets[k]), divmod(int(self.width[k]), 3)
            gaps = np.frombuffer(self.payload, f"<u{1 << g}", n, at)
            tf = np.frombuffer(self.payload, f"<u{1 << t}", n, at + (n << g)).astype(np.int64)
            doc = np.cumsum(gaps.astype(np.int64) + 1) + (int(self.first[k]) - 1)
            self.open[k] = doc, impact(tf, self.m[doc])
        return self.open[k]


class Best:
    """The best documents of a query so far: by falling score, then by document, those without id last."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.score, self.unnamed, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """The score that a document needs to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        score, unnamed, doc = np.r_[self.score, score], np.r_[self.unnamed, unnamed], np.r_[self.doc, doc]
        order = np.lexsort((doc, unnamed, -score))[: self.most]
        self.score, self.unnamed, self.doc = score[order], unnamed[order], doc[order]


class Lot:
    """One lot of documents; unpacked counts the blocks that were unpacked."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, m: np.ndarray, terms: dict[bytes, tuple]) -> None:
        self.ids, self.unnamed, self.m, self.rows = ids, named == 0, m, terms
        self.postings: dict[bytes, Postings] = {}
        self.scored = 0

    def of(self, term: bytes) -> Postings:
        if term not in self.postings:
            self.postings[term] = Postings(*self.rows[term], self.m)
        return self.postings[term]

    @property
    def unpacked(self) -> int:
        return sum(len(p.open) for p in self.postings.values())

    def search(self, query: list[tuple[bytes, int]], best: Best) -> None:
        """Adds the documents that are among the best of the query, given as terms and weights."""
        lists = [(self.of(term), weight) for term, weight in query if term in self.rows]
        if not lists:
            return
        counts = [len(p.last) for p, _ in lists]
        which, number = np.repeat(np.arange(len(lists)), counts), np.concatenate([np.arange(n) for n in counts])
        begin, end = np.concatenate([p.first for p, _ in lists]), np.concatenate([p.last for p, _ in lists]) + 1
        most = np.concatenate([w * p.high for p, w in lists])
        # Spans lie between the ends of blocks; a span's bound is the sum of the open blocks' largest impacts.
        at, place = np.unique(np.r_[begin, end], return_inverse=True)
        change = np.bincount(place, np.r_[most, -most], len(at))
        bound = np.cumsum(change)[:-1]
        here = 0
        while True:
            near = np.flatnonzero(bound[here:] >= best.threshold)[:WAVE_SPANS] + here
            if not len(near):
                return
            here = int(near[-1]) + 1
            low, high = int(at[near[0]]), int(at[near[-1] + 1])
            marks = np.zeros(high - low + 1, np.int64)
            marks[at[near] - low] += 1
            marks[at[near + 1] - low] -= 1
            wanted = np.cumsum(marks[:-1]) > 0
            before = np.r_[0, np.cumsum(wanted)]
            opened = np.flatnonzero(before[np.clip(end - low, 0, high - low)] > before[np.clip(begin - low, 0, high - low)])
            found = [(lists[i][0].block(k), lists[i][1]) for i, k in zip(which[opened].tolist(), number[opened].tolist(), strict=True)]
            doc = np.concatenate([b[0] for b, _ in found]) - low
            gain = np.concatenate([b[1] * w for b, w in found])
            inside = (doc >= 0) & (doc < high - low)
            # Sums stay far below 2^53, where doubles are exact.
            score = np.bincount(doc[inside], gain[inside], high - low).astype(np.int64)
            self.scored += int(wanted.sum())
            good = np.flatnonzero(wanted & (score >= best.threshold))
            best.add(score[good], self.unnamed[good + low], self.ids[good + low])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[Lot]:
    """Lots of rows that come lot by lot."""
    lot, head, terms = None, None, {}
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in _INDEX.names]
        for number, term, df, reach, high, width, payload in zip(*columns, strict=True):
            if number != lot:
                if head:
                    yield Lot(*head, terms)
                lot, head, terms = number, None, {}
            if term is None:
                head = np.frombuffer(reach, "<i8"), np.frombuffer(high, np.uint8), np.frombuffer(payload, "<i8")
            else:
                terms[term] = (df, reach, high, width, payload)
    if head:
        yield Lot(*head, terms)


def query_terms(queries: DataFrame) -> DataFrame:
    """item (the id as text) and its different terms, of queries(item_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("item", pa.string()), ("term", pa.binary())])
        for chunk in chunks(batches):
            rows = [(i, w) for i, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True) for w in dict.fromkeys(words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return map_arrow(queries.select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, term binary").distinct()


def _search_pass(index: DataFrame, weights: DataFrame, lots: int, best: int) -> DataFrame:
    """item, doc_id and score of each task's best documents of the queries in weights(item, term, weight)."""
    wanted: dict[str | None, list[tuple[bytes, int]]] = {}
    for r in weights.toLocalIterator():
        wanted.setdefault(r["item"], []).append((bytes(r["term"]), r["weight"]))
    shared = index.sparkSession.sparkContext.broadcast([(item, sorted(q)) for item, q in wanted.items()])
    terms = weights.select("term").distinct()
    rows = index.where("term IS NULL").unionByName(index.where("term IS NOT NULL").join(broadcast_if_few(terms), "term", "left_semi").select(index.columns))
    kinds = pa.schema([("item", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        found = [Best(best) for _ in queries]
        for lot in _lots(batches):
            for (_, query), b in zip(queries, found, strict=True):
                lot.search(query, b)
        for at in range(0, len(found), 512):
            some = found[at : at + 512]
            item = [q[0] for q, b in zip(queries[at : at + 512], some, strict=True) for _ in b.doc]
            doc = pa.array(np.concatenate([b.doc for b in some]), pa.int64(), mask=np.concatenate([b.unnamed for b in some]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), doc, pa.array(np.concatenate([b.score for b in some]))], schema=kinds)

    dealt = rows.repartition(max(1, -(-lots // TASK_LOTS)), "lot").sortWithinPartitions("lot")
    return map_arrow(dealt, run, "item string, doc_id long, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, best: int = BEST, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the best rows of docs(doc_id, text, ...) for each of queries(item_id, text, ...).

    Every row of docs is a document, repeated ones too; of equal scores the smaller doc_id comes first,
    null ids last. Rows of queries with one item_id (null is one as well) are one query of all their
    terms. Null, empty and termless texts match nothing; a query without a match has no rows. Texts of
    any length are read whole; other columns are left out; empty tables give no rows. More than
    pass_terms pairs of queries and terms are dealt to passes over the index by their query.
    """
    n_docs, n_terms = count_terms(docs)
    index = build_index(docs, n_docs, n_terms)
    terms = stored(query_terms(queries), "terms")
    df = index.join(broadcast_if_few(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    weights = stored(terms.join(df, "term").select("item", "term", weight.alias("weight")).where("weight > 0"), "weights")
    lots = index.where("term IS NULL").count()
    passes = max(1, -(-weights.count() // pass_terms))
    found = [_search_pass(index, weights.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k), lots, best) for k in range(passes)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(F.col("item").cast(queries.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (SELECT item_id, term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM q JOIN f USING (term) CROSS JOIN s),
m AS (SELECT k, doc_id, 50 + (50 * len(w) * n) // l AS m FROM d CROSS JOIN s WHERE len(w) > 0),
r AS (SELECT item_id, k, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM x JOIN t USING (term) JOIN m USING (k) GROUP BY item_id, k)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
