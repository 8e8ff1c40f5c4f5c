"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of all benchmark items. Those of full length share one search, with the
shift table over blocks of two words; shorter items (whole sequences) get a search of their own for
each length, as their shifts are smaller. Tables are sorted arrays of 64-bit hashes, built once for a
pass and broadcast. The shifts of a document's blocks are looked up together; the walk moves by them, and
where a block has shift 0, the hash of suffix and prefix selects the few patterns that are compared as
text. What a pass broadcasts is bounded; a benchmark beyond that bound takes more passes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if_few, chunks, map_arrow, map_chunks, spread_join, stored, word_hashes

#: Words of a window.
WINDOW_WORDS = 10
#: Bytes of benchmark text of a pass; its tables take about ten times as much in each Python worker.
PASS_BYTES = 16_000_000

#: Bytes of ASCII letters lower-cased, digits and all of non-ASCII characters kept, the rest blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of 64-bit hashes."""
    out = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(31))


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of two words (of one, in patterns of one word)."""
    return hashes if size == 1 else _mix(hashes[:-1], hashes[1:])


@dataclass
class WuManber:
    """All patterns of one length in words, as sorted arrays: some 60 bytes a pattern, whatever their number."""

    length: int
    #: Hashes of blocks, and how far a window that ends with one may move.
    block: np.ndarray
    shift: np.ndarray
    #: Of each pattern the hash of its suffix and prefix blocks, its place in the text of its items, and its item.
    key: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, length: int, items: list[tuple[int, int, list[bytes], np.ndarray]]) -> WuManber:
        """The search of the windows of items (number, place in the text, words, their hashes)."""
        width = min(2, length)
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        for number, base, words, hashes in items:
            blocks = _blocks(hashes, width)
            windows = len(words) - length + 1
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = base + np.cumsum(lengths + 1) - 1
            # A block's least shift is that of the earliest window it lies in.
            shift = np.maximum(0, length - width - np.arange(len(blocks)))
            key = _mix(blocks[length - width :], blocks[:windows])
            for k, v in enumerate((blocks, shift, key, (ends - lengths)[:windows], ends[length - 1 :], np.full(windows, number))):
                found[k].append(v)
        blocks, shift, key, start, end, owner = (np.concatenate(x) for x in found)
        order = np.lexsort((shift, blocks))
        first = order[np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0])]
        by_key = np.argsort(key, kind="stable")
        return cls(length, blocks[first], shift[first].astype(np.uint8), key[by_key], start[by_key].astype(np.int32), end[by_key].astype(np.int32), owner[by_key].astype(np.int32))

    def search(self, words: list[bytes], hashes: np.ndarray, text: bytes) -> list[tuple[int, list[int]]]:
        """(start, items) of each occurrence; text: that of the items."""
        m, width = self.length, min(2, self.length)
        if len(words) < m:
            return []
        blocks = _blocks(hashes, width)
        place = np.minimum(np.searchsorted(self.block, blocks), len(self.block) - 1)
        shift = np.where(self.block[place] == blocks, self.shift[place], m - width + 1)
        if not (shift == 0).any():
            return []
        steps, ends, at, last = shift.tolist(), [], m - width, len(blocks)
        while at < last:  # at: the block that the window ends with
            if steps[at]:
                at += steps[at]
            else:
                ends.append(at)
                at += 1
        near = np.array(ends, np.int64)
        key = _mix(blocks[near], blocks[near - (m - width)])
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        found = []
        for k in np.flatnonzero(high > low).tolist():
            begin = ends[k] - (m - width)
            own = b" ".join(words[begin : begin + m])
            same = [int(self.owner[j]) for j in range(low[k], high[k]) if text[self.start[j] : self.end[j]] == own]
            if same:
                found.append((begin, same))
        return found


class BenchmarkSearch:
    """All patterns of some benchmark items, built once; items are known by their ids as text."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW_WORDS) -> None:
        self.items: list[str] = []
        by_length: dict[int, list] = defaultdict(list)
        texts, base, known = [], 0, WordHashes(1 << 22)
        for item_id, text in items:
            words = words_of(text)
            if words:
                by_length[min(window, len(words))].append((len(self.items), base, words, _hashes(words, known)))
                self.items.append(str(item_id))
                texts.append(b" ".join(words))
                base += len(texts[-1]) + 1
        self.text = b" ".join(texts)
        self.searches = [WuManber.of(length, found) for length, found in sorted(by_length.items())]

    def hits(self, words: list[bytes], known: dict[bytes, int] | None = None) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of all occurrences, and the items that have them."""
        spans, items = [], set()
        hashes = _hashes(words, word_hashes() if known is None else known)
        for search in self.searches:
            for at, owners in search.search(words, hashes, self.text):
                spans.append((at, at + search.length))
                items.update(owners)
        return spans, {self.items[i] for i in items}


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any span."""
    total = reach = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def passes_of(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The items of one pass after the other: of at most pass_bytes of text (or one longer item)."""
    held, taken = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        size = len((text or "").encode("utf-8", "replace"))
        if held and taken + size > pass_bytes:
            yield held
            held, taken = [], 0
        held.append((item_id, text))
        taken += size
    yield held


def _digest(items: set | list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _one_pass(docs: DataFrame, items: list, window: int, keep: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkSearch(items, window))
    rows = docs if keep else docs.select("doc_id", "text")
    place = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for chunk in chunks(batches):
            words = [words_of(t) for t in chunk.column(place).to_pylist()]
            found = [search.hits(w) for w in words]
            if keep:
                yield chunk.filter(pa.array([not spans for spans, _ in found], pa.bool_()))
                continue
            n_hit = [covered(spans) for spans, _ in found]
            columns = [chunk.column(0), [len(w) for w in words], n_hit, [len(i) for _, i in found], [_digest(i) for _, i in found], [h > 0 for h in n_hit]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, _REPORT, strict=True)], schema=_REPORT)

    return map_arrow(rows, run, docs.schema if keep else SCHEMA)


def _hits_of_pass(texts: DataFrame, items: list, window: int) -> DataFrame:
    """key, spans (starts and ends) and items of the texts(key, text) that have a window of the items; written."""
    shared = texts.sparkSession.sparkContext.broadcast(BenchmarkSearch(items, window))
    kinds = pa.schema([("key", pa.binary()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for chunk in chunks(batches):
            found = [(k, *search.hits(words_of(t))) for k, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True)]
            rows = [(k, [x for span in spans for x in span], sorted(items)) for k, spans, items in found if spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    out = stored(map_arrow(texts, run, "key binary, spans array<bigint>, items array<string>"), "hits")
    shared.destroy()
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, pass_bytes: int = PASS_BYTES, keep: bool = False) -> DataFrame:
    """Which words of docs(doc_id, text, ...) lie in a window of benchmark(item_id, text, ...).

    A null or empty text has no words and no hits; an item without words has no window. Repeated
    rows are reported each; texts of any length are read whole. Items with a null id count and are
    written as `None`; ids that repeat are one item. An empty benchmark hits nothing. With keep, the
    rows of docs that have no hit are returned instead, with all columns. A benchmark of at most
    pass_bytes is broadcast and searched in one pass; a larger one takes a pass for each such part, and
    only the hits of each are gathered.
    """
    passes = passes_of(benchmark, pass_bytes)
    first = next(passes)
    second = next(passes, None)
    if second is None:
        return _one_pass(docs, first, window, keep)
    key = F.sha2("text", 256).cast("binary")
    texts = docs.where(F.col("text").isNotNull()).select(key.alias("key"), "text")
    hits = reduce(DataFrame.union, [_hits_of_pass(texts, b, window) for b in chain([first, second], passes)])
    if keep:
        bad = stored(hits.select("key").distinct(), "bad")
        return docs.join(broadcast_if_few(bad), key == bad["key"], "left_anti")

    def merge(columns: dict[str, list]) -> dict[str, list]:
        spans = [list(zip(s[::2], s[1::2], strict=True)) for s in columns["spans"]]
        return {"key": columns["key"], "n_hit": [covered(s) for s in spans], "n_items": [len(i) for i in columns["items"]], "items_sha256": [_digest(i) for i in columns["items"]]}

    # Copies of a text have the same hits; a text's spans and items are no more than its words and the benchmark's items allow.
    grouped = hits.distinct().groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    found = stored(map_chunks(grouped, merge, "key binary, n_hit long, n_items long, items_sha256 string"), "found")
    words = map_chunks(docs.select("doc_id", key.alias("key"), "text"), lambda c: {"doc_id": c["doc_id"], "key": c["key"], "n_words": [len(words_of(t)) for t in c["text"]]}, "doc_id long, key binary, n_words long")
    none, zero = F.lit(_digest([])), F.lit(0).cast("long")
    out = spread_join(words, found, ["key"], docs.count(), "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'None') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM p),
o AS (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM s, d, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
h AS (SELECT k, i, size, item FROM o JOIN p USING (size, x)),
n AS (SELECT k, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + size)) AS u(j) GROUP BY k),
t AS (SELECT k, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN t USING (k)
"""
