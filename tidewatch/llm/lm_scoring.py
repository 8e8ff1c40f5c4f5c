"""Language-model scores of documents: stupid backoff over token ids, computed relationally.

1. Texts are encoded once and stored as lots: the token ids of about a million tokens of documents.
2. Each lot explodes to its distinct n-grams of every order, with their counts in the lot, as packed
   columns by hash partition. An n-gram moves once a lot, however many of the lot's documents have it,
   so that a hot n-gram has no more entries than there are lots.
3. Each hash partition sums its lots' entries to its part of the count table and joins it with them at
   once: each lot gets the corpus counts of its n-grams, in order, without their keys.
4. Lots are joined with their counts. What a document itself has of an n-gram and of its context is
   taken out of both counts, and the logarithms are summed per document.

Keys are exact numbers (ids as digits), not hashes, and partitions grow in number with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, map_arrow, stored, worker_cache
from .tokens import ENCODED_ROWS, default_tokenizer, encoder

#: Fixed value of the method: the factor of a step back.
BACKOFF = 0.4
ORDER = 3
#: Token ids and documents that a task gathers to one lot; a longer text is a lot of its own.
LOT_TOKENS, LOT_DOCS = 1_000_000, 60_000
#: N-grams, repeats of a lot counted, that one hash partition is made for.
PARTITION_GRAMS = 8_000_000

_SPREAD = np.uint64(0x9E3779B97F4A7C15)

LOTS = "lot long, doc_ids array<bigint>, sizes array<bigint>, n_tokens long, table array<int>, ids binary"
_LOTS = pa.schema([("lot", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("table", pa.list_(pa.int32())), ("ids", pa.binary())])
GRAMS = "part int, lot long, gram int, n int, keys binary, counts binary"
_GRAMS = pa.schema([("part", pa.int32()), ("lot", pa.int64()), ("gram", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
TOTALS = "lot long, part int, gram int, n int, totals binary"
_TOTALS = pa.schema([("lot", pa.int64()), ("part", pa.int32()), ("gram", pa.int32()), ("n", pa.int32()), ("totals", pa.binary())])
SCHEMA = "doc_id long, n_tokens long, mean_log_score double, log_score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("mean_log_score", pa.float64()), ("log_score", pa.float64())])


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, all lowest bytes first: high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    return bytes([used]) + pa.Codec("zstd", compression_level=3).compress(planes[:used].tobytes(), asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    used = raw[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(pa.decompress(raw[1:], n * used, "zstd", asbytes=True), np.uint8).reshape(used, n).T
    return out.view("<u8").ravel()


def by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, the most frequent first, and each id's place among them: small numbers, which pack well."""
    counts = np.bincount(ids)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.zeros(len(counts), np.int64)
    place[table] = np.arange(len(table))
    return table, place[ids]


def _lots(docs: DataFrame, path: str) -> DataFrame:
    """Each lot's documents (doc_id and number of ids) and ids, these as places in a table by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        found: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            table, places = by_frequency(np.concatenate(found))
            row = (lot, names, [len(f) for f in found], held, table, pack(places))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _LOTS, strict=True)], schema=_LOTS)

        for chunk in chunks(batches, ENCODED_ROWS):
            for doc_id, ids in zip(chunk.column(0).to_pylist(), encoder(path).encode(chunk.column(1).to_pylist()), strict=True):
                if names and (held + len(ids) > LOT_TOKENS or len(names) >= LOT_DOCS):
                    yield close()
                    names, found, held = [], [], 0
                    lot += 1
                names.append(doc_id)
                found.append(ids)
                held += len(ids)
        if names:
            yield close()

    return map_arrow(docs.select("doc_id", "text"), run, LOTS)


class Grams:
    """The n-grams of a lot: each document is a start mark and its ids, and an n-gram ends at each of them.

    What stands before a document's start mark counts as start marks, too.
    """

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, start: int) -> None:
        self.base = np.uint64(start + 1)
        ends = np.cumsum(sizes + 1)
        self.first = ends - (sizes + 1)  # places of start marks
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        every = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        real = np.ones(len(every), bool)
        real[self.first] = False
        every[self.first] = start
        every[real] = ids
        self.every, self.real, self.start = every, np.flatnonzero(real), np.uint64(start)

    def keys(self, n: int) -> np.ndarray:
        """The n-gram that ends at each place, as a number whose digits are ids."""
        key, shifted = self.every.copy(), self.every
        for k in range(1, n):
            before = np.empty_like(shifted)
            before[1:] = shifted[:-1]
            before[self.first] = self.start
            key += before * self.base ** np.uint64(k)
            shifted = before
        return key


def _by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a lot's distinct n-grams, in order, are dealt: places by partition, where each partition starts, and which it is."""
    part = ((key * _SPREAD) >> np.uint64(40)) % np.uint64(parts)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint64)  # short numbers sort faster
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    return order, starts, part[starts]


def _read(batch: pa.Table | pa.RecordBatch, row: int, size: int) -> Grams:
    sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
    table = np.array(batch.column("table")[row].as_py(), np.uint64)
    return Grams(sizes, table[unpack(batch.column("ids")[row].as_py(), int(sizes.sum()))], size)


def score_documents(docs: DataFrame, tokenizer: str | None = None, order: int = ORDER, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """Stupid-backoff scores of every row of docs(doc_id, text, ...) by the counts of all rows.

    An id's score is log(c(g) / c(h)), where g is the longest n-gram (of at most `order` ids) ending at
    the id that another document has and h is g without the id, plus log(0.4) for each step back from
    `order`. Counts leave out the document that is scored, of g and of h alike; h of a single id is
    nothing, whose count is all ids of the other documents. An id that no other document has counts
    one step back more, as once in all. Each text is preceded by start marks.

    log_score is the sum over a document's ids and mean_log_score, which compares documents of any
    length, the mean. Null and empty texts have no ids, sum 0 and a null mean. Repeated rows are
    documents of their own. Very long texts are read whole, one to a lot. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    size = vocabulary_size(path)
    if order < 1 or (size + 1) ** order >= 1 << 64:
        raise ValueError(f"order {order} with {size} ids")
    lots = stored(_lots(docs, path), "lots")
    total = lots.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total * order // partition_grams))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("counts", dict)  # the encoder's memory is needed here
        for chunk in chunks(batches, 1):
            grams, lot = _read(chunk, 0, size), chunk.column("lot")[0].as_py()
            for n in range(1, order + 1):
                key, counts = np.unique(grams.keys(n), return_counts=True)
                at, starts, which = _by_part(key, parts)
                key, counts, ends = key[at], counts[at], np.r_[starts[1:], len(key)].astype(int)
                rows = [(int(p), lot, n, int(b - a), pack(np.diff(key[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for p, a, b in zip(which, starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GRAMS, strict=True)], schema=_GRAMS)

    def count(batch: pa.Table) -> pa.Table:
        """The partition's count table, joined with its lots' entries by their places."""
        give_back()
        out: list[tuple] = []
        for n in range(1, order + 1):
            rows = batch.filter(pa.array(batch.column("gram").to_numpy() == n, pa.bool_()))
            lengths = rows.column("n").to_pylist()
            key = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(unpack(k, m), dtype=np.uint64) for k, m in zip(rows.column("keys").to_pylist(), lengths, strict=True))])
            own = np.concatenate([np.zeros(0, np.uint64), *(unpack(c, m) for c, m in zip(rows.column("counts").to_pylist(), lengths, strict=True))])
            table, place = np.unique(key, return_inverse=True)
            del key
            sums = np.bincount(place, own, len(table)).astype(np.uint64)[place]
            at = 0
            for lot, part, m in zip(rows.column("lot").to_pylist(), rows.column("part").to_pylist(), lengths, strict=True):
                out.append((lot, part, n, m, pack(sums[at : at + m])))
                at += m
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_TOTALS)
        give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _TOTALS, strict=True)], schema=_TOTALS)

    def score(lot: pa.Table, totals: pa.Table) -> pa.Table:
        give_back()
        if not lot.num_rows:
            return _SCHEMA.empty_table()
        grams = _read(lot, 0, size)
        names, sizes = lot.column("doc_ids")[0].as_py(), np.diff(np.r_[grams.first, len(grams.every)]) - 1
        given = {(g, p): (r, n) for g, p, r, n in zip(*(totals.column(c).to_pylist() for c in ("gram", "part", "totals", "n")), strict=True)}
        real = grams.real
        above = np.full(len(grams.every), float(total)) - sizes[grams.doc]  # what others have of the context: all ids, for n = 1
        best: np.ndarray | None = None
        for n in range(1, order + 1):
            key = grams.keys(n)
            sort = np.argsort(key, kind="stable")  # by n-gram, then by document
            key, doc = key[sort], grams.doc[sort]
            new = np.r_[True, key[1:] != key[:-1]]
            at, _, which = _by_part(key[new], parts)
            everywhere = np.empty(len(at), np.uint64)
            everywhere[at] = np.concatenate([unpack(*given[n, int(p)]) for p in which])
            # What a document itself has of an n-gram stands together.
            runs = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]])
            own = np.repeat(np.diff(np.r_[runs, len(key)]), np.diff(np.r_[runs, len(key)]))
            others = np.empty(len(key))
            others[sort] = everywhere[np.cumsum(new) - 1].astype(np.float64) - own
            del key, sort, doc, new, at, runs, own, everywhere
            here, context = others[real], above[real] if n == 1 else above[real - 1]
            below = np.log(np.maximum(context, 1))
            if best is None:
                best = order * np.log(BACKOFF) - below  # no other document has the id
            best = np.where(here > 0, (order - n) * np.log(BACKOFF) + np.log(np.maximum(here, 1)) - below, best)
            above = others
        sums = np.bincount(grams.doc[real], best, len(names)) if len(real) else np.zeros(len(names))
        mean = [float(t) / s if s else None for t, s in zip(sums, sizes.tolist(), strict=True)]
        return pa.table([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(mean, pa.float64()), pa.array(sums, pa.float64())], schema=_SCHEMA)

    packed = map_arrow(lots.select("lot", "sizes", "table", "ids"), explode, GRAMS)
    counted = packed.groupBy("part").applyInArrow(count, TOTALS)
    return lots.select("lot", "doc_ids", "sizes", "table", "ids").groupBy("lot").cogroup(counted.groupBy("lot")).applyInArrow(score, SCHEMA)
