"""Hierarchical packing of documents into token sequences of several lengths.

Each task packs its own partition, so nothing is shuffled and a hot source costs nothing extra:
documents are routed to context-size tiers by length, tiers are packed from the longest down, gaps
of longer windows are filled with the best fitting pieces of shorter tiers, the last gap with a cut
piece, and the sequences of a window of documents are dealt to step groups of equal token counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, chunks, map_arrow
from .tokens import ENCODED_ROWS, LARGE_CACHE_WORDS, default_tokenizer, encoder

#: Lengths of the context tiers, all powers of two.
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task gathers before it packs them; bounds its memory.
WINDOW_TOKENS = 1_000_000
#: Tokens of one step group.
STEP_TOKENS = 65_536

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Packer:
    """Packs items (doc, start, length) into full windows; keeps what fills none for later.

    An item is a part of a document that is not placed yet. Items shorter than a window are kept
    sorted by length, so that the best fitting one is found by bisection.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.items: list[tuple[int, int, int]] = []  # (length, doc, start), ascending

    def add(self, doc: int, length: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Cuts whole longest windows off a document; the rest waits in its tier."""
        top, done = self.tiers[-1], []
        start = 0
        while length - start >= top:
            done.append((top, [(doc, start, top)]))
            start += top
        if length > start:
            insort(self.items, (length - start, doc, start))
        return done

    def _take(self, at: int, most: int) -> tuple[int, int, int]:
        """Removes the item at a place, or what fits of it; the rest goes back to its tier."""
        length, doc, start = self.items.pop(at)
        if length > most:
            insort(self.items, (length - most, doc, start + most))
            length = most
        return doc, start, length

    def pack(self, last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Full sequences (tier, pieces). With last, all items are placed: what fills no tier is padded."""
        done = []
        left = sum(x[0] for x in self.items)
        while self.items:
            longest = self.items[-1][0]
            tier = next(t for t in self.tiers if longest <= t)
            if tier > left:  # too little is left to fill this window
                if not last:
                    break
                tier = max((t for t in self.tiers if t <= left), default=self.tiers[-1])
            pieces, gap = [], min(tier, left)
            while gap:
                at = bisect_right(self.items, (gap, 1 << 62, 0)) - 1
                piece = self._take(max(at, 0), gap)
                pieces.append(piece)
                gap -= piece[2]
            left -= sum(p[2] for p in pieces)
            done.append((tier, pieces))
        return done


def step_groups(lengths: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence, longest first to the group with fewest tokens."""
    import heapq

    heap = [(0, g) for g in range(max(1, round(sum(lengths) / tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        have, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (have + lengths[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = TIERS, window_tokens: int = WINDOW_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False, cache_words: int = LARGE_CACHE_WORDS) -> DataFrame:
    """Pieces of packed sequences of docs(doc_id, text, ...); other columns are left out.

    A document's ids are its text's, by the tokenizer file, and end_id. A null text is empty and has
    the end id alone; repeated rows and null doc_ids are packed as documents of their own. A text of
    more tokens than the longest tier, however long, is cut to windows of that tier and a rest. Sequence
    and group ids are unique over partitions. At most one sequence of a partition is padded. Step
    groups have equal token counts within the documents that a task gathers (window_tokens).
    with_ids adds each piece's ids as little-endian unsigned 32-bit bytes. An empty table gives no rows.
    cache_words is how many words' ids a worker remembers: fewer take less memory and more time.
    """
    path = tokenizer or default_tokenizer()
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds = arrow_schema(schema)
        base = TaskContext.get().partitionId() << 32
        packer, ids, names = Packer(tiers), {}, {}
        sequences = groups = number = gathered = 0

        def emit(done: list) -> pa.RecordBatch:
            nonlocal sequences, groups
            dealt = step_groups([sum(p[2] for p in pieces) for _, pieces in done], step_tokens)
            columns: list[list] = [[] for _ in kinds]
            for (tier, pieces), group in zip(done, dealt, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    raw = ids[doc][start : start + length].tobytes()
                    row = (names[doc], start, length, zlib.crc32(raw), len(ids[doc]), base + sequences, offset, tier, base + groups + group, raw)
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
                    offset += length
                sequences += 1
            groups += max(dealt, default=-1) + 1
            waiting = {x[1] for x in packer.items}
            for doc in [d for d in ids if d not in waiting]:
                del ids[doc], names[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        done: list = []
        for chunk in chunks(batches, ENCODED_ROWS):
            texts = encoder(path, cache_words).encode(chunk.column(1).to_pylist())
            for doc_id, found in zip(chunk.column(0).to_pylist(), texts, strict=True):
                ids[number] = np.append(found, np.uint32(end_id)).astype("<u4")
                names[number] = doc_id
                done += packer.add(number, len(ids[number]))
                gathered += len(ids[number])
                number += 1
            if gathered >= window_tokens:
                yield emit(done + packer.pack())
                done, gathered = [], 0
        yield emit(done + packer.pack(last=True))

    return map_arrow(docs.select("doc_id", "text"), run, schema)
