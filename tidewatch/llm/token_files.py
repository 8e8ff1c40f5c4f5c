"""Token ids in directly addressable blocks.

A block splits each id into bytes: level 0 holds the lowest byte of every id, a bitmap tells which
ids go on, and level k + 1 holds the next byte of those alone. A rank directory counts the set bits
before every 512th bit, so the place of any id on the next level is one lookup and a short count:
`Block.id` and `Block.document` read an id or a document and decode nothing else. Blocks hold whole
documents and their table; they are stored without compression as binary rows of a Parquet data set,
which any store that Spark knows can hold, with the documents' ids and ends beside them as an index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, broadcast_if_few, chunks, map_arrow, shared_path, stored
from .tokens import ENCODED_ROWS, LARGE_CACHE_WORDS, default_tokenizer, encoder

#: Fixed values of the format.
MAGIC = b"TWD1"
RANK_BITS = 512
#: Ids of a block at which it is closed, and bytes of text that a part file is made for.
BLOCK_TOKENS = 1_000_000
PART_BYTES = 32_000_000

FILE_SCHEMA = "part long, block long, start_in_part long, n_tokens long, doc_ids array<bigint>, ends array<bigint>, payload binary"
_FILE = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"

_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_block(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """One block: header, document table (ids, null flags, ends), then the levels."""
    ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    ends = np.cumsum([len(d) for d in documents], dtype="<i8")
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_BITS[bits], np.arange(0, len(bits), RANK_BITS // 8), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    head = [MAGIC, struct.pack("<qqq", len(doc_ids), len(ids), len(levels))]
    head += [struct.pack("<qqq", *map(len, level)) for level in levels]
    table = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls, ends.tobytes()]
    return b"".join(head + table + [part for level in levels for part in level])


class Block:
    """Reads one block without decoding it."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a token block")
        self.n_docs, self.n_tokens, depth = struct.unpack_from("<qqq", raw, 4)
        sizes = [struct.unpack_from("<qqq", raw, 28 + 24 * k) for k in range(depth)]
        at = 28 + 24 * depth
        ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        nulls = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, nulls, strict=True)]
        at += 9 * self.n_docs
        self.ends = np.frombuffer(raw, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.levels = []
        for a, b, c in sizes:
            self.levels.append((np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c // 4, at + a + b)))
            at += a + b + c

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        first = block * (RANK_BITS // 8)
        n = int(ranks[block]) + int(_BITS[bits[first : i // 8]].sum())
        return n + (bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def id(self, i: int) -> int:
        """The id at place i, by one rank a level."""
        value = 0
        for level, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places start to end."""
        out = np.zeros(max(0, end - start), "<u4")
        places = np.arange(len(out))
        for level, (low, bits, _) in enumerate(self.levels):
            if not len(places):
                break
            out[places] |= low[start:end].astype("<u4") << np.uint32(8 * level)
            more = np.unpackbits(bits[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            places = places[more]
            if len(places):
                start = self._rank(level, start)
                end = start + len(places)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, cache_words: int = LARGE_CACHE_WORDS) -> None:
    """Writes the ids of docs(doc_id, text, ...) in ascending doc_id order as blocks to path.

    Part files are ranges of doc_id, as many as the texts' size asks for; null ids come first. Rows of
    one id follow each other by a hash of their texts, by which a very frequent id is dealt to several
    parts. A null or empty text is the end id alone. Other columns are left out.
    """
    source = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names, found, held, before, block = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            row = (part, block, before, held, names, np.cumsum([len(f) for f in found]), encode_block(names, found))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FILE, strict=True)], schema=_FILE)

        for chunk in chunks(batches, ENCODED_ROWS):
            for doc_id, ids in zip(chunk.column(0).to_pylist(), encoder(source, cache_words).encode(chunk.column(1).to_pylist()), strict=True):
                names.append(doc_id)
                found.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                held += len(found[-1])
                if held >= block_tokens:
                    yield close()
                    before, block = before + held, block + 1
                    names, found, held = [], [], 0
        if names:
            yield close()

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(max(1, -(-total // PART_BYTES)), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    map_arrow(ordered.select("doc_id", "text"), run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at path: doc_id, start, n_tokens, ids_crc32. Documents are read one by one."""
    blocks = spark.read.parquet(path)
    # One row per part file reaches the driver, never one per document or block.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    first, total = {}, 0
    for row in sizes:
        first[row["part"]] = total
        total += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(SCHEMA)
        for chunk in chunks(batches, 1):
            part, before, raw = (chunk.column(i)[0].as_py() for i in range(3))
            block = Block(raw)
            ends = block.ends.tolist()
            starts = [0, *ends[:-1]][: len(ends)]
            crcs = [zlib.crc32(block.document(k)) for k in range(block.n_docs)]
            base = first[part] + before
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()), pa.array(crcs, pa.int64())],
                schema=kinds,
            )

    return map_arrow(blocks.select("part", "start_in_part", "payload"), run, SCHEMA)


#: Part files that a read of single ids names one by one.
MOST_PARTS = 10_000


def read_ids(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """doc_id, place and id (int) of places(doc_id, place) in the files at path, by one rank a level.

    The index beside the payloads says where the wanted documents are; if they lie in few part files
    (MOST_PARTS), only these are read, by a filter on the files' statistics. A place beyond its document,
    or an unknown or null doc_id, gives no row; of rows with one doc_id each gives one.
    """
    blocks = spark.read.parquet(path)
    table = blocks.select("part", "block", F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("k", "d")).select("part", "block", "k", F.col("d.doc_ids").alias("doc_id"))
    wanted = table.join(broadcast_if_few(places.select("doc_id", "place").dropna()), "doc_id")
    by_block = stored(wanted.groupBy("part", "block").agg(F.collect_list("k").alias("ks"), F.collect_list("place").alias("places")), "places")
    parts = [r["part"] for r in by_block.select("part").distinct().limit(MOST_PARTS + 1).collect()]
    if len(parts) <= MOST_PARTS:
        blocks = blocks.where(F.col("part").isin(parts))
    kinds = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            ks, at, raw = (chunk.column(i)[0].as_py() for i in range(3))
            block = Block(raw)
            starts = np.r_[0, block.ends]
            rows = [(block.doc_ids[k], p, block.id(int(starts[k]) + p)) for k, p in zip(ks, at, strict=True) if 0 <= p < starts[k + 1] - starts[k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=kinds)

    found = blocks.select("part", "block", "payload").join(broadcast_if_few(by_block), ["part", "block"])
    return map_arrow(found.select("ks", "places", "payload"), run, "doc_id long, place long, id long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the token files of docs(doc_id, text, ...) to the shared folder and reads their documents back.

    A row per row of docs, in the order of write_token_files: null and empty texts have the end id
    alone, a null doc_id comes back as null, repeated rows come back each, texts of any length are
    kept whole, and an empty table gives no rows.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
