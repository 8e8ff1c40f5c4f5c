"""Helpers that several text operators share: shared folders, word rules, worker state."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a Python worker handles at once; bounds a worker's memory.
CHUNK_ROWS = 256
#: Rows of the batches that the JVM sends to Python workers.
ARROW_ROWS = 2048

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is spark.checkpoint.dir; only in local mode, where a session sets none, a temporary
    folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tidewatch-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of keys that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def broadcast_if_few(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """keys (a few numbers a row), marked for broadcast if they are at most `most` by count."""
    return F.broadcast(keys) if keys.count() <= most else keys


#: Rows of a few numbers that one task can always take.
TASK_ROWS = 10_000


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], n: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows (about n of them) joined with values, which has at most one row a key.

    A key with over a thousandth of the rows is dealt to several tasks, and its row of values is
    repeated for each; there are a thousand such keys at most, so they are broadcast, and two thousand
    repeats. Null keys match nothing and are dealt to a thousand. counts, if given, has how many rows each key has, as _n.
    So few rows that one task can take all of them are not dealt.
    """
    if n <= TASK_ROWS:
        return rows.join(values, keys, how)
    most = max(1, n // 1000)
    counts = rows.groupBy(keys).agg(F.count("*").alias("_n")) if counts is None else counts
    heavy = F.broadcast(counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts")))
    deal = F.xxhash64(*keys, F.monotonically_increasing_id())
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.pmod(deal, F.when(missing, 1000).otherwise(F.coalesce("_salts", F.lit(1)))).cast("int")
    dealt = rows.join(heavy, keys, "left").withColumn("_salt", salt).drop("_salts")
    repeated = values.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def hash_share(value: Column, share: Column) -> Column:
    """True for the values in the lowest `share` (a number, all from 1 on) of 64-bit hashes."""
    return (share >= 1) | ((F.xxhash64(value).cast("double") + 2.0**63) < share * 2.0**64)


def worker_cache(kind: str, make: Callable[[], object]) -> object:
    """This Python worker's cache of a kind, made if it has none. A worker holds one kind at a time, so
    that what one operator remembers doesn't take memory from the next."""
    state = sys.modules.setdefault("_tidewatch_worker_state", types.ModuleType("_tidewatch_worker_state"))
    if getattr(state, "kind", None) != kind:
        state.kind, state.cache = kind, None
        state.cache = make()
    return state.cache


def give_back() -> None:
    """Gives freed memory back to the system: an idle worker lives on beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL schema of longs, ints, doubles, booleans, strings and binaries."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "float": pa.float32(),
    }
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(","))])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow with batches of at most ARROW_ROWS rows, which the session keeps as its setting.

    An executor's JVM and its Python workers each hold whole batches, and rows here are whole texts.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, ARROW_ROWS)
    return df.mapInArrow(fn, schema)


def map_chunks(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, setup: Callable[[], object] | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """df.mapInArrow with fn over chunks of at most `rows` rows, given and returned as column lists.

    setup, if any, is called once a task and its value passed to fn as a second argument.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(schema)
        state = setup() if setup else None
        for chunk in chunks(batches, rows):
            columns = {n: chunk.column(i).to_pylist() for i, n in enumerate(names)}
            out = fn(columns, state) if setup else fn(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return map_arrow(df, run, schema)


class WordHashes(dict):
    """word bytes -> xxh64 as unsigned 64-bit; forgets all beyond `limit` words."""

    def __init__(self, limit: int = 150_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes() -> WordHashes:
    return worker_cache("word hashes", WordHashes)
