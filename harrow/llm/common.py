"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that is unset and all runs on one machine, as in tests, a new local folder is taken.
    """
    global _own_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None or not os.path.isdir(_own_dir):
        _own_dir = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialise` that no later plan reads."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, and that column's name.

    Numbers of a plan that is run twice may differ, as lost executors change how files are split; a written table's don't.
    """
    row = fresh(df, "__row")
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def identified(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a text that tells its rows apart, and that column's name.

    Rows read straight from Parquet files are named by file and place in it, which no lost executor changes; others
    are written once with numbers.
    """
    row = fresh(df, "__row")
    try:
        named = df.withColumn(row, F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")))
        named.schema  # noqa: B018  # analysed here, so that a table without this metadata is known at once
    except AnalysisException:
        named, row = numbered(df)
        named = named.withColumn(row, F.col(row).cast("string"))
    return named, row


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, null text as empty; all other columns go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def crc_bucket(column: Column | str, modulus: int) -> Column:
    """crc32 of a value's decimal text, modulo ``modulus``; a null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs from the keys of their parts (the finisher of a well-known 64-bit hash)."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def portions(batches: Iterator[pa.RecordBatch], *texts: str, size: int = 500, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, in order: at most ``size`` rows, and about ``max_bytes`` of the columns ``texts`` or one row."""
    for batch in batches:
        total = np.zeros(batch.num_rows, np.int64)
        for name in texts:
            total += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(total)
        at = 0
        while at < batch.num_rows:
            passed = total[at - 1] if at else 0
            end = max(at + 1, min(at + size, int(np.searchsorted(total, passed + max_bytes))))
            yield batch.slice(at, end - at)
            at = end


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of the named columns; few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield from zip(*(batch.column(n).slice(at, 200).to_pylist() for n in names), strict=True)


class Memory(dict):
    """A dictionary of words and what was worked out for them, cleared when it holds about ``max_bytes``."""

    #: Bytes that an entry takes besides its word and value.
    ENTRY = 200
    #: Longer words are worked out anew each time.
    LONGEST = 1000

    def __init__(self, max_bytes: int = 32 << 20):
        super().__init__()
        self.max_bytes, self.held_bytes = max_bytes, 0

    def remember(self, word: bytes | str, value: Any, size: int = 0) -> Any:
        weight = self.ENTRY + len(word) + size
        if weight <= self.ENTRY + self.LONGEST:
            if self.held_bytes + weight > self.max_bytes:
                self.clear()
            self.held_bytes += weight
            self[word] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.held_bytes = 0


class Frequent(Memory):
    """A memory that takes a word up when it comes a second time, and gives up every fourth entry when it is full.

    Words that come once, most of a large text's different words, so never push out those that come again.
    """

    ENTRY = 150
    #: Places for marks of words seen once, by hash, and how many are set before all are taken off again.
    PLACES, MOST_MARKS = 1 << 20, 600_000

    def __init__(self, max_bytes: int = 64 << 20):
        super().__init__(max_bytes)
        self._unmark()

    def _unmark(self) -> None:
        self.marked, self.marks = bytearray(self.PLACES), 0

    def remember(self, word: bytes, value: bytes, size: int = 0) -> bytes:
        place = hash(word) % self.PLACES
        if not self.marked[place]:
            if self.marks == self.MOST_MARKS:
                self._unmark()
            self.marked[place] = 1
            self.marks += 1
            return value
        weight = self.ENTRY + len(word) + size
        if weight <= self.ENTRY + self.LONGEST:
            if self.held_bytes + weight > self.max_bytes:
                for word_ in list(islice(self, 0, None, 4)):
                    self.held_bytes -= self.ENTRY + len(word_) + self.size_of(self.pop(word_))
            self.held_bytes += weight
            self[word] = value
        return value

    @staticmethod
    def size_of(value: bytes) -> int:
        """The size that a value was remembered with."""
        return len(value)


_worker: dict[Any, Any] = {}


def worker_memory(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a Python worker for its later tasks until another key is asked for.

    So a worker that serves several stages holds the memory of one of them at a time.
    """
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]


def batched(rows_: Iterator[tuple], schema: pa.Schema, size: int = 4096, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, or about ``max_bytes`` of text and binary values."""
    held: list[tuple] = []
    weight = 0
    for row in rows_:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, bytes | str))
        if len(held) >= size or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
