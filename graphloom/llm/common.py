"""What the operators share: scratch tables, Arrow batches, stable hashes.

Columns are selected and renamed on entry, so extra columns of the input, whatever
they are called, never reach an operator's own names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import scratch_path, ship
from graphloom.runtime import store as stored

__all__ = ["scratch_path", "stored", "ship"]  # passed on to the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_PER_BATCH rows and about BYTES_PER_BATCH bytes, so that a Python worker holds few long texts at once; ships the package.

    The session keeps these settings: plans read them when they run. Smaller ones of the session stay.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _number(size: str) -> int:
    """Of a setting like 256MB or 1000."""
    digits = size.lower().rstrip("bkmgt")
    return int(digits) << 10 * " kmgt".index(size.lower().rstrip("b")[-1]) if size.lower().rstrip("b") != digits else int(digits)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def id_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def fold(col: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(id_text(col).cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def per_row(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``fn`` maps each Arrow batch to columns of ``schema``; no row leaves its task."""
    bound_batches(df.sparkSession)
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(fn(b), schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain multiply and shift constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


class WordHash(dict):
    """Word (bytes) to a stable 64-bit hash, remembered up to a bound, and not if it is long."""

    def __init__(self, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.limit, self.longest = limit, longest

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
