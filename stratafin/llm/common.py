"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte table that lower-cases A-Z and leaves every other byte, so also UTF-8 sequences, alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it
    wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "stratafin_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "stratafin")):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def release_memory() -> None:
    """Return what a finished task has freed to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Arrays of this size and more are mapped one by one, see ``return_arrays``.
MAPPED_BYTES = 1 << 20
_M_MMAP_THRESHOLD = -3


def return_arrays() -> None:
    """Free what earlier tasks left, and let every large array go back to the system as soon as it is freed.

    By default the allocator keeps ever larger arrays on its heap once one of their size was freed, where
    small objects pin them.
    """
    release_memory()
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """Arrow batches of a partition through a Python function of this package."""
    ship(df.sparkSession)

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(released, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(id_col: str, parts: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def vote_counts(hashes: np.ndarray) -> np.ndarray:
    """How many 64-bit hashes have each bit set, lowest bit first, along the last axis.

    Eight masked adds per hash: each byte lane of a sum of at most 255 hashes holds one count.
    """
    lead, n = hashes.shape[:-1], hashes.shape[-1]
    if n == 0:
        return np.zeros((*lead, 64), dtype=np.int64)
    rows = -(-n // 255)
    padded = np.zeros((*lead, rows * 255), dtype="<u8")
    padded[..., :n] = hashes
    padded = padded.reshape(*lead, rows, 255)
    counts = np.empty((*lead, 8, 8), dtype=np.int64)
    for shift in range(8):
        sums = ((padded >> np.uint64(shift)) & _LANES).sum(axis=-1, dtype=np.uint64)
        counts[..., shift] = sums.astype("<u8").view(np.uint8).reshape(*lead, rows, 8).sum(axis=-2)
    return counts.reshape(*lead, 64)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1, lowest bit first, to signed 64-bit words."""
    return np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little").view("<i8")


def mixed(hashes: np.ndarray, lane: int | np.ndarray) -> np.ndarray:
    """The ``lane``-th independent 64-bit hash derived from 64-bit hashes (splitmix finaliser);
    an array of lanes gives one row for each."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.multiply(np.uint64(0x9E3779B97F4A7C15), np.asarray(lane, np.uint64)[..., None] + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
