"""Texts as blocks of word codes, and questions about their words answered once per distinct key.

A block is a run of documents (about ``block_bytes`` of text) with its own dictionary.  A question
about a key (a word, a pair of words) is dealt to buckets by the key's hash: a block sends each
bucket one packed row, the bucket answers every distinct key once, and the answers return to the
block in the order asked.  A frequent word thus travels once per block, not once per use, and a
bucket's size follows the number of buckets, which follows the size of the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import map_batches, return_arrays
from stratafin.llm.token_files import slices
from stratafin.session import stage_folder

BLOCK_BYTES = 16 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 8
#: Text that is cut into words at once; its words are Python objects.
SLICE_BYTES = 2 << 20
#: Largest number of hash buckets of files of a table of blocks (a limit of the table format).
MOST_FILES = 50_000
BLOCK_SCHEMA = "block long, ids binary, sizes binary, codes binary, words binary, marks binary"


def pack_ints(values: np.ndarray) -> bytes:
    """32-bit numbers, byte planes compressed."""
    planes = np.ascontiguousarray(np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_longs(values: np.ndarray) -> bytes:
    """64-bit numbers, byte planes compressed; counts of a corpus of any size fit."""
    planes = np.ascontiguousarray(np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack_longs(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return zstandard.compress(len(words).to_bytes(8, "little") + sizes.tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 8).astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip([8 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def bucket_count(docs: DataFrame) -> int:
    """Buckets for a corpus of this size, with at least ``LEAST_BUCKETS``."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def stored(table: DataFrame, buckets: int) -> DataFrame:
    """Write a table of blocks to the shared folder, bucketed by block, and read it back."""
    spark = table.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{stage_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"
    table.write.bucketBy(min(buckets, MOST_FILES), "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def blocks(docs: DataFrame, coder: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[bytes]]], buckets: int, mark=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written table of blocks, bucketed by block so that answers meet it without moving it.

    ``coder`` gives codes, offsets and words of an array of texts;
    a block's words are sorted by bucket and then by word, and its codes follow that order.

    ``mark`` is a boolean column kept for each document.
    """

    def run(batches):
        return_arrays()
        serial, ids, sizes, codes, marks, number, size = 0, [], [], [], [], {}, 0

        def block():
            words = list(number)
            at = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
            order = sorted(range(len(words)), key=lambda i: (at[i], words[i]))
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            rows = [
                pa.array([TaskContext.get().partitionId() << 32 | serial], pa.int64()),
                pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                pa.array([pack_ints(np.concatenate(sizes))], pa.binary()),
                pa.array([pack_ints(place[np.concatenate(codes)])], pa.binary()),
                pa.array([pack_words([words[i] for i in order])], pa.binary()),
                pa.array([np.concatenate(marks).astype(np.uint8).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(rows, ["block", "ids", "sizes", "codes", "words", "marks"])

        for whole in batches:
            for batch in slices(whole, 2, SLICE_BYTES):
                found, offsets, words = coder(batch.column(2))
                local = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
                ids.append(batch.column(0).fill_null(-(2**63)).to_numpy())
                marks.append(batch.column(1).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(offsets))
                codes.append(local[found])
                size += batch.column(2).nbytes
                if size >= block_bytes:
                    yield block()
                    serial, ids, sizes, codes, marks, number, size = serial + 1, [], [], [], [], {}, 0
        if ids:
            yield block()

    kept = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if mark is None else F.coalesce(mark, F.lit(False))).alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(map_batches(kept, run, BLOCK_SCHEMA), buckets)


def bucket_bounds(words: list[bytes], buckets: int) -> np.ndarray:
    """Where each bucket's words start in a block's dictionary, and its end."""
    at = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
    return np.searchsorted(at, np.arange(buckets + 1))


def document_ids(data: bytes) -> pa.Array:
    ids = np.frombuffer(data, "<i8")
    return pa.array(ids, pa.int64(), mask=ids == -(2**63))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def asked(stored: DataFrame, ask: Callable[[dict], Iterator[tuple[int, bytes, bytes]]], columns: list[str]) -> DataFrame:
    """(bucket, block, keys, extra) rows: what each block asks each bucket."""

    def run(batches):
        for row in rows_of(batches):
            for bucket, keys, extra in ask(row):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([keys], pa.binary()), pa.array([extra], pa.binary())], ["bucket", "block", "keys", "extra"])

    return map_batches(stored.select("block", *columns), run, "bucket int, block long, keys binary, extra binary")
