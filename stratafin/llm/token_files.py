"""Token ids in files of patched frame-of-reference blocks.

A file table has one row per segment: whole documents in ascending id order, about
``SEGMENT_IDS`` ids.  The payload of a segment holds, behind a header,

    document ids and lengths | per block: minimum, width, outliers, start of its bits, start of its
    outliers | bits | outlier places | outlier values

A block is ``BLOCK`` ids.  Its minimum is subtracted; the width is the bit length at one of a few
percentiles, whichever stores the block smallest; an id that needs more bits keeps its low bits in
place and its high bits in the outlier list.  The starts make any block readable by itself.

Spark writes the rows as Parquet, so a failed task leaves no half file behind.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.llm.common import map_batches
from stratafin.llm.ordering import ordered_parts
from stratafin.llm.wordcut import cut, encoder, spread
from stratafin.session import stage

BLOCK = 128
SEGMENT_IDS = 1 << 20
END_ID = 2
#: Text that is encoded at once, in bytes (a longer document is encoded by itself).
SLICE_BYTES = 8 << 20
#: Ranks, within a block, of the percentiles that may set the width.
_RANKS = [round(p * (BLOCK - 1)) for p in (0.75, 0.85, 0.9, 0.95, 0.98, 1.0)]
_HEAD = struct.Struct("<4sIIIBxxx")
_MAGIC = b"PFR1"


def _lay(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks in columns (BLOCK, k) to their bits: 32-bit words (k, BLOCK * width / 32)."""
    out = np.zeros((BLOCK * width // 32 + 1, values.shape[1]), np.uint32)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 32)
        out[word] |= values[j] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= values[j] >> np.uint32(32 - shift)
    return out[:-1].T


def _lift(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_lay``."""
    words = np.concatenate((words.T, np.zeros((1, len(words)), np.uint32)))
    out, mask = np.empty((BLOCK, words.shape[1]), np.uint32), np.uint32((1 << width) - 1)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 32)
        got = words[word] >> np.uint32(shift)
        if shift + width > 32:
            got = got | (words[word + 1] << np.uint32(32 - shift))
        out[j] = got & mask
    return out


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents (64-bit ids, lengths) and their token ids, one after the other."""
    n, count = len(ids), -(-len(ids) // BLOCK)
    grid = np.full(count * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(count, BLOCK)
    low = grid.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    need = np.searchsorted(1 << np.arange(32, dtype=np.int64), rest.astype(np.int64), side="right").astype(np.uint8)
    sorted_need = np.sort(need, axis=1)
    wide = 4 if n and int(rest.max(initial=0)) >> 16 else 2
    widths = sorted_need[:, _RANKS].astype(np.int64)
    outliers = np.stack([(need > widths[:, [i]]).sum(axis=1) for i in range(len(_RANKS))], axis=1) if count else np.zeros((0, len(_RANKS)), np.int64)
    best = (widths * BLOCK // 8 + outliers * (1 + wide)).argmin(axis=1) if count else np.zeros(0, np.int64)
    width = widths[np.arange(count), best]
    odd = need > width[:, None]
    sizes = width * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        laid = _lay(np.ascontiguousarray((rest[rows] & np.uint32((1 << w) - 1)).T), w)
        bits[(starts[rows][:, None] + np.arange(w * BLOCK // 8)).ravel()] = np.ascontiguousarray(laid).view(np.uint8).ravel()
    at_block, at = np.nonzero(odd)
    high = rest[at_block, at] >> width[at_block].astype(np.uint32)
    n_odd = odd.sum(axis=1)
    return b"".join(
        [
            _HEAD.pack(_MAGIC, len(doc_ids), n, len(high), wide),
            doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
            low.astype("<u4").tobytes(), width.astype("u1").tobytes(), n_odd.astype("u1").tobytes(),
            starts.astype("<u4").tobytes(), (np.cumsum(n_odd) - n_odd).astype("<u4").tobytes(),
            bits.tobytes(), at.astype("u1").tobytes(), high.astype(f"<u{wide}").tobytes(),
        ]
    )


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment's document ids, lengths and token ids."""
    magic, docs, n, n_odd, wide = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    count, at = -(-n // BLOCK), _HEAD.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, k, at)
        at += got.nbytes
        return got

    doc_ids, lengths = take("<i8", docs), take("<u4", docs)
    low, width, odd, starts, odd_starts = take("<u4", count), take("u1", count), take("u1", count), take("<u4", count), take("<u4", count)
    bits = take("u1", int(width.astype(np.int64).sum()) * (BLOCK // 8))
    places, high = take("u1", n_odd), take(f"<u{wide}", n_odd)
    rest = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        words = bits[(starts[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)).ravel()].view("<u4").reshape(len(rows), -1)
        rest[rows] = _lift(words, w).T
    of = np.repeat(np.arange(count), odd)
    rest[of, places] |= high.astype(np.uint32) << width[of].astype(np.uint32)
    return doc_ids, lengths, (rest + low[:, None]).ravel()[:n]


def encoded(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Token counts and token ids of texts, each followed by the end id if there is one."""
    codes, offsets, words = cut(texts)
    sizes, flat = encoder(path).encode(words)
    each = sizes[codes]
    tokens = flat[spread((np.cumsum(sizes) - sizes)[codes], each)]
    counts = np.add.reduceat(each, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
    if end_id is None:
        return counts, tokens
    out = np.full(len(tokens) + len(counts), end_id, np.uint32)
    out[np.arange(len(tokens)) + np.repeat(np.arange(len(counts)), counts)] = tokens
    return counts + 1, out


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES):
    """A batch in runs of rows whose texts have at most so many bytes together, or single rows."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def write(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode and write every document; returns the file table, read back.

    Null texts are empty and hold the end id only.  Ids are long and unique names are not needed:
    rows of the same id follow each other by text; a null id comes first, as the smallest long.
    """

    def run(batches):
        part, seq, doc_ids, counts, tokens, size = None, 0, [], [], [], 0

        def segment():
            payload = pack(np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(tokens))
            n_docs = sum(map(len, doc_ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "n_docs", "n_ids", "payload"])

        for whole in batches:
            for batch in slices(whole, 3):
                parts = batch.column(0).to_numpy()
                ids = batch.column(2).fill_null(-(2**63)).to_numpy()
                n, ids_out = encoded(batch.column(3), path, end_id)
                ends = np.cumsum(n)
                at = 0
                while at < len(n):
                    if part is not None and (parts[at] != part or size >= segment_ids):
                        yield segment()
                        seq = seq + 1 if parts[at] == part else 0
                        doc_ids, counts, tokens, size = [], [], [], 0
                    part = int(parts[at])
                    stop = int(np.searchsorted(parts, part, side="right"))
                    before = int(ends[at - 1]) if at else 0
                    stop = min(stop, int(np.searchsorted(ends, before + segment_ids - size)) + 1)
                    doc_ids.append(ids[at:stop])
                    counts.append(n[at:stop])
                    tokens.append(ids_out[before : int(ends[stop - 1])])
                    size += int(ends[stop - 1]) - before
                    at = stop
        if part is not None:
            yield segment()

    rows = ordered_parts(docs, id_col, [F.col("text").cast("string").alias("text")])
    return stage(map_batches(rows, run, "part int, seq int, n_docs long, n_ids long, payload binary"))


def read(files: DataFrame) -> DataFrame:
    """(part, seq, pos, doc_id, n_tokens, ids_crc32): one row per document of the files."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, ids = unpack(batch.column(2)[i].as_py())
                raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(lengths.astype(np.int64))
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, batch.column(0)[i].as_py()), pa.int32()), pa.array(np.full(k, batch.column(1)[i].as_py()), pa.int32()), pa.array(np.cumsum(lengths.astype(np.int64)) - lengths, pa.int64()), pa.array(doc_ids, pa.int64(), mask=doc_ids == -(2**63)), pa.array(lengths.astype(np.int64), pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "seq", "pos", "doc_id", "n_tokens", "ids_crc32"],
                )

    return map_batches(files.select("part", "seq", "payload"), run, "part int, seq int, pos long, doc_id long, n_tokens long, ids_crc32 long")


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, start): ids in all segments before; windows over segments and over parts only."""
    segments = files.select("part", "seq", "n_ids")
    total = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per part
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return segments.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))


def index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = read(files).join(starts(files), ["part", "seq"])
    return rows.select("doc_id", (F.col("start") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
