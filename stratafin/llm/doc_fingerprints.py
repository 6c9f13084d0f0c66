"""Document fingerprints: weighted term hashes vote on signed bits.

A term is a word (A-Z lower-cased); its weight is log(1 + frequency) times its length, up to
``LONGEST``, since long words tell documents apart.  Each term's hash adds its weight to the bits
it sets and takes it from those it clears; a fingerprint bit is the sign of its sum.  256 bits keep
the likeness of two texts (the share of equal bits) within a few hundredths.

Fingerprints within a radius are found with block tables, one led by each of ``BLOCKS`` blocks.  Two
fingerprints that differ in fewer than twice as many bits as there are blocks differ in one bit at
most of some block, so a query asks each table for its own block and for that with each bit turned:
no pair within the radius is lost.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import LOWER_BYTES, map_batches, mixed
from stratafin.llm.ordering import ordered_parts
from stratafin.session import stage

LANES = 4
BITS = 64 * LANES
LONGEST = 12
SEED = 42
#: Blocks of 16 bits, 4 hexadecimal digits each.
BLOCKS = 16
WIDTH = BITS // BLOCKS
RADIUS = 2 * BLOCKS - 1
#: Fingerprints and queries of a bucket that meet in one task at a time.
CHUNK, QUERY_CHUNK = 2048, 512


def fingerprint(text: str | None) -> np.ndarray:
    """The fingerprint of a text, as bytes; texts without words have all bits zero."""
    counts = Counter((text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split())
    total, weight_sum = np.zeros(BITS), 0.0
    terms = list(counts.items())
    for at in range(0, len(terms), 8192):
        part = terms[at : at + 8192]
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w, _ in part]), ">u8").astype("<u8")
        weights = np.log1p([n for _, n in part]) * np.minimum([len(w) for w, _ in part], LONGEST)
        lanes = np.stack([mixed(hashes, lane) for lane in range(LANES)], axis=1)
        total += weights.astype(np.float32) @ np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
        weight_sum += float(weights.astype(np.float32).sum())
    return np.packbits(2 * total > weight_sum)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - float(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row, in id order: n_chars, the edited text's SHA-256, both fingerprints and
    the likeness to the edited text and to the next document.

    Null texts are empty.  Rows that repeat an id follow each other by text; null ids come first; the
    last row's next is the first, so a single row is its own next.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answer(doc, following):
        doc_id, text, own = doc
        new = edited(text, following[1])
        other = fingerprint(new)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following[2])

    def run(batches):
        part, held, done = None, None, False  # done: the row that follows the part has come
        for batch in batches:
            rows = []
            for p, extra, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                p, extra = p.as_py(), extra.as_py()
                if p != part:
                    part, held, done = p, None, False
                if extra and done:
                    continue
                doc = (doc_id.as_py(), text.as_py(), fingerprint(text.as_py()))
                if held is not None:
                    rows.append(answer(held, doc))
                held, done = doc, bool(extra)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = ordered_parts(docs, id_col, [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")], neighbours=True)
    return map_batches(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _tables(name: str, masks: list[int]):
    """(t, k) for each table: the block that leads it, under each of the masks."""
    digits = WIDTH // 4
    blocks = [F.conv(F.substring(name, t * digits + 1, digits), 16, 10).cast("int") for t in range(BLOCKS)]
    each = F.array(*[F.struct(F.lit(t).alias("t"), k.alias("k")) for t, k in enumerate(blocks)])
    turned = F.transform(each, lambda e: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(e["t"].alias("t"), e["k"].bitwiseXOR(m).alias("k"))))
    return F.explode(F.flatten(turned)).alias("e")


def _tile(batches):
    """Documents of a chunk within the radius of each query of a chunk; a pair that meets in several
    tables counts in the first."""

    def words(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), "<u8").reshape(-1, LANES)

    for batch in batches:
        names, counts = [], []
        for t, queries, fps, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            asked, held, n = words(queries), words(fps), np.array(n, np.int64)
            apart = sum(np.bitwise_count(asked[:, None, lane] ^ held[None, :, lane]).astype(np.uint16) for lane in range(LANES))
            q, d = np.nonzero(apart <= RADIUS)
            if not len(q):
                continue
            blocks = np.bitwise_count((asked[q] ^ held[d]).view("<u2"))
            first = (blocks <= 1).argmax(axis=1) == t
            near = np.zeros(len(asked), np.int64)
            np.add.at(near, q[first], n[d[first]])
            found = np.flatnonzero(near)
            names += [queries[i] for i in found.tolist()]
            counts += near[found].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([x.hex() for x in names], pa.string()), pa.array(counts, pa.int64())], ["fingerprint", "near"])


def within_radius(fps: DataFrame, queries: DataFrame) -> DataFrame:
    """(fingerprint, near): for each query fingerprint, how many rows of ``fps`` lie within the
    radius.  Copies travel as one fingerprint with a count.

    A bucket is dealt out in chunks, so a crowded one becomes many small tiles whose counts are
    added; no pair becomes a row and no bucket meets in one task.
    """
    classes = fps.groupBy("fingerprint").agg(F.count("*").alias("n"))
    packed = F.unhex("fingerprint").alias("fingerprint")
    probes = _tables("fingerprint", [0, *(1 << i for i in range(WIDTH))])
    asked = queries.select("fingerprint").distinct().select(packed, probes).select("fingerprint", "e.t", "e.k")
    rows = classes.select(packed, "n", _tables("fingerprint", [0])).select("fingerprint", "n", "e.t", "e.k")

    def dealt(table: DataFrame, most: int) -> DataFrame:
        sizes = table.groupBy("t", "k").agg(F.ceil(F.count("*") / most).alias("chunks"))
        return table.join(sizes, ["t", "k"]).withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")))

    rows = rows.join(asked.select("t", "k").distinct(), ["t", "k"], "left_semi")
    stored = dealt(rows, CHUNK).groupBy("t", "k", "chunk").agg(F.collect_list("fingerprint").alias("fps"), F.collect_list("n").alias("n")).drop("chunk")
    asked = dealt(asked, QUERY_CHUNK).groupBy("t", "k", "chunk").agg(F.collect_list("fingerprint").alias("queries")).drop("chunk")
    tiles = asked.join(stored, ["t", "k"]).select("t", "queries", "fps", "n")
    return map_batches(tiles, _tile, "fingerprint string, near long").groupBy("fingerprint").agg(F.sum("near").alias("near"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``with_edits`` plus ``n_near``: for every document whose id is divisible by 20, the other
    documents within the radius (null for the rest)."""
    rows = stage(with_edits(docs))
    is_query = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = within_radius(rows.select("fingerprint"), rows.where(is_query).select("fingerprint"))
    return rows.join(near, "fingerprint", "left").withColumn("n_near", F.when(is_query, F.col("near") - 1)).drop("near")
