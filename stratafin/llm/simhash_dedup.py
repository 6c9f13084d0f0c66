"""Near duplicates by SimHash: pigeonhole blocks find candidates, the Hamming distance decides.

Fingerprints of copies coincide, so links are sought between *distinct* fingerprints only.  A
fingerprint is cut into ``radius + 2`` blocks; two fingerprints within the radius agree on at
least two of them, so one row per pair of blocks brings them together.

* An ordinary bucket joins with itself and the distance of each pair is verified.
* A crowded bucket is not paired.  Two fingerprints differ in at most ``radius`` bits exactly if
  some word lies within ``radius / 2`` bits of both, so each member names the words around it
  (only bits outside the bucket's key can differ) and members that name the same word are linked
  to the smallest of them.  This is linear in the bucket and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import LOWER_BYTES, map_batches, pack_bits, vote_counts
from stratafin.llm.graph import components
from stratafin.session import stage

BITS = 64
SEED = 42
#: Shingles that are hashed and counted at once, a bound on memory for very long texts.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of a text, in pieces; words are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(last), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), last[at : at + CHUNK], strict=False)
        yield np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in pairs]), dtype=">u8").astype("<u8")


def fingerprint(text: str | None, width: int) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; no words give zero.  Signed."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += vote_counts(hashes)
        n += len(hashes)
    return int(pack_bits(counts * 2 > n)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) per input row; null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string").alias("__text")), run, f"`{id_col}` {kind}, fp long")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def block_masks(radius: int) -> list[int]:
    """The bits of every two of ``radius + 2`` blocks."""
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def links(fps: DataFrame, radius: int = 2, pair_limit: int = 8) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose components are those of *all* pairs within
    the radius.  ``radius`` is even; ``pair_limit`` only chooses between two exact ways."""
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be even and at least 2")
    masks = block_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = stage(rows.join(sizes, ["t", "k"]))

    few = rows.where(F.col("n") <= pair_limit)
    pairs = few.select("t", "k", F.col("fp").alias("a")).join(few.select("t", "k", F.col("fp").alias("b")), ["t", "k"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")

    near = []
    for mask in masks:
        free = [b for b in range(BITS) if not mask >> b & 1]
        flips = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(free, n)]
        near.append(F.array(*[F.lit(signed(x)) for x in flips]))
    flip = F.explode(F.element_at(F.array(*near), F.col("t") + 1)).alias("flip")
    around = rows.where(F.col("n") > pair_limit).select("t", "fp", flip).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).distinct()
    lowest = around.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    crowded = around.join(lowest, "word").where("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(crowded).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, component_id) per input row.

    ``component_id`` is the smallest id that links reach, the row's own included.  Texts without
    words share fingerprint 0 and so one component.  Rows with a null id are kept and take the
    smallest non-null id of their component, null if it has none.  Repeated rows stay repeated.
    """
    rows = stage(fingerprints(docs, width, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("lowest"))
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(name: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(name)), 16, "0"))
