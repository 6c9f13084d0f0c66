"""Groups of texts whose sets of word shingles are similar, for a filtering stage.

* Candidates are texts that agree on a few minima of their *shingle* hashes (MinHash): a minimum
  agrees with the probability of the Jaccard similarity, wherever the texts differ, so a replaced
  tail or another header is found as surely as scattered words.  Of the pairs at 0.8 a share of
  ``(1 - 0.8 ** LEAD) ** TABLES``, three in a million, shares no table.
* A SimHash of ``BITS`` bits of the shingles settles the candidates that are far from the limit, by
  ``SIGMAS`` standard deviations.  All others, and all short texts, are settled by the exact
  Jaccard similarity of their sets, which only they travel with.

Texts of one set are folded first.  A crowded bucket is dealt out in chunks, bounded in
members and in bytes of their sets, that meet in pairs, each pair of chunks in a row of its own, and a pair of chunks yields a spanning forest of its links and
the members that are in doubt, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.llm.common import map_batches, mixed, vote_counts
from stratafin.llm.graph import components
from stratafin.llm.simhash_dedup import shingle_hashes
from stratafin.session import stage

WIDTH = 5
SIMILARITY = 0.8
#: 64-bit lanes of the shingle fingerprint, and of the minima, eight to a lane.
LANES, WORD_LANES = 16, 12
BITS = 64 * LANES
#: Tables, and minima that lead each.
TABLES, LEAD = 24, 4
#: Members of a chunk, and bytes of the sets that its members are expected to hold.
CHUNK, CHUNK_BYTES = 1024, 4 << 20
#: Hashes that vote at once, a bound on memory for very long texts.
CHUNK_HASHES = 1 << 14
SEED = 42
#: Standard deviations from the limit at which a fingerprint decides, and the shingles it takes for
#: its bits to be normal; pairs with a smaller set are always compared exactly.
SIGMAS, SMALL = 5, 128
#: Sets that meet one set at a time.
MEET = 256


def limits(similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits within which a pair is surely similar, and beyond which it surely is not.

    Of pairs of one Jaccard similarity the cosine is smallest for sets of equal size and largest
    where one holds the other.
    """

    def moved(cosine: float, sigmas: float) -> float:
        share = math.acos(min(cosine, 1.0)) / math.pi
        return BITS * share + sigmas * math.sqrt(BITS * share * (1 - share))

    return math.floor(moved(math.sqrt(similarity), -SIGMAS)), math.ceil(moved(2 * similarity / (1 + similarity), SIGMAS))


def leads() -> list[list[int]]:
    """The minima that lead each table: every one in about as many tables as any other."""
    rng, out, n = np.random.default_rng(SEED), [], 8 * WORD_LANES
    pool: list[int] = []
    while len(out) < TABLES:
        if len(pool) < LEAD:
            pool = rng.permutation(n).tolist()
        out.append(sorted(pool[:LEAD]))
        pool = pool[LEAD:]
    return out


def wide(hashes: np.ndarray, lanes: int) -> bytes:
    """SimHash of a set of hashes: the majority of each bit over ``lanes`` mixed copies."""
    hashes, counts = np.unique(hashes), np.zeros((lanes, 64), np.int64)
    for at in range(0, len(hashes), CHUNK_HASHES):
        counts += vote_counts(mixed(hashes[at : at + CHUNK_HASHES], np.arange(lanes)))
    return np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").tobytes()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def set_digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.astype("<u8").tobytes(), SEED)


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, 8 * WORD_LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table_keys(own: np.ndarray, factors: np.ndarray, tables: list[list[int]]) -> list[int]:
    """For each table a hash of the minima that lead it; none without shingles."""
    if not len(own):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK_HASHES):
        np.minimum(least, (own[None, at : at + CHUNK_HASHES] * factors[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[lead].tobytes(), t) - (1 << 63) for t, lead in enumerate(tables)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, h, digest, n, fp, keys): a hash of the text; digest, size and fingerprint of its set of
    shingles, and its key in each table."""

    def run(batches):
        factors, tables = _factors(), leads()
        for batch in batches:
            out = [[], [], [], []]
            for t in batch.column(2):
                own = shingle_set(t.as_py(), width)
                for column, value in zip(out, (set_digest(own), len(own), wide(own, LANES), table_keys(own, factors, tables)), strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [id_col, "h", "digest", "n", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(_texts(docs, text_col).select(id_col, "h", "__text"), run, f"`{id_col}` {kind}, h long, digest binary, n int, fp binary, keys array<bigint>")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*[c for c in docs.columns if c not in ("h", "__text")], F.xxhash64(text).alias("h"), text.alias("__text"))


def sets(docs: DataFrame, hashes: DataFrame, text_col: str, width: int) -> DataFrame:
    """(digest, own): the sets of the texts with the hashes (h)."""

    def run(batches):
        for batch in batches:
            owns = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(o) for o in owns], pa.binary()), pa.array([o.astype("<u8").tobytes() for o in owns], pa.binary())], ["digest", "own"])

    texts = _texts(docs.select(text_col), text_col).join(hashes.distinct(), "h", "left_semi").select("__text")
    return map_batches(texts, run, "digest binary, own binary").dropDuplicates(["digest"])


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a square table of links, pairs (member, smallest member) of its connected parts."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == label).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = least


def _apart(fps: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(fps), "<u8").reshape(-1, LANES)
    apart = np.zeros((len(x), len(x)), np.uint16)
    for lane in range(LANES):
        apart += np.bitwise_count(x[:, None, lane] ^ x[None, :, lane])
    return apart


def _judged(fps: list[bytes], n: list[int], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(member, root, label, doubt): a forest of the sure links, the part of each member, and the
    table of pairs of different parts that the fingerprints leave open."""
    apart, n = _apart(fps), np.array(n, np.float64)
    low, high = limits(similarity)
    least, most = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    large = least >= SMALL
    member, root = _forest((apart <= low) & large)
    label = np.arange(len(n))
    label[member] = root
    doubt = (~large | (apart <= high)) & (least >= similarity * most - 1e-6) & (label[:, None] != label[None, :])
    return member, root, label, doubt


def _tiles(similarity: float):
    """Sure links (a, b), and members in doubt (a, null, tile)."""

    def run(batches):
        for batch in batches:
            a, b, tile = [], [], []
            for name, ids, fps, n, ids2, fps2, n2 in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                ids = ids + (ids2 or [])
                member, root, _, doubt = _judged(fps + (fps2 or []), n + (n2 or []), similarity)
                open_ = np.flatnonzero(doubt.any(axis=1))
                a += [ids[i] for i in [*member.tolist(), *open_.tolist()]]
                b += [ids[i] for i in root.tolist()] + [None] * len(open_)
                tile += [None] * len(member) + [name] * len(open_)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, tile)], ["a", "b", "tile"])

    return run


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the other sets has in common with a sorted set; none is empty."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((own[at] == every).astype(np.int64), starts)


def _exact(similarity: float):
    """Links (a, b) of members in doubt whose sets are as similar as asked."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                ids, fps, n, owns = (batch.column(k)[i].as_py() for k in range(4))
                owns = [np.frombuffer(o, "<u8") for o in owns]
                _, _, label, doubt = _judged(fps, n, similarity)
                for x in range(len(ids)):
                    rest = np.flatnonzero(doubt[x, x + 1 :]) + x + 1
                    for at in range(0, len(rest), MEET):
                        some = rest[at : at + MEET]
                        some = some[label[some] != label[x]]
                        if not len(some):
                            continue
                        common = shared(owns[x], [owns[y] for y in some.tolist()])
                        sizes = len(owns[x]) + np.array([len(owns[y]) for y in some.tolist()]) - common
                        for y in some[common / sizes >= similarity].tolist():
                            if label[y] != label[x]:
                                a.append(ids[x])
                                b.append(ids[y])
                                label[label == label[y]] = label[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """Classes (c, digest, h, n, fp, keys) to links (a, b) whose components are those of all
    candidates with sets of this Jaccard similarity."""
    rows = classes.select("c", F.explode("keys").alias("k"))
    weights = classes.select("n", F.explode("keys").alias("k"))
    parts = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.col("n").cast("long")) * 8 / CHUNK_BYTES))
    sizes = weights.groupBy("k").agg(F.count("*").alias("members"), parts.alias("m")).where("members > 1").select("k", "m")
    rows = rows.join(sizes, "k").join(classes.select("c", "fp", "n"), "c")
    chunk = F.pmod(F.xxhash64("c"), F.col("m")).alias("chunk")
    lists = [F.collect_list(F.struct("c", "fp", "n")).alias("all"), F.max("m").alias("m")]
    chunks = rows.select("k", "c", "fp", "n", "m", chunk).groupBy("k", "chunk").agg(*lists)
    chunks = stage(chunks.select("k", "chunk", "m", F.col("all.c").alias("ids"), F.col("all.fp").alias("fps"), F.col("all.n").alias("n")))
    none = [F.lit(None).cast("array<bigint>").alias("ids2"), F.lit(None).cast("array<binary>").alias("fps2"), F.lit(None).cast("array<int>").alias("n2")]
    alone = chunks.select(F.xxhash64("k", "chunk").alias("tile"), "ids", "fps", "n", *none)
    large = chunks.where("m > 1")
    other = large.select("k", F.col("chunk").alias("chunk2"), F.col("ids").alias("ids2"), F.col("fps").alias("fps2"), F.col("n").alias("n2"))
    met = large.join(other, "k").where("chunk < chunk2").select(F.xxhash64("k", "chunk", "chunk2").alias("tile"), "ids", "fps", "n", "ids2", "fps2", "n2")
    judged = stage(map_batches(alone.unionByName(met).where("size(ids) + coalesce(size(ids2), 0) > 1"), _tiles(similarity), "a long, b long, tile long"))
    doubt = judged.where("tile is not null").select("tile", F.col("a").alias("c"))
    open_ = classes.join(doubt.select("c").distinct(), "c", "left_semi").select("c", "digest", "h", "fp", "n")
    full = stage(open_.join(sets(docs, open_.select("h"), text_col, width), "digest").select("c", "fp", "n", "own"))
    tiles = doubt.join(full, "c").groupBy("tile").agg(F.collect_list(F.struct("c", "fp", "n", "own")).alias("all"))
    exact = map_batches(tiles.select("all.c", "all.fp", "all.n", "all.own"), _exact(similarity), "a long, b long")
    return judged.where("tile is null").select("a", "b").unionByName(exact)


def groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, component): one row per distinct id and text; ``component`` is the smallest id of the
    rows that similar texts connect.  Null ids come first and make the component null.

    Texts without words have no shingles and are all alike.
    """
    rows = stage(fingerprints(docs, id_col, text_col, width).distinct())
    same = rows.groupBy("digest").agg(F.min(F.struct(id_col, "h")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    classes = stage(same.withColumn("c", F.monotonically_increasing_id()))
    found = links(classes.select("c", "digest", "first.h", "n", "fp", "keys"), docs, similarity, width, text_col)
    roots = components(found)
    named = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select("digest", "least")
    return rows.join(named, "digest").select(id_col, "h", "least")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` that stay when one document of each group does: the one with
    the smallest id.  Of rows that repeat an id and a text the one stays whose columns, as JSON, come first."""
    kept = groups(docs, similarity, width, id_col, text_col).where((F.col(f"least.{id_col}").eqNullSafe(F.col(id_col))) & (F.col("least.h") == F.col("h")))
    kept = kept.select(F.col(id_col).alias("__id"), F.col("h").alias("__h"))
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = rows.join(kept, (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__own") == F.col("__h")), "left_semi")
    once = F.row_number().over(Window.partitionBy(id_col, "__own").orderBy(F.to_json(F.struct(*docs.columns))))
    return rows.withColumn("__once", once).where("__once = 1").select(*docs.columns)
