"""Benchmark decontamination with suffix arrays over shards of the training words.

A task cuts its documents into shards of whole documents, sorts the suffixes of each shard (prefix
doubling on word numbers) and binary-searches every test suffix in it.  A word that no test item
has ends every match, so only suffixes with enough known words before such a word are sorted.
Matches start with a window of ``WINDOW`` item words (a shorter item is one window) and are
extended to the longest verbatim match; all occurrences come from the suffix range.

Words meet as 64-bit hashes: a text's bytes are dropped as soon as its words are numbered (10^9
distinct training words against 10^6 test words share one with a chance of 5 in 100 000, and a match
needs the whole window).  Tasks cut the test items into packed blocks of at most ``BLOCK_WORDS`` words;
the driver hands the packed blocks on one at a time, so a larger benchmark means more passes over a
shard, not more memory.  An item longer than a block is cut into pieces that overlap by a window less
one word, and its longest match is measured within a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafin.llm.common import map_batches
from stratafin.session import stage

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 200_000
#: Bytes of a text that are cut into words at once.
TEXT_BYTES = 1 << 20
#: Letters and digits in lower case; every other ASCII byte parts words, bytes of other letters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_hashes(text: bytes | None) -> np.ndarray:
    """The words of a text, in order, as 64-bit hashes."""
    found, at = [np.zeros(0, np.uint64)], 0
    text = (text or b"").translate(WORD_BYTES)
    while at < len(text):
        end = text.find(b" ", at + TEXT_BYTES)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found)


@dataclass
class Block:
    """Test items as word numbers, each followed by 0, and the places where windows start.

    A word's number is its place, from 1, among the sorted hashes of the block's words.
    """

    words: np.ndarray
    tokens: np.ndarray
    items: list[str]
    item_of: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def block(items: list[str], hashes: np.ndarray, sizes: np.ndarray, window: int) -> Block:
    words, numbers = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(sizes)
    tokens = np.insert(numbers + 1, ends, 0)
    lengths = np.minimum(sizes, window)
    windows = sizes - lengths + 1
    item_of = np.repeat(np.arange(len(items)), windows)
    first = ends - sizes + np.arange(len(items))
    starts = np.arange(windows.sum()) + np.repeat(first - np.cumsum(windows) + windows, windows)
    return Block(words, tokens, items, item_of, starts, lengths[item_of])


def pieces(hashes: np.ndarray, window: int, block_words: int) -> list[np.ndarray]:
    """An item's words, or overlapping parts of them that fit a block."""
    step = max(block_words - window + 1, 1)
    return [hashes[at : at + step + window - 1] for at in range(0, max(len(hashes) - window + 1, 1), step)]


def packed(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(items, words, sizes): blocks of test items with words, cut by the tasks that read them."""

    def run(batches):
        items, parts, size = [], [], 0

        def row():
            sizes = np.array([len(w) for w in parts], "<i8")
            columns = [pa.array([items], pa.list_(pa.string())), pa.array([np.concatenate(parts).astype("<u8").tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["items", "words", "sizes"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in pieces(word_hashes(text.as_py()), window, block_words):
                    if not len(part):
                        continue
                    if parts and size + len(part) > block_words:
                        yield row()
                        items, parts, size = [], [], 0
                    items.append(item)
                    parts.append(part)
                    size += len(part)
        if parts:
            yield row()

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string").cast("binary"))
    return stage(map_batches(rows, run, "items array<string>, words binary, sizes binary"))


def suffix_array(tokens: np.ndarray, shortest: int) -> np.ndarray:
    """Starts of the suffixes, in order, that have at least ``shortest`` words before the next 0.

    ``tokens`` ends with 0; a suffix ends at its next 0.
    """
    ends = np.flatnonzero(tokens == 0)
    spans = np.diff(np.concatenate(([-1], ends))) - 1
    wanted = spans >= max(shortest, 1)
    if not wanted.any():
        return np.zeros(0, np.int64)
    lengths, finish = spans[wanted], ends[wanted]
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(before, lengths)
    left = np.repeat(lengths, lengths) - place
    where = np.repeat(finish, lengths) - left
    rank = tokens[where]
    step, n = 1, len(where)
    while step < lengths.max():
        follow = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        follow[inside] = rank[inside + step]
        distinct, rank = np.unique(rank * (max(rank.max(), follow.max()) + 1) + follow, return_inverse=True)
        rank += 1
        if len(distinct) == n:
            break
        step *= 2
    order = np.argsort(rank, kind="stable")
    return where[order[left[order] >= shortest]]


def common(test: np.ndarray, q: np.ndarray, text: np.ndarray, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that test suffixes q and text suffixes p share (at most ``limit``), and their order
    after that: -1, 0 or 1."""
    shared, order = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    active, depth = np.flatnonzero(limit > 0), 0
    while active.size:
        a, b = test[q[active] + depth], text[p[active] + depth]
        order[active] = np.sign(a - b)
        active = active[(a == b) & (a != 0)]
        depth += 1
        shared[active] = depth
        active = active[limit[active] > depth]
    return shared, order


def bound(found: Block, text: np.ndarray, array: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all windows at once: the first suffix not below (``upper``: above) each."""
    low, high = np.zeros(len(found.starts), np.int64), np.full(len(found.starts), len(array), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not open_.size:
            return low
        mid = (low[open_] + high[open_]) // 2
        order = common(found.tokens, found.starts[open_], text, array[mid], found.lengths[open_])[1]
        right = order >= 0 if upper else order > 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def search(found: Block, hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Occurrences of each item's windows in a shard: (item, word places, window lengths, longest
    match lengths); places count over the shard, with one gap after each document."""
    at = np.minimum(np.searchsorted(found.words, hashes), len(found.words) - 1)
    numbers = np.where(found.words[at] == hashes, at + 1, 0)
    text = np.insert(numbers, np.cumsum(sizes), 0)
    array = suffix_array(text, int(found.lengths.min()))
    if not len(array):
        return
    low, high = bound(found, text, array, False), bound(found, text, array, True)
    hits = np.flatnonzero(high > low)
    for item in np.unique(found.item_of[hits]):
        own = hits[found.item_of[hits] == item]
        n = high[own] - low[own]
        q = np.repeat(own, n)
        p = array[np.repeat(low[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        longest = common(found.tokens, found.starts[q], text, p, np.full(len(q), len(found.tokens)))[0]
        yield int(item), p, found.lengths[q], longest


def shard_result(hashes: np.ndarray, sizes: np.ndarray, found: Iterator[Block]) -> dict[str, list]:
    """What the blocks find in the documents of a shard, given as the hashes of their words."""
    docs = len(sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    change, items = np.zeros(len(hashes) + docs + 1, np.int32), [set() for _ in range(docs)]
    best: list[tuple] = [(0, "", 0)] * docs
    for b in found:
        for item, places, lengths, matched in search(b, hashes, sizes):
            np.add.at(change, places, 1)
            np.add.at(change, places + lengths, -1)
            of = np.searchsorted(starts, places, side="right") - 1
            order = np.lexsort((places, -matched, of))
            of, first = np.unique(of[order], return_index=True)
            name = b.items[item]
            for doc, k in zip(of.tolist(), order[first].tolist(), strict=True):
                items[doc].add(name)
                best[doc] = max(best[doc], (int(matched[k]), name, int(starts[doc] - places[k])))
    covered = np.cumsum(change[:-1]) > 0
    hit = np.add.reduceat(covered.astype(np.int64), starts) if docs else np.zeros(0, np.int64)
    return {
        "n_words": sizes,
        "n_hit": hit,
        "items": [sorted(x) for x in items],
        "longest_match": [n for n, _, _ in best],
        "longest_item": [name if n else None for n, name, _ in best],
        "longest_at": [-at if n else None for n, _, at in best],
    }


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """One row per input row (new names begin with ``prefix``): the kept columns, ``n_words``, ``n_hit``, ``items`` (ids of items with
    an occurring window, sorted), and the longest verbatim match: its words, its item and the place of
    its first word, from 0 (of equally long ones the last item id, then the first place).

    Null and empty texts have no words and no hits.  Items without words never match; a null item
    id is reported as an empty string, and rows that repeat an item id count once.
    """
    shared = [docs.sparkSession.sparkContext.broadcast((r["items"], bytes(r["words"]), bytes(r["sizes"]))) for r in packed(benchmark, window, block_words).toLocalIterator()]
    own = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else None

    def answer(held: list[pa.RecordBatch], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        def one_by_one():
            for s in shared:
                items, words, sizes = s.value
                yield block(items, np.frombuffer(words, "<u8"), np.frombuffer(sizes, "<i8"), window)
                if len(shared) > 1:
                    s.__dict__.pop("_value", None)  # keep one block in memory

        sizes = np.array([len(h) for h in hashes], np.int64)
        found = shard_result(np.concatenate(hashes), sizes, one_by_one())
        at = 0
        for batch in held:
            part = {k: v[at : at + batch.num_rows] for k, v in found.items()}
            at += batch.num_rows
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(v, k) for v, k in zip(part.values(), kinds, strict=True)]], [*keep, *[prefix + k for k in part]])

    def run(batches):
        held, hashes, size = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = part.column(len(keep)) if own is None else part.column(own).cast(pa.binary())
                held.append(part.select(range(len(keep))))
                for t in texts:
                    hashes.append(word_hashes(t.as_py()))
                    size += len(hashes[-1])
                if size >= shard_words:
                    yield from answer(held, hashes)
                    held, hashes, size = [], [], 0
        if held:
            yield from answer(held, hashes)

    schema = T.StructType(
        [T.StructField(c, docs.schema[c].dataType) for c in keep]
        + [T.StructField(prefix + n, T.LongType()) for n in ("n_words", "n_hit")]
        + [T.StructField(prefix + "items", T.ArrayType(T.StringType())), T.StructField(prefix + "longest_match", T.LongType())]
        + [T.StructField(prefix + "longest_item", T.StringType()), T.StructField(prefix + "longest_at", T.LongType())]
    )
    text = [] if own is not None else [F.col("text").cast("string").cast("binary").alias("__bytes")]
    return map_batches(docs.select(*keep, *text), run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of ``docs`` without the documents that hold a window of a test item."""
    return contamination(docs, benchmark, tuple(docs.columns), window, prefix="__").where("__n_hit = 0").select(*docs.columns)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL for the rows of the query ``op10_decontaminate``.
ORACLE = rf"""
with d as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
b as (select row_number() over () b, coalesce(cast(item_id as varchar), '') item, {_WORDS} w from benchmark),
bw as (select b, item, q, k, array_to_string(list_slice(w, q, q + k - 1), ' ') key from
  (select b, item, w, least({WINDOW}, len(w)) k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) q from b where len(w) > 0)),
dp as (select rid, w, unnest(range(1, len(w) + 1)) i from d),
dw as (select rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') key from dp, (select distinct k from bw) where i + k - 1 <= len(w)),
occ as (select rid, i, k, item, b, q from dw join bw using (k, key)),
hit as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + k)) p from occ) group by rid),
its as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from occ) group by rid),
isl as (select *, i - row_number() over (partition by rid, b, i - q order by i) g from occ),
runs as (select rid, item, min(i) - 1 as first_at, count(*) + max(k) - 1 as len_ from isl group by rid, item, b, i - q, g),
far as (select rid, item, first_at, len_ from runs qualify row_number() over (partition by rid order by len_ desc, item desc, first_at) = 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(len_, 0)::bigint longest_match, item longest_item, first_at::bigint longest_at
from d left join hit using (rid) left join its using (rid) left join far using (rid)
"""
