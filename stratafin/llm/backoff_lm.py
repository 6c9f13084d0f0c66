"""Language-model scores by a weighted backoff automaton.

Every n-gram of the training texts that is shorter than the order (3 by default) is a state; the
empty one is the root.  With c(w) of N training tokens, V distinct, and a prior weight m for each
length of state,

    root arc       P(w) = (c(w) + 1/2) / (N + (V + 1) / 2)       an unseen word takes the last share
    arc h -> w     P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m)      if h w was seen
    failure arc    m / (c(h) + m)                                to h', the state h without its first word

so the weights of the words that can be reached from any state, by its arcs or over its failure
arcs, sum to one.  An arc leads to the longest suffix of h w that is a state.  A text is traversed
once from the start state: each token takes the failure arcs of the current state up to one that has
an arc for it, then that arc, adds their log-probabilities and moves on; the end of the text is a
token too.

Counts come from the whole training part.  Blocks of documents ask for the counts of their distinct
words and n-grams (``blocks``), and each block builds the part of the automaton that its own texts
can reach; no model is collected or broadcast.  The steps of that part (a state and the token read
there) are few beside the tokens, so the failure arcs of a step are followed once in a block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.llm import blocks as B
from stratafin.llm.common import LOWER_BYTES, mixed, return_arrays, ship
from stratafin.session import stage

#: Prior weights of states of one word, of two words, and so on; their number gives the order.
PRIORS = (300.0, 10.0)
#: Text of a block: its n-grams and their arcs are in one task's memory.
BLOCK_BYTES = 8 << 20
#: The start state and the end token; no word holds white space.
START, END = b" <s>", b" </s>"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes, offsets and words: each text's words, A-Z lower-cased, between a start and an end."""
    words = [t.as_py().encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    flat = []
    for w in words:
        flat.append(START)
        flat += w
        flat.append(END)
    encoded = pa.array(flat, pa.binary()).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), encoded.dictionary.to_pylist()


def _positions(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, offsets of the documents, and whether each position belongs to a training text."""
    codes, sizes = B.unpack_ints(row["codes"]), B.unpack_ints(row["sizes"])
    return codes, np.concatenate(([0], np.cumsum(sizes))), np.repeat(np.frombuffer(row["marks"], np.uint8).astype(bool), sizes)


@dataclass
class Grams:
    """Distinct n-grams of one length in a block, and which of them ends at each position.

    ``context`` is the n-gram's number without its last word and ``suffix`` without its first,
    both among the n-grams one shorter; ``word`` is the code of its last word.  A context
    that reaches over the start of a text has the number after the last.
    """

    which: np.ndarray
    context: np.ndarray
    word: np.ndarray
    suffix: np.ndarray


def longer(shorter: np.ndarray, size: int, codes: np.ndarray, words: int, starts: np.ndarray) -> Grams:
    """The n-grams one longer than those that ``shorter`` numbers (below ``size``) at each position."""
    before = np.empty(len(codes), np.int64)
    before[1:] = shorter[:-1]
    before[starts] = size
    found = pa.array(before * words + codes).dictionary_encode()
    which, keys = found.indices.to_numpy(), found.dictionary.to_numpy()
    suffix = np.empty(len(keys), np.int32)
    suffix[which] = shorter
    return Grams(which, (keys // words).astype(np.int32), (keys % words).astype(np.int32), suffix)


def _levels(order: int, codes: np.ndarray, offsets: np.ndarray, words: int) -> list[Grams]:
    """The n-grams of two words and more."""
    levels, shorter, size = [], codes, words
    for _ in range(order - 1):
        levels.append(longer(shorter, size, codes, words, offsets[:-1]))
        shorter, size = levels[-1].which, len(levels[-1].word)
    return levels


def _keys(words: list[bytes], levels: list[Grams]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the n-grams of all lengths, ascending, and where each n-gram's key went.

    A key is mixed from the hashes of the words; that two of the n-grams asked in a bucket share one is
    as good as impossible and would only add their counts.
    """
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    shorter, keys = hashes, []
    with np.errstate(over="ignore"):
        last = mixed(hashes, 1)
        for grams in levels:
            shorter = mixed(np.append(shorter, np.uint64(0)), 0)[grams.context] + last[grams.word]
            keys.append(shorter)
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    return keys[order], order


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, which need fewer bytes."""
    return B.pack_longs(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(B.unpack_longs(data).view(np.uint64), dtype=np.uint64)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ascending keys of each bucket start: a bucket is a range of the highest 32 bits."""
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))


def _ask_words(buckets: int, row: dict):
    words = B.unpack_words(row["words"])
    codes, _, trained = _positions(row)
    counts = np.bincount(codes[trained], minlength=len(words))
    bounds = B.bucket_bounds(words, buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[b], bounds[b + 1]
        yield b, B.pack_words(words[lo:hi]), B.pack_longs(counts[lo:hi])


def _ask_grams(buckets: int, order: int, row: dict):
    words = B.unpack_words(row["words"])
    codes, offsets, trained = _positions(row)
    levels = _levels(order, codes, offsets, len(words))
    counts, whole = [], trained
    for grams in levels:  # an n-gram that reaches over the start of its text is never counted, so no state
        whole = whole & np.append(False, whole[:-1])
        whole[offsets[:-1]] = False
        counts.append(np.bincount(grams.which[whole], minlength=len(grams.word)))
    counts = np.concatenate(counts)
    keys, place = _keys(words, levels)
    counts = counts[place]
    bounds = _bounds(keys, buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[b], bounds[b + 1]
        yield b, _pack_keys(keys[lo:hi]), B.pack_longs(counts[lo:hi])


def _count_words(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's words for each block that asks, and a row of the bucket's totals."""
    return_arrays()
    asked = [B.unpack_words(k.as_py()) for k in table.column("keys")]
    own = [B.unpack_longs(x.as_py()) for x in table.column("extra")]
    total: dict[bytes, int] = {}
    for words, counts in zip(asked, own, strict=True):
        for w, n in zip(words, counts.tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    real = [n for w, n in total.items() if n and w != START]
    bucket = table.column("bucket")[0].as_py()
    answers = [B.pack_longs(np.array([total[w] for w in words])) for words in asked]
    return pa.table(
        [
            pa.array([*table.column("block").to_pylist(), None], pa.int64()),
            pa.array([bucket] * (len(asked) + 1), pa.int32()),
            pa.array([*answers, b""], pa.binary()),
            pa.array([0] * len(asked) + [sum(real)], pa.int64()),
            pa.array([0] * len(asked) + [len(real)], pa.int64()),
        ],
        ["block", "bucket", "counts", "n", "v"],
    )


def _count_grams(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's n-grams for each block that asks."""
    return_arrays()
    asked = [_unpack_keys(k.as_py()) for k in table.column("keys")]
    own = [B.unpack_longs(x.as_py()) for x in table.column("extra")]
    keys, counts = np.concatenate(asked), np.concatenate(own)
    order = np.argsort(keys)
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(first, append=len(keys)))
    answers = [B.pack_longs(part) for part in np.split(total, np.cumsum([len(a) for a in asked])[:-1])]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(answers, pa.binary())], ["block", "bucket", "counts"])


def step_weights(root: np.ndarray, seen: list[np.ndarray], levels: list[Grams], priors: tuple[float, ...]) -> np.ndarray:
    """Log10 weight of each distinct step: the failure arcs from its state, then the arc taken.

    ``root`` holds the probabilities of the root arcs; ``seen`` the training counts of words and of
    the n-grams of each level.  A step of the longest level starts in the state of its context; where
    that is no state (never seen), in the longest suffix that is one.
    """
    weight = np.log10(root)
    for grams, states, arcs, prior in zip(levels, seen[:-1], seen[1:], priors, strict=True):
        uses = np.append(states, 0)[grams.context]
        lower = weight[grams.suffix]
        failure = np.log10(prior / (uses + prior))  # nothing where the state does not exist
        arc = np.log10((arcs + prior * 10.0**lower) / (uses + prior))
        weight = np.where(arcs > 0, arc, failure + lower)
    return weight


def score(docs: DataFrame, trained: Column, priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score (single words
    only) and score, both log10 probabilities of the whole text.

    ``trained`` marks the documents to learn from (null: not); ``priors`` holds one weight or more, of
    states of one word first.  Null and empty texts are one end token.  With nothing to learn from,
    every token is unseen and takes the whole share.  Equal rows keep their own rows.
    """
    if not priors or min(priors) <= 0:
        raise ValueError("priors must be one or more positive weights")
    ship(docs.sparkSession)
    order = len(priors) + 1
    buckets = B.bucket_count(docs)
    stored = B.blocks(docs, tokens, buckets, trained, BLOCK_BYTES)
    columns = ["sizes", "codes", "words", "marks"]
    counted = B.asked(stored, partial(_ask_words, buckets), columns).groupBy("bucket").applyInArrow(_count_words, "block long, bucket int, counts binary, n long, v long")
    counted = stage(counted)
    totals = counted.where("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(totals[0]), int(totals[1])
    grams = B.asked(stored, partial(_ask_grams, buckets, order), columns).groupBy("bucket").applyInArrow(_count_grams, "block long, bucket int, counts binary")
    answers = counted.where("block is not null").select("block", "bucket", F.lit(0).alias("kind"), "counts").unionByName(grams.withColumn("kind", F.lit(1)))

    def traverse(documents: pa.Table, found: pa.Table) -> pa.Table:
        return_arrays()
        row = documents.slice(0, 1).to_pylist()[0]
        found = found.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = found.column("kind").to_numpy()
        counts = [B.unpack_longs(x.as_py()) for x in found.column("counts")]
        uses = np.concatenate([c for c, k in zip(counts, kinds, strict=True) if k == 0])
        codes, offsets, _ = _positions(row)
        words = B.unpack_words(row["words"])
        levels = _levels(order, codes, offsets, len(words))
        _, place = _keys(words, levels)
        del words
        arcs = np.empty(len(place), np.int64)
        arcs[place] = np.concatenate([c for c, k in zip(counts, kinds, strict=True) if k == 1])
        del place, counts, found
        seen = [uses, *np.split(arcs, np.cumsum([len(g.word) for g in levels])[:-1])]
        root = (uses + 0.5) / (n + 0.5 * (v + 1))
        read = np.ones(len(codes), bool)
        read[offsets[:-1]] = False  # the start is a state, not a token
        base, known = np.where(read, np.log10(root)[codes], 0), (uses[codes] > 0) & read
        del codes
        steps = np.where(read, step_weights(root, seen, levels, priors)[levels[-1].which], 0)
        over = lambda x: np.add.reduceat(x, offsets[:-1])
        size = len(offsets) - 1
        return pa.table(
            [B.document_ids(row["ids"]), pa.array(np.diff(offsets) - 1, pa.int64()), pa.array(over(known.astype(np.int64)), pa.int64()), pa.array(np.full(size, n), pa.int64()), pa.array(over(base), pa.float64()), pa.array(over(steps), pa.float64())],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    documents = stored.select("block", "ids", *columns)
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(traverse, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
