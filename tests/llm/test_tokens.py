"""Token files, the codec, language-model scores and fingerprints beside brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from stratafin.llm import backoff_lm, blocks, bpe_codec, common, doc_fingerprints, token_files, wordcut  # noqa: E402
from stratafin.llm.common import LOWER_BYTES  # noqa: E402

from .conftest import ODD, SF  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def by_id(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


PIECES = ["a", "The", " ", "  ", "\n", "\t", " ", "'s", "'", "12", "é", "中文", "\U0001f600", "!?", "\x00", "\x85", "\x1c", "<|endoftext|>", "-", "\r\n", " ", "ſ"]


def test_cut_words_encode_like_whole_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(0, 14))) for _ in range(4000)] + [None]
    codes, offsets, words = wordcut.cut(pa.array(texts, pa.string()))
    sizes, flat = wordcut.encoder(PATH).encode(words)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    for i, t in enumerate(texts):
        own = codes[offsets[i] : offsets[i + 1]]
        assert "".join(words[c] for c in own) == (t or "")
        assert [x for c in own for x in ids[c]] == ids_of(t), repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_segments_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 400, rng.integers(1, 30))
    ids = rng.choice([rng.integers(0, 50, 1)[0], 3, 900, 50_000], lengths.sum()).astype(np.uint32) + rng.integers(0, 40, lengths.sum(), dtype=np.uint32)
    if seed % 2 and len(ids):
        ids[rng.integers(0, len(ids), 5)] = 2**32 - 1  # outliers of full width
    doc_ids = rng.integers(-(2**63), 2**63 - 1, len(lengths))
    a, b, c = token_files.unpack(token_files.pack(doc_ids, lengths, ids))
    assert a.tolist() == doc_ids.tolist() and b.tolist() == lengths.tolist() and c.tolist() == ids.tolist()


def test_outliers_go_to_the_exception_list():
    ids = np.full(128 * 50, 7, np.uint32)
    ids[::128] = 40_000
    assert len(token_files.pack(np.array([1]), np.array([len(ids)]), ids)) < 50 * 20 + 40


def check_files(rows, got):
    rows, start = sorted(rows, key=by_id), 0
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for (_, text), r in zip(rows, got, strict=True):
        ids = [*ids_of(text), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files(spark, odd, empty):
    got = token_files.index(token_files.write(odd, PATH)).collect()
    check_files([r[:2] for r in ODD], sorted(got, key=lambda r: r["start"]))
    assert token_files.index(token_files.write(empty, PATH)).count() == 0
    docs = common.documents(spark, SF)
    files = token_files.write(docs, PATH, segment_ids=5000)  # several segments in a part
    check_files([tuple(r) for r in docs.select("doc_id", "text").collect()], sorted(token_files.index(files).collect(), key=lambda r: r["start"]))


def check_codec(rows, got):
    key = lambda r: str((r[0], r[1]))
    want = sorted(((d, ids_of(t), TOKENIZER.decode(ids_of(t), skip_special_tokens=False)) for d, t in rows), key=key)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == want


def test_codec(spark, odd, empty, monkeypatch):
    check_codec([r[:2] for r in ODD], bpe_codec.encode(odd, PATH).collect())
    assert bpe_codec.encode(empty, PATH).count() == 0
    docs = common.documents(spark, SF)
    check_codec([tuple(r) for r in docs.select("doc_id", "text").collect()], bpe_codec.encode(docs, PATH).collect())


def test_codec_query(spark):
    from stratafin.llm.queries import QUERIES

    text = dict(common.documents(spark, SF).select("doc_id", "text").collect())
    for r in QUERIES["op6_bpe_codec"](spark, SF).collect():
        ids = ids_of(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


class PlainAutomaton:
    """States as tuples of words, arcs and failure arcs in dictionaries, one token at a time."""

    def __init__(self, runs, priors):
        self.priors, self.arcs, self.uses, self.single = priors, {}, Counter(), Counter()
        for run in runs:
            self.single.update(run)
            for k in range(1, len(priors) + 1):
                for i in range(len(run)):
                    if i - k >= -1:
                        state = (b" S", *run)[i - k + 1 : i + 1]
                        self.uses[state] += 1
                        self.arcs.setdefault(state, Counter())[run[i]] += 1
        self.n, self.v = sum(self.single.values()), len(self.single)

    def root(self, word):
        return (self.single[word] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def weight(self, state, word):
        """Probability of an arc or of the failure arcs that lead to one, and of that."""
        if not state:
            return self.root(word)
        prior, uses, lower = self.priors[len(state) - 1], self.uses[state], self.weight(state[1:], word)
        if self.arcs.get(state, {}).get(word):
            return (self.arcs[state][word] + prior * lower) / (uses + prior)
        return prior / (uses + prior) * lower

    def longest(self, state):
        while state and (state not in self.uses or len(state) > len(self.priors)):
            state = state[1:]
        return state

    def score(self, run):
        state, total = self.longest((b" S",)), 0.0
        for word in run:
            total += math.log10(self.weight(state, word))
            state = self.longest((*state, word))
        return total


def runs_of(rows):
    return [[*(t or "").encode().translate(LOWER_BYTES).split(), b" E"] for _, t in rows]


def plain_scores(rows, trained, priors):
    runs = runs_of(rows)
    model = PlainAutomaton([r for r, k in zip(runs, trained, strict=True) if k], priors)
    for run in runs:
        yield len(run), sum(model.single[x] > 0 for x in run), model.n, sum(math.log10(model.root(x)) for x in run), model.score(run)


def check_scores(rows, trained, got, priors=backoff_lm.PRIORS):
    want = sorted(((d, *s) for (d, _), s in zip(rows, plain_scores(rows, trained, priors), strict=True)), key=str)
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    assert len(want) == len(found)
    for a, b in zip(want, found, strict=True):
        assert a[:4] == b[:4]
        assert b[4:] == pytest.approx(a[4:], rel=1e-9)


def test_language_model(spark, odd, empty):
    fold = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 != 1
    rows = [r[:2] for r in ODD]
    check_scores(rows, [fold(d) for d, _ in rows], backoff_lm.score(odd, common.fold("doc_id", 5) != 1).collect())
    check_scores(rows, [False] * len(rows), backoff_lm.score(odd, F.lit(False)).collect())
    for priors in [(2.0,), (5.0, 0.5, 3.0)]:  # orders 2 and 4
        check_scores(rows, [fold(d) for d, _ in rows], backoff_lm.score(odd, common.fold("doc_id", 5) != 1, priors).collect(), priors)
    with pytest.raises(ValueError):
        backoff_lm.score(odd, F.lit(True), ())
    assert backoff_lm.score(empty, F.lit(True)).count() == 0
    docs = common.documents(spark, SF)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    from stratafin.llm.queries import QUERIES

    got = QUERIES["op7_backoff_lm"](spark, SF).collect()
    check_scores(rows, [fold(d) for d, _ in rows], got)
    assert all(r["held_out"] == (not fold(r["doc_id"])) for r in got)


def test_arcs_of_every_state_sum_to_one():
    model = PlainAutomaton([t.encode().split() + [b" E"] for t in ["a b a c", "a a b", "c"]], backoff_lm.PRIORS)
    for state in [(), *model.uses]:
        assert sum(model.weight(state, w) for w in [*model.single, b"?"]) == pytest.approx(1)


def test_blocks_of_the_model_meet(spark, monkeypatch):
    """Several blocks and buckets ask for the same n-grams; counts are those of the whole corpus."""
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 200)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "dd", "é"], k=rng.randrange(40)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_scores(rows, [i % 3 > 0 for i, _ in rows], backoff_lm.score(docs, F.col("doc_id") % 3 > 0).collect())


def test_large_counts_and_keys_are_kept():
    counts = np.array([0, 1, 2**32, 2**62, 5])
    assert blocks.unpack_longs(blocks.pack_longs(counts)).tolist() == counts.tolist()
    assert blocks.unpack_longs(blocks.pack_longs(counts[:0])).tolist() == []
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64, endpoint=False))
    keys = np.concatenate(([np.uint64(0)], keys, [np.uint64(2**64 - 1)]))
    assert backoff_lm._unpack_keys(backoff_lm._pack_keys(keys)).tolist() == keys.tolist()


def check_fingerprints(rows, got):
    rows = sorted(((d, t or "") for d, t in rows), key=by_id)
    own = [doc_fingerprints.fingerprint(t) for _, t in rows]
    want = []
    for i, (d, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        new = doc_fingerprints.edited(t, rows[j][1])
        near = sum(int(np.bitwise_count(own[i] ^ f).sum()) <= doc_fingerprints.RADIUS for f in own) - 1 if d is not None and d % 20 == 0 else None
        other = doc_fingerprints.fingerprint(new)
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), own[i].tobytes().hex(), other.tobytes().hex(), doc_fingerprints.likeness(own[i], other), doc_fingerprints.likeness(own[i], own[j]), near))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)


def test_fingerprints(spark, odd, empty, monkeypatch):
    check_fingerprints([r[:2] for r in ODD], doc_fingerprints.fingerprinted(odd).collect())
    assert doc_fingerprints.fingerprinted(empty).count() == 0
    one = odd.where("doc_id = 20")
    assert one.count() == 1
    check_fingerprints([(20, "short")], doc_fingerprints.fingerprinted(one).collect())
    monkeypatch.setattr(doc_fingerprints, "CHUNK", 3)
    monkeypatch.setattr(doc_fingerprints, "QUERY_CHUNK", 2)
    docs = common.documents(spark, SF)
    check_fingerprints([tuple(r) for r in docs.select("doc_id", "text").collect()], doc_fingerprints.fingerprinted(docs).collect())


def test_near_copies_are_counted(spark):
    """Copies with 2 % of their words replaced count as near; other texts do not."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 10)))
    rows, copies = [], []
    for i in range(30):
        base = [word() for _ in range(600)]
        copy = list(base)
        for j in rng.choice(600, 12, replace=False):
            copy[j] = word()
        rows += [(20 * i, " ".join(base)), (20 * i + 1, " ".join(copy))]
        copies.append(int(np.bitwise_count(doc_fingerprints.fingerprint(rows[-1][1]) ^ doc_fingerprints.fingerprint(rows[-2][1])).sum()))
    assert sum(c > 7 for c in copies) > 20 and max(copies) <= 31
    got = doc_fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).where("n_near is not null").collect()
    assert [r["n_near"] for r in got] == [1] * 30


def test_edit_keeps_code_points():
    assert doc_fingerprints.edited("ab\U0001f600cd", "é1234") == "ab\U0001f600é1"
    assert doc_fingerprints.edited("abcd", "x") == "abx"
    assert doc_fingerprints.edited("", "x") == ""
