"""SimHash links, components and groups beside brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stratafin.llm import simhash_dedup as S
from stratafin.llm import simhash_groups as G
from stratafin.llm.common import LOWER_BYTES, documents, mixed, vote_counts
from stratafin.llm.graph import components

from .conftest import SF


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, width):
    words = (text or "").encode().translate(LOWER_BYTES).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_vote_counts():
    hashes = np.random.default_rng(0).integers(0, 2**64, 700, dtype=np.uint64)
    want = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert vote_counts(hashes).tolist() == want
    assert (vote_counts(mixed(hashes, np.arange(3)))[1] == vote_counts(mixed(hashes, 1))).all()
    assert vote_counts(hashes[:0]).tolist() == [0] * 64


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7), (1, None)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert found == roots({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [1, 8, 1000])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:4]:  # crowded neighbourhoods and chains
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    fps |= {f ^ 1 ^ (1 << 63) for f in list(fps)[:20]}
    near = [(a, b) for a, b in combinations(sorted(map(S.signed, fps)), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    table = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    links = [tuple(r) for r in S.links(table, 2, limit).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    nodes = [S.signed(f) for f in fps]
    want, got = roots(nodes, near), roots(nodes, links)
    assert want == got


def test_near_duplicates_of_the_table(spark):
    rows = [tuple(r) for r in documents(spark, SF).select("doc_id", "text").collect()]
    fps = {d: plain_fingerprint(t, 3) for d, t in rows}
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = roots(fps, near)
    from stratafin.llm.queries import QUERIES

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash_dedup"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in fps.items()}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["component_id"], r["fp"]) for r in S.near_duplicates(odd).collect()), key=str)
    by_id = {i: c for i, c, _ in got}
    assert len(got) == odd.count()
    assert by_id[2] == by_id[3] == by_id[4] == 2 and {f for i, _, f in got if i in (2, 3, 4)} == {0}
    assert [c for i, c, _ in got if i in (6, 7)] == [6, 6, 6]
    assert by_id[None] is None
    assert S.near_duplicates(empty).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text, width=5):
    words = (text or "").encode().translate(LOWER_BYTES).split()
    return {b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def test_groups_against_exact_similarity(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(40, 400))
        rows.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(max(1, len(base) * rng.choice([1, 1, 6]) // 150)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    texts = {i: " ".join(r) for i, r in enumerate(rows)} | {1000: " ".join(rows[0]).upper(), 1001: None, 1002: ""}
    sets = {i: shingles(t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["least"]["doc_id"] for r in G.groups(docs).collect()}
    sure = roots(texts, [(a, b) for a, b in combinations(texts, 2) if jaccard(sets[a], sets[b]) >= 0.83])
    most = roots(texts, [(a, b) for a, b in combinations(texts, 2) if jaccard(sets[a], sets[b]) >= 0.62])
    assert all(found[a] == found[b] for a, b in combinations(texts, 2) if sure[a] == sure[b])
    assert all(most[a] == most[b] for a, b in combinations(texts, 2) if found[a] == found[b])
    kept = {r["doc_id"] for r in G.one_of_each(docs).collect()}
    assert kept == set(found.values())


@pytest.mark.parametrize("chunk", [G.CHUNK, 8])
def test_block_edits_against_exact_similarity(spark, monkeypatch, chunk):
    """Replaced tails, other headers and appended sections on either side of 0.8: a pair is grouped
    exactly if its similarity is 0.8 or more."""
    monkeypatch.setattr(G, "CHUNK", chunk)
    rng = random.Random(8)
    frequent = [f"w{i}" for i in range(4000)]
    # Words of a text follow a few topics, so that a foreign block brings other words.
    topic = lambda n: rng.choices(rng.sample(frequent, 300), k=n)
    texts, pairs = {}, []
    for i in range(300):
        n = rng.choice([40, 80, 200, 400, 900])
        base, j = topic(n), rng.uniform(0.74, 0.92)
        cut = round(n * (1 - j) / (1 + j))
        other = [base[:-cut] + topic(cut), topic(cut) + base[cut:], base + topic(round(n / j) - n)][i % 3]
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(other)
        pairs.append((2 * i, 2 * i + 1))
    crowd = topic(300)
    for i in range(24):  # every pair of these is a little under or over the limit
        texts[1000 + i] = " ".join(crowd[: 270 - i % 3] + [f"x{i}y{k}" for k in range(30)])
    sets = {i: shingles(t) for i, t in texts.items()}
    assert min(sum(lo <= jaccard(sets[a], sets[b]) < hi for a, b in pairs) for lo, hi in [(0.75, 0.8), (0.8, 0.82), (0.82, 0.85), (0.85, 0.9)]) >= 10
    want = roots(texts, [(a, b) for a, b in combinations(texts, 2) if jaccard(sets[a], sets[b]) >= 0.8])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["least"]["doc_id"] for r in G.groups(docs).collect()} == want


def test_crowded_buckets_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 8)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["least"]["doc_id"] for r in G.groups(docs).collect()} == {0}


def test_forest_is_linear():
    rng = np.random.default_rng(2)
    near = rng.random((60, 60)) < 0.03
    near |= near.T
    member, root = G._forest(near)
    want = roots(range(60), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert {int(m): int(r) for m, r in zip(member, root, strict=True)} == {m: r for m, r in want.items() if m != r}


def test_one_of_each_keeps_odd_rows_whole(odd, empty):
    kept = G.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 1, 2, 5, 6, 20, 40, 60], key=str)
    assert G.one_of_each(empty).count() == 0


def test_every_lead_is_used():
    use = defaultdict(int)
    for lead in G.leads():
        assert len(set(lead)) == G.LEAD
        for i in lead:
            use[i] += 1
    assert len(use) == 8 * G.WORD_LANES and max(use.values()) - min(use.values()) <= 2
