"""Whitening, URL filter and spelling groups beside SQL, brute force and odd input."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import check, duck
from stratafin.llm import spelling_groups, url_filter, whitening
from stratafin.llm.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op12_url_filter", "op13_spelling_groups"])
def test_against_sql(spark, con, name):
    assert check(spark, con, name, QUERIES[name], ORACLES[name], SF)["status"] == "ok"


# whitening


def brute_whitening(rows, components=4):
    """{id: [(deviation, whitened by component, up to sign)]} and shares, by dense algebra."""
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    fit = np.unique(np.array(x), axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = (np.array(x) - mean) @ vectors / np.sqrt(values)
    total = [sum(column) for column in zip(*fit.tolist(), strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    return n, deviation, white, values / np.trace((fit - mean).T @ (fit - mean) / n)


def test_whitening_against_dense_algebra(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in docs.collect()]
    n, deviation, white, shares = brute_whitening(rows)
    got = defaultdict(dict)
    for r in QUERIES["op11_embedding_whitening"](spark, SF).collect():
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
        assert abs(r["explained"] - shares[r["component"] - 1]) < 1e-12
        got[r["vec_id"]][r["component"]] = (r["deviation"], r["whitened"])
    for i, (vec_id, _) in enumerate(rows):
        assert {d for d, _ in got[vec_id].values()} == {deviation[i]}
    for c in range(4):
        mine = np.array([got[v][c + 1][1] for v, _ in rows])
        sign = np.sign(mine @ white[:, c])
        assert abs(mine - sign * white[:, c]).max() < 1e-8


def test_polynomial_by_remainders(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-90, 90, (40, 7))
    x[:, 5] = x[:, 4]  # a root of zero
    m = (40 * x.T @ x - np.outer(x.sum(0), x.sum(0))).tolist()
    poly = whitening.characteristic(spark, m)
    a, expected, work = [[Fraction(v) for v in row] for row in m], [1], [[Fraction(0)] * 7 for _ in range(7)]
    times = lambda x, y: [[sum(x[i][t] * y[t][j] for t in range(7)) for j in range(7)] for i in range(7)]
    for k in range(1, 8):  # Faddeev and LeVerrier, in fractions
        work = [[v + (expected[-1] if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(times(a, work))]
        expected.append(-sum(times(a, work)[i][i] for i in range(7)) / k)
    assert poly == [int(v) for v in reversed(expected)] and poly[0] == 0
    roots = whitening.largest_roots(poly, 7, sum(m[i][i] for i in range(7)))
    assert roots[-1] == 0
    assert np.allclose(np.array([r / 2**whitening.EXTRA for r in roots]), np.linalg.eigvalsh(np.array(m, float))[::-1], rtol=1e-9, atol=1e-3)


def test_equal_roots_give_an_orthonormal_basis():
    m = [[5, 0, 0], [0, 5, 0], [0, 0, 2]]
    poly = [-50, 45, -12, 1]
    roots = whitening.largest_roots(poly, 3, 12)
    one = 1 << whitening.EXTRA
    assert roots == [5 * one, 5 * one, 2 * one]
    v = np.array(whitening.null_space(m, roots[0], whitening.EXTRA, 2))
    assert np.allclose(v @ v.T, np.eye(2)) and np.allclose(v[:, 2], 0)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], "a"), (1, [0.5, 1.0], "a"), (2, [-0.25, 3.0], "a"), (None, [1.0, 0.0], "b"), (3, None, "b"), (4, [1.0, None], "b"), (5, [nan, 1.0], "b"), (6, [1.0, -inf], "b"), (7, [], "b"), (8, [1.0], "b")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").withColumn("component", F.col("x")).withColumn("n", F.col("x"))
    got = whitening.whiten(docs).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == {(1, 1): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1, (None, 1): 1, (None, 2): 1}
    assert {r["n"] for r in got} == {3} and got[0]["identity_error"] < 1e-9
    same = whitening.whiten(docs.where("vec_id = 1")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(docs.where("false")).collect() == [] and whitening.whiten(docs.where("vec_id = 7")).columns == whitening.whiten(docs).columns


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(a) * 1e12, float(b)]) for i, (a, b) in enumerate([(1, 2), (-3, 5), (7, -1), (2, 2)])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((4 * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    assert all(r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 2**63 else None) for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got)


# URL filter

URLS = [
    ("HTTP://A.Example.NET/en/1.html?Page=2&ref=#x", "a.example.net", "/en/1.html", "example.net/en/", "allow"),
    ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("https://net/", "net", "/", "net/", "block"),
    ("https://net?x", "net", "", None, "allow"),
    ("https://internet/x", "internet", "/x", None, "allow"),
    ("x://example.com/de/?a://b", "example.com", "/de/", "example.com/de/", "block"),
    ("x://fr.org/fr/y", "fr.org", "/fr/y", "org/fr/", "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("https://Ä.example/" + "p/" * 20000 + "é", "Ä.example", "/" + "p/" * 20000 + "é", None, "allow"),
    ("a\nb://c\n.net/d\ne", "c\n.net", "/d\ne", "net/", "block"),
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "t") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], None)], "page_id long, url string, tokens string")
    none = url_filter.mine(spark.createDataFrame([], "tokens array<string>, label string"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, none).collect() if True)
    assert got == sorted([(i, *u[1:]) for i, u in enumerate(URLS)] + [(0, *URLS[0][1:])], key=lambda r: r[0])
    assert url_filter.judge(pages.where("false"), none).collect() == []


def test_tokens(spark):
    pages = spark.createDataFrame([(u,) for u, *_ in URLS[:1]], "url string")
    assert pages.select(url_filter.tokens_of()).first()[0] == ["h:a", "h:example", "h:net", "p:en", "p:html", "q:page", "q:ref", "s:http"]


def brute_rules(rows, least, confidence):
    """All rules of token sets with labels: {(tokens, verdict): (confidence, n)}."""
    counts = Counter()
    for tokens, label in rows:
        tokens = sorted(set(tokens))
        for m in range(1, 1 << len(tokens)):
            own = tuple(t for i, t in enumerate(tokens) if m >> i & 1)
            counts[own, None] += 1
            counts[own, label] += 1
    return {k: (n / counts[k[0], None], n) for k, n in counts.items() if k[1] and n >= least and n / counts[k[0], None] >= confidence}


def test_mined_rules_and_their_matches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        tokens = [t for t in "abcdef" if rng.random() < 0.5]
        if tokens:
            bad = ("a" in tokens and "b" in tokens and rng.random() < 0.95) or rng.random() < 0.1
            rows.append((tokens, "block" if bad else "allow"))
    rules = brute_rules(rows, 20, 0.5)
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), support=0.01, least=20)
    own = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["n"]) for r in mined.collect()}
    assert all(rules[k] == v for k, v in own.items())
    beaten = {k for k, (c, _) in rules.items() if any(len(k[0]) > 1 and rules.get((k[0][:i] + k[0][i + 1 :], k[1]), (0,))[0] >= c for i in range(len(k[0])))}
    assert set(own) == set(rules) - beaten and (("a", "b"), "block") in own
    sets = sorted({tuple(sorted(t)) for t, _ in rows})
    found = {tuple(r["tokens"]): (r["best"]["verdict"], tuple(r["best"]["ante"])) for r in url_filter.decided(spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>"), mined).collect()}
    for s in sets:
        fits = [(-c, len(t), -n, v != "block", t, v) for (t, v), (c, n) in rules.items() if set(t) <= set(s)]
        assert found.get(s) == ((min(fits)[5], min(fits)[4]) if fits else None)


def test_tokens_that_always_come_together_are_one(spark):
    long = [f"t{i:02}" for i in range(40)]
    rows = [([*long, "x"], "block")] * 50 + [([*long, "y"], "allow")] * 50 + [(["y"], "allow")] * 50
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), least=20)
    assert {(tuple(r["tokens"]), r["verdict"]) for r in mined.collect()} == {(("x",), "block"), (("y",), "allow"), (("t00",), "block"), (("t00",), "allow")}


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7.html"), (2, "http://a.b/en/8"), (3, "http://a.b/9/"), (4, "http://a.b/x"), (5, None), (6, "http://a.b/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, 1, None), (9, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r["label"], r["tokens"]) for r in url_filter.labelled(pages, labels).collect())
    assert [g[0] for g in got] == ["allow", "block"]


# spelling groups


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form, out = {}, {}
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, found in around.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 10 * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(around[w]), counts[form[w]] if w in form else None)
    return out


def as_found(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("part_words", [20_000, 8])
def test_variants_of_crowded_words(spark, part_words):
    rng = np.random.default_rng(5)
    made = {"".join(rng.choice(list("abé"), rng.integers(7, 10))) for _ in range(250)} | {"a" * k for k in range(7, 14)} | {"ÿ" * 9, "z" * 300, "z" * 299 + "y"}
    counts = {w: int(10 ** rng.uniform(0.4, 6)) for w in made}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_found(spelling_groups.variants(table, part_words=part_words)) == brute_variants(counts)


def test_chains_are_followed_to_the_root(spark):
    counts = {"abcdefg" + "x" * k: 10 ** (k + 1) for k in range(9)}
    got = as_found(spelling_groups.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_variants(counts) and got["abcdefg"][1] == "abcdefg" + "x" * 8


def test_words_of_texts(spark, odd, empty):
    texts = [(1, "Spelling SPELLING spelling's Größe-Größenordnung größenordnung ÄÄÄÄÄÄÄÄ ÄÄÄÄÄÄÄÄ × ÷×÷×÷×÷ ÷×÷×÷×÷"), (2, None), (3, ""), (None, "without without without"), (4, "q" * 100_000 + " " + "q" * 100_000)]
    texts += [(i, "definition definition occurrence") for i in range(10, 90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit("n"))
    got = {r["word"]: r["n"] for r in spelling_groups.words(docs).collect()}
    assert got == brute_words(texts) and len(got) > 4
    assert as_found(spelling_groups.spelling_groups(docs)) == brute_variants({w: n for w, n in got.items()})
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {r["word"]: r["n"] for r in spelling_groups.words(odd).collect()} == brute_words(rows)
    assert spelling_groups.spelling_groups(empty).collect() == []


def test_parts_agree_on_nodes():
    words = sorted({"abcabca", "abcabcb", "abcabcbb", "abd", "abdd", "b", "ba", "bab"})
    parts = [words[:2], words[2:3], words[3:7], words[7:]]
    last = [p[-1] for p in parts]
    known = spelling_groups.boundary_nodes(last)
    node = {}
    for i, own in enumerate(parts):
        for word, nodes in zip(own, spelling_groups.part_nodes(i, own, last, known), strict=True):
            assert len(nodes) == len(word) + 1
            for k, v in enumerate(nodes.tolist()):
                assert node.setdefault(word[:k], v) == v
    assert len(set(node.values())) == len(node)
