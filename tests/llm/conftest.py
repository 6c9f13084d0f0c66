import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

ODD = [
    (1, "Of the in, that erst;  and two  spaces\tand a tab\n new line ", "en", "a", 20, "x"),
    (2, None, None, None, None, None),
    (3, "", "fr", "b", 0, "x"),
    (4, " \t\n ", "de", "b", 4, "x"),
    (5, "word " * 30_000 + "end", "en", "a", 150_003, "x"),
    (6, "Same text here, once more and again.", "en", "a", 36, "x"),
    (6, "Same text here, once more and again.", "en", "a", 36, "x"),
    (7, "Same text here, once more and again.", "es", "c", 36, "y"),
    (None, "A row without an id, don't lose it: naïve café \U0001f600 it's <|endoftext|> x\x00y", "fr", "c", 60, "y"),
    (20, "short", "en", None, 5, "y"),
    (40, "ÄÖÜ straße ÄÖÜ nbsp em\x85nel\x1cfs 123 4567", "de", "a", 40, "y"),
    (60, "\U0001f600" * 50, "", "a", 50, "y"),
]
#: Names that the operators use inside.
CLASHES = ["fp", "k", "score", "spans", "words", "n_hit", "part"]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string"
    docs = spark.createDataFrame(ODD, schema)
    for name in CLASHES[1:]:
        docs = docs.withColumn(name, docs["fp"])
    return docs


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, None) for i in range(1, 61)] + [(None, 1, 0, None), (5, None, None, None), (6, 1, 0, "z")], "doc_id long, quality int, toxic int, score string")


@pytest.fixture(scope="session")
def benchmark(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("b1", words), ("b2", "short item"), ("b3", None), ("b4", ""), (None, "word word word"), ("b1", words), ("b5", "Same text here once more and again")]
    return spark.createDataFrame(rows, "item_id string, text string")
