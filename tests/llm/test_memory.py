"""Memory that a worker keeps between tasks."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from stratafin.llm import graph, quality_fm

SCRIPT = """
import numpy as np
{setup}
def resident():
    return int(open('/proc/self/statm').read().split()[1]) * 4096 / 2**20
np.ones(28 << 17)  # one array of 28 MB comes and goes, and the allocator learns its size
before, kept = resident(), []
arrays = []
for _ in range(10):
    arrays.append(np.ones(2 << 20))
    kept.append(np.ones(1 << 10))  # a small one behind each of 16 MB
del arrays
print(resident() - before)
"""


def left_over(setup: str) -> float:
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(setup=setup)], capture_output=True, text=True, check=True)
    return float(done.stdout)


def test_large_arrays_return_to_the_system_when_freed():
    assert left_over("from stratafin.llm.common import return_arrays; return_arrays()") < 20


def test_the_drivers_sample_is_held_as_arrays(spark, monkeypatch):
    """The features of the sample reach the fit as numbers in arrays: no Python object for each of 400 000."""
    rows = [(i, " ".join(f"w{i * 1000 + k}" for k in range(1000)), 7000) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = {}

    def fit(rows, target, n_dense):
        seen.update(peak=tracemalloc.get_traced_memory()[1], numbers=sum(len(r[0]) + len(r[1]) for r in rows))
        return rows[0], target.dtype, n_dense

    monkeypatch.setattr(quality_fm, "fit", fit)
    tracemalloc.start()
    try:
        quality_fm.train(docs, labels)
    finally:
        tracemalloc.stop()
    assert seen["numbers"] > 250_000
    assert seen["peak"] < 8 * seen["numbers"]


def test_views_are_the_rows_of_a_list_column():
    parts = [pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), pa.array([[9], [4, 5, 6]], pa.list_(pa.int32())).slice(1)]
    for column, rows in ((pa.chunked_array(parts), [[1, 2], [], [3], [4, 5, 6]]), (pa.chunked_array([], pa.list_(pa.int32())), [])):
        found = quality_fm.views(column)
        assert [v.tolist() for v in found] == rows
        assert all(v.dtype == np.int32 for v in found)


def test_stars_take_no_round_and_paths_no_confirming_round(spark, monkeypatch):
    stored, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: stored.append(1) or stage(df))

    def roots(edges):
        stored.clear()
        return {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}

    assert roots([(2, 1), (1, 3), (5, 4), (5, 5), (2, 1), (None, 1)]) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert len(stored) == 1
    assert roots([(1, 2), (2, 3)]) == {1: 1, 2: 1, 3: 1}
    assert len(stored) == 2
    assert roots([(i, i + 1) for i in range(40)] + [(100, 90), (100, 95)]) == dict.fromkeys(range(41), 0) | dict.fromkeys((90, 95, 100), 90)
