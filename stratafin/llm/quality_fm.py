"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The last term holds every pairwise interaction at rank ``RANK`` and costs time linear in the
non-zero features.  Labels are learnt by logistic loss from a sample of at most ``sample_rows``
labelled documents, those with the smallest hash of their id, whose features (never texts) reach
the driver.  The model has a fixed size and is broadcast; scoring is one narrow pass over the texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import LOWER_BYTES, fold, map_batches, release_memory

WORD_BUCKETS = 1 << 14
RANK = 8
BINS = 10
#: Largest number of labelled rows that the model learns from.
SAMPLE_ROWS = 8000
THRESHOLD = 0.3
EPOCHS = 12
#: Small samples are passed over more often, up to this many steps altogether.
LEAST_STEPS = 600
BATCH = 128
RATE = 0.01
DECAY = 1e-5
SEED = 7

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARK = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b".,;:'\"-()?"))
_STOP = b".,;:'\"-()?!"
_HIGH = bytes(range(128, 256))
STATS = (
    "words", "word_length", "distinct", "top_share", "repeated_pairs", "upper", "digits", "spaces", "marks", "stops",
    "high_bytes", "lines", "line_length", "repeated_lines", "number_of_marks",
)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the distinct words and their root frequencies, of length one altogether."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = Counter(words)
    buckets = np.fromiter(map(zlib.crc32, counts), dtype=np.int64, count=len(counts)) % WORD_BUCKETS
    values = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / len(words))
    return buckets.astype(np.int32), values.astype(np.float32)


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    n, k = max(len(raw), 1), max(len(words), 1)
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    lines = [x for x in raw.split(b"\n") if x]
    top = Counter(words).most_common(1)
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / k, len(set(words)) / k, top[0][1] / k if top else 0.0,
        sum(map(eq, words, words[1:])) / k, share(_UPPER), share(_DIGIT), share(_SPACE), share(_MARK), share(_STOP),
        share(_HIGH), float(np.log1p(len(lines))), float(np.log1p(n / max(len(lines), 1))), 1 - len(set(lines)) / max(len(lines), 1),
        float(len(set(raw) & set(_MARK))),
    ]


def features(text: str | None, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, word values, and the dense columns: structure, then metadata (NaN if missing)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(LOWER_BYTES).split()
    dense = structure(raw, words) + [float("nan") if m is None else float(m) for m in meta]
    return *word_features(words), dense


@dataclass
class Model:
    """Weights: word buckets first, then ``BINS + 1`` bins (the last: missing) of each dense column."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def design(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, values and row starts of rows of ``features``."""
        dense = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), len(self.edges))
        width = BINS + 1
        bins = np.empty(dense.shape, dtype=np.int64)
        for j, edge in enumerate(self.edges):
            bins[:, j] = np.where(np.isnan(dense[:, j]), BINS, np.searchsorted(edge, dense[:, j], side="right"))
        bins += WORD_BUCKETS + width * np.arange(len(self.edges))
        ids, values = [], []
        for r, b in zip(rows, bins, strict=True):
            ids += [r[0], b]
            values += [r[1], np.full(len(b), 0.5, np.float32)]
        sizes = np.array([len(r[0]) for r in rows]) + len(self.edges)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        return np.concatenate(ids).astype(np.int64), np.concatenate(values), starts

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output and, for the gradient, the sums over v x of each row."""
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.linear[ids] * values, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, rows: list[tuple]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.design(rows))[0].astype(np.float64), -60, 60))) if rows else np.zeros(0)


def fit(rows: list[tuple], target: np.ndarray, n_dense: int) -> Model:
    """Adam over mini-batches; without rows of both classes the score is their constant share."""
    rng = np.random.default_rng(SEED)
    size = WORD_BUCKETS + (BINS + 1) * n_dense
    share = float(np.clip((target.sum() + 1) / (len(target) + 2), 1e-3, 1 - 1e-3))
    dense = np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), n_dense)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    filled = [c[~np.isnan(c)] for c in dense.T]
    edges = np.array([np.quantile(c, cuts) if len(c) else np.zeros(BINS - 1) for c in filled])
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    if len(set(target.tolist())) < 2:
        return model
    model.factors = rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
    weights = np.concatenate((np.zeros((size, 1), np.float32), model.factors), axis=1)
    first, second, b_first, b_second, step = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(rows) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * 0.1 ** (epoch / epochs)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids, values, starts = model.design([rows[i] for i in chosen])
            out, sums = model.raw(ids, values, starts)
            slope = (1 / (1 + np.exp(-np.clip(out, -60, 60))) - target[chosen]).astype(np.float32) / len(chosen)
            of = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(ids))))
            pull = slope[of] * values
            grad = np.empty_like(weights)
            grad[:, 0] = np.bincount(ids, weights=pull, minlength=size)
            own = pull[:, None] * (sums[of] - model.factors[ids] * values[:, None])
            for f in range(RANK):
                grad[:, f + 1] = np.bincount(ids, weights=own[:, f], minlength=size)
            grad += DECAY * weights
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            b_first, b_second = 0.9 * b_first + 0.1 * slope.sum(), 0.999 * b_second + 0.001 * slope.sum() ** 2
            model.bias -= float(rate * (b_first / (1 - 0.9**step)) / (np.sqrt(b_second / (1 - 0.999**step)) + 1e-8))
            model.linear, model.factors = np.ascontiguousarray(weights[:, 0]), np.ascontiguousarray(weights[:, 1:])
    return model


def views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of its one array of numbers; the driver makes no object of a number."""
    lists = column.combine_chunks()
    values, ends = lists.values.to_numpy(zero_copy_only=True), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, meta: tuple[str, ...] = ("n_chars",), holdout: tuple[int, int] = (5, 0)) -> Model:
    """Learn from labelled rows outside the held-out fold; rows without a label or an id are not used."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", holdout[0]) != holdout[1])).select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    columns = ["doc_id", F.col("text").cast("string").alias("text"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(meta)]]
    sample = docs.select(*columns).join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows

    def run(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            rows = [features(t, [c[f"m{i}"][k] for i in range(len(meta))]) for k, t in enumerate(c["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(c["quality"], pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                ["doc_id", "quality", "ids", "vals", "dense"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(sample.withColumn("quality", F.col("quality").cast("int")), run, f"doc_id {kind}, quality int, ids array<int>, vals array<float>, dense array<double>")
    table = found.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    rows = list(zip(*(views(table.column(n)) for n in ("ids", "vals", "dense")), strict=True))
    model = fit(rows, np.array(table.column("quality").to_pylist(), np.float32), len(STATS) + len(meta))
    del rows, table
    release_memory()
    return model


def score(docs: DataFrame, model: Model, meta: tuple[str, ...] = ("n_chars",), keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """One row per input row: the kept columns and the score, named ``out``.  Null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*keep, F.col("text").cast("string").alias("__text"), *[F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(meta)]]

    def run(batches):
        for batch in batches:
            n, parts = len(keep), []
            texts = batch.column(n)
            extra = [batch.column(n + 1 + i).to_pylist() for i in range(len(meta))]
            for at in range(0, batch.num_rows, 256):
                rows = [features(t.as_py(), [e[at + k] for e in extra]) for k, t in enumerate(texts.slice(at, 256))]
                parts.append(shared.value.scores(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*keep, out])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*columns), run, f"{schema}, `{out}` double")


def predicted(threshold: float = THRESHOLD, score: str = "score"):
    return (F.col(score) >= threshold).cast("int")
