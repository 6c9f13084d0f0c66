"""Language identification in two levels: the family first, then the language within it.

Both levels decide by one-versus-one linear support vector machines over hashed letter pairs and
triples (root frequencies, so every text has length one).  They learn from a sample of at most
``sample_rows`` documents, dealt evenly to the languages, whose counts (never texts) reach the
driver; the machines have a fixed size and score the texts in one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.llm.common import fold, map_batches

BUCKETS = 1 << 12
#: Largest number of documents that the machines learn from.
SAMPLE_ROWS = 4000
UNKNOWN = "und"
#: Letters that are hashed at once, a bound on memory for very long texts.
CHUNK = 1 << 20

#: Families of language codes.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "celtic": ["ga", "gd", "cy", "br"],
    "baltic": ["lt", "lv"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of letter pairs and triples with word edges; None without any letter."""
    if not text:
        return None
    counts, any_letter, table = np.zeros(BUCKETS, np.int64), False, letters()
    lowered = text.lower()
    for at in range(0, len(lowered), CHUNK):
        codes = np.frombuffer(lowered[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(table[codes], codes, 0)
        any_letter |= bool(codes.any())
        codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        pairs = codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)
        triples = pairs[:-1] * np.uint64(3) + codes[2:] * np.uint64(0xC2B2AE3D)
        for h in (pairs, triples):
            counts += np.bincount(((h ^ (h >> np.uint64(15))) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return counts if any_letter else None


def unit(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def machine(x: np.ndarray, sign: np.ndarray, decay: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and offset (last) of a linear machine: squared hinge loss, classes of equal weight,
    by accelerated gradient steps (rows have length one, so a step of a quarter is stable)."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(1, rounds + 1):
        slack = np.maximum(0, 1 - sign * (x @ look))
        grad = decay * look - 2 * ((share * sign * slack) @ x)
        after = look - 0.25 * grad
        look, w = after + (k - 1) / (k + 2) * (after - w), after
    return w.astype(np.float32)


@dataclass
class Level:
    """One-versus-one machines between classes; the class with the largest mean likelihood wins."""

    classes: list[str]
    weights: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = np.clip(x @ self.weights[:-1] + self.weights[-1], -15, 15).astype(np.float64)
        likely, total = 1 / (1 + np.exp(-3 * margin)), np.zeros((n, k))
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            total[:, a] += likely[:, j]
            total[:, b] += 1 - likely[:, j]
        total /= k - 1
        best = total.argmax(axis=1)
        return best, total[np.arange(n), best]


def level(x: np.ndarray, names: np.ndarray) -> Level:
    classes = sorted(set(names.tolist()))
    pairs = []
    for a, b in combinations(classes, 2):
        rows = (names == a) | (names == b)
        pairs.append(machine(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32)))
    return Level(classes, np.array(pairs, np.float32).T if pairs else np.zeros((x.shape[1] + 1, 0), np.float32))


@dataclass
class Model:
    family: Level | None
    within: dict[str, Level]

    def predict(self, counts: list[np.ndarray | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(counts), np.zeros(len(counts))
        rows = [i for i, c in enumerate(counts) if c is not None]
        if not rows or self.family is None:
            return names, scores
        x = unit(np.array([counts[i] for i in rows]))
        family, p = self.family.decide(x)
        for f, name in enumerate(self.family.classes):
            if (chosen := np.flatnonzero(family == f)).size:
                best, q = self.within[name].decide(x[chosen])
                for at, b, s in zip(chosen, best, p[chosen] * q, strict=True):
                    names[rows[at]], scores[rows[at]] = self.within[name].classes[b], s
        return names, scores


def fit(counts: np.ndarray, langs: list[str]) -> Model:
    if not langs:
        return Model(None, {})
    x, lang = unit(counts), np.array(langs, dtype=object)
    family = np.array([_FAMILY_OF.get(c, c) for c in langs], dtype=object)
    return Model(level(x, family), {f: level(x[family == f], lang[family == f]) for f in set(family.tolist())})


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, holdout: tuple[int, int] = (4, 2)) -> Model:
    """Learn from rows with a language outside the held-out fold.

    Rows are taken in turn from every language, in the order of a hash of the id, up to
    ``sample_rows``; texts without letters teach nothing.
    """
    ids = docs.where(F.col("lang").isNotNull() & (fold("doc_id", holdout[0]) != holdout[1])).select("doc_id", "lang")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("turn", turn).where(F.col("turn") <= sample_rows).orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = chosen.select("doc_id", F.col("lang").alias("learnt")).dropDuplicates(["doc_id"])
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows

    def run(batches):
        for batch in batches:
            rows = [(d, lang, c) for d, lang, t in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "learnt", "text")), strict=True) if (c := gram_counts(t)) is not None]
            ids = [np.flatnonzero(r[2]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field("doc_id").type), pa.array([r[1] for r in rows], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2][i] for r, i in zip(rows, ids, strict=True)], pa.list_(pa.int32()))],
                ["doc_id", "learnt", "ids", "n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = map_batches(sample, run, f"doc_id {kind}, learnt string, ids array<int>, n array<int>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    counts = np.zeros((table.num_rows, BUCKETS), np.float32)
    for i, (where, n) in enumerate(zip(table.column("ids").to_pylist(), table.column("n").to_pylist(), strict=True)):
        counts[i, where] = n
    return fit(counts, table.column("learnt").to_pylist())


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the kept columns, ``lang_pred`` and ``score``.

    A null text or one without letters is ``und`` with score 0, as is everything if nothing was
    learnt; with a single learnt language every other text is that language with score 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, names, scores = len(keep), [], []
            for at in range(0, batch.num_rows, 256):
                part = shared.value.predict([gram_counts(t.as_py()) for t in batch.column(n).slice(at, 256)])
                names += part[0]
                scores.append(part[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("__text")), run, f"{schema}, lang_pred string, score double")
