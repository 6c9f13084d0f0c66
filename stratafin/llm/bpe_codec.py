"""BPE encoding and decoding over a table of distinct words.

Texts are split into words that the tokenizer treats independently.  Each distinct word of the
corpus is encoded once, in the bucket of its hash; its ids return to the blocks that use it and are
put back by position.  Decoding joins ids with the vocabulary's pieces (a table as large as the
vocabulary file, so it is sent to every task) and joins the pieces' bytes.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafin.llm import blocks as B
from stratafin.llm.common import return_arrays, ship
from stratafin.llm.wordcut import cut, encoder, spread

#: Words that are put back at once.
SLICE_WORDS = 200_000


def _coder(texts: pa.Array):
    codes, offsets, words = cut(texts)
    return codes, offsets, [w.encode("utf-8", "surrogatepass") for w in words]


def pieces(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    table = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def _ask(buckets: int, row: dict):
    words = B.unpack_words(row["words"])
    bounds = B.bucket_bounds(words, buckets)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, B.pack_words(words[bounds[b] : bounds[b + 1]]), b""


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, ``ids`` and the text ``decoded`` from them.

    Null texts are empty and have no ids.  Repeated rows stay repeated; a null id stays null.
    Bytes that are not whole characters are decoded as the replacement character, as the library
    does; the ids of a whole text never give any.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = B.bucket_count(docs)
    stored = B.blocks(docs, _coder, buckets)
    vocabulary = spark.sparkContext.broadcast(pieces(path))
    questions = B.asked(stored, partial(_ask, buckets), ["words"])

    def distinct_words(table: pa.Table) -> pa.Table:
        return_arrays()
        asked = [B.unpack_words(k.as_py()) for k in table.column("keys")]
        number: dict[bytes, int] = {}
        places = [np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)) for words in asked]
        n, ids = encoder(path).encode([w.decode("utf-8", "surrogatepass") for w in number])
        starts = np.cumsum(n) - n
        sizes = [B.pack_ints(n[at]) for at in places]
        values = [B.pack_ints(ids[spread(starts[at], n[at])]) for at in places]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(sizes, pa.binary()), pa.array(values, pa.binary())], ["block", "bucket", "sizes", "ids"])

    answers = questions.groupBy("bucket").applyInArrow(distinct_words, "block long, bucket int, sizes binary, ids binary")

    def put_back(documents: pa.Table, found: pa.Table) -> pa.Table:
        return_arrays()
        found = found.sort_by("bucket")
        none = [np.zeros(0, np.int64)]
        sizes = np.concatenate(none + [B.unpack_ints(x.as_py()) for x in found.column("sizes")])
        ids = np.concatenate(none + [B.unpack_ints(x.as_py()) for x in found.column("ids")])
        piece, starts = vocabulary.value, np.cumsum(sizes) - sizes
        texts = [b"".join([piece[i] for i in ids[a : a + n].tolist()]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        row = documents.slice(0, 1).to_pylist()[0]
        codes, offsets = B.unpack_ints(row["codes"]), np.concatenate(([0], np.cumsum(B.unpack_ints(row["sizes"]))))
        doc_ids, parts, at = B.document_ids(row["ids"]), [], 0
        while at < len(doc_ids):  # a few documents, or a long one, at a time
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_WORDS, side="right")) - 1)
            own = codes[offsets[at] : offsets[stop]]
            ends = np.concatenate(([0], np.cumsum(sizes[own])))[offsets[at : stop + 1] - offsets[at]]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[spread(starts[own], sizes[own])].astype(np.int32)))
            decoded = [b"".join([texts[c] for c in codes[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(offsets[at:stop].tolist(), offsets[at + 1 : stop + 1].tolist(), strict=True)]
            parts.append(pa.table([doc_ids[at:stop], lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]))
            at = stop
        return pa.concat_tables(parts)

    documents = stored.select("block", "ids", "sizes", "codes")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_back, "doc_id long, ids array<int>, decoded string")
