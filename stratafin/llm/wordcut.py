"""Texts as sequences of words that a byte-level tokenizer encodes independently.

The tokenizer's splitting pattern never joins what stands before a single space with what follows
it when neither neighbour of the space is white space, so a text is cut before each such space.
Every word is encoded by the tokenizer itself; the cuts only decide what can be looked up.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the splitting pattern of the byte-level pre-tokenizer.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces of words that a worker remembers between batches.
REMEMBERED = 400_000


def joinable(words: pa.Array, least: int = 0) -> np.ndarray:
    """Whether words (cut at spaces) begin and end at good places to cut: no white space at the end,
    and at most one space, with no other white space after it, at the beginning.  Words that begin
    otherwise count if ``least`` is 0."""
    size = pc.utf8_length(words)
    lead = pc.subtract(size, pc.utf8_length(pc.utf8_ltrim_whitespace(words))).to_numpy(zero_copy_only=False)
    ends = pc.equal(pc.utf8_length(pc.utf8_rtrim_whitespace(words)), size).to_numpy(zero_copy_only=False)
    spaced = pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
    return ends & np.where(spaced, lead == 1, least == 0)


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, offsets, words): text i is words[codes[offsets[i]:offsets[i + 1]]], joined.

    Null is the empty text, which is one empty word.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
    encoded = parts.flatten().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    good = joinable(encoded.dictionary)
    words, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    if not len(sizes):
        return codes, offsets, words
    bad = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False).astype(bool)
    if not good.all():
        bad |= np.logical_or.reduceat(~good[codes], offsets[:-1])
    if bad.any():
        number = {w: i for i, w in enumerate(words)}
        rows = [codes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for i in np.flatnonzero(bad).tolist():
            rows[i] = np.array([number.setdefault(w, len(number)) for w in CUT.split(texts[i].as_py())], np.int64)
        words, codes = list(number), np.concatenate(rows)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return codes, offsets, words


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1 for each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Ids of words, by the tokenizers library; ids of pieces are remembered, within a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex")
        if not self.plain:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of distinct pieces; what was encoded before is remembered."""
        names, known = pieces.to_pylist(), self.known
        fresh = [p for p in names if p not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = names
        raw = [p.encode("utf-8") for p in fresh]
        shown, tokenize, at = b"".join(raw).decode("latin-1").translate(self.letters), self.tokenizer.model.tokenize, 0
        for p, r in zip(fresh, raw, strict=True):
            known[p] = array("I", [t.id for t in tokenize(shown[at : at + len(r)])]).tobytes()
            at += len(r)
        found = [known[p] for p in names]
        return np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4, np.frombuffer(b"".join(found), "<u4")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all words, one after the other.

        Words with good ends are split into pieces in one run over their joined text.
        """
        table = pa.array(words, pa.string())
        plain = joinable(table, 1)
        for text in self.added:
            plain &= ~pc.match_substring(table, text).to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        sizes, parts = np.zeros(len(words), np.int64), []
        if len(at):
            pieces = pa.array(PIECES.findall("".join([words[i] for i in at.tolist()])), pa.string()).dictionary_encode()
            codes, (n, ids) = pieces.indices.to_numpy(zero_copy_only=False), self._pieces(pieces.dictionary)
            ends = np.cumsum(pc.utf8_length(pieces.dictionary).to_numpy(zero_copy_only=False)[codes])
            word_ends = np.cumsum(pc.utf8_length(table.take(pa.array(at))).to_numpy(zero_copy_only=False))
            sizes[at] = np.bincount(np.searchsorted(word_ends, ends), weights=n[codes], minlength=len(at)).astype(np.int64)
            parts.append((at, ids[spread((np.cumsum(n) - n)[codes], n[codes])]))
        if len(rest):
            each = [self.tokenizer.encode(words[i], add_special_tokens=False).ids if words[i] else [] for i in rest.tolist()]
            sizes[rest] = [len(x) for x in each]
            parts.append((rest, np.array([i for x in each for i in x], np.uint32)))
        out, starts = np.empty(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for where, ids in parts:
            out[spread(starts[where], sizes[where])] = ids
        return sizes, out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
