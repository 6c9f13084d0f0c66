"""Spelling variants of the words of a corpus by a dictionary of pairs of trie nodes.

Words within one inserted, deleted or replaced code point share a split: with P the nodes of the trie
of the words and S those of the trie of the reversed words, a word w of length L has

    skipped pairs    (P of w[:i], S of w[i+1:])   i = 0 .. L-1
    inserted pairs   (P of w[:i], S of w[i:])     i = 0 .. L

Two words that share a skipped pair differ by a replacement there; a skipped pair of a longer word
that is an inserted pair of a shorter one is the letter to insert.  Of a run of equal letters only the
first counts as inserted, so each pair of near words meets in exactly one place and neighbours are
counted, and the best one found, without listing pairs.  A place holds at most one word per letter of
the alphabet and one shorter word, whatever the corpus.

Nodes are numbered exactly.  Words are dealt to sorted parts at sampled cut words; a task walks its
part in order and numbers a node where a word first leaves its predecessor.  A prefix that reaches
across the end of a part is a prefix of the part's last word: such nodes are numbered from the list of
last words, which every task gets (one word per part), so parts agree on them.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafin.llm.common import LOWER_BYTES, map_batches, ship
from stratafin.session import stage

RUN = re.compile("[a-zÀ-ÿ]+")
#: One occurrence in so many loses a letter, the least length and count of a word, and how much more
#: often than a word its form must occur.
EVERY, LEAST_LENGTH, LEAST_COUNT, TIMES = 31, 7, 2, 10
#: Words of a part, distinct words a task holds while it counts, letters of a cut word.
PART_WORDS, HELD_WORDS, CUT_LETTERS = 20_000, 100_000, 64
#: Kinds of pairs: inserted, skipped (first of a run of equal letters), skipped (another).
INSERTED, FIRST, OTHER = 0, 1, 2


def altered(doc_id: str, runs: Counter) -> Counter:
    """A document's lower-cased runs with their counts, each as the rule of planted slips leaves it."""
    out, head = Counter(), zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), head)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def _count_words(batches):
    held = Counter()

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            lower = text.as_py().translate(LOWER_BYTES).decode("utf-8", "replace")
            held.update(altered(doc.as_py(), Counter(RUN.findall(lower))))
            if len(held) >= HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of a corpus.  A null id counts as empty in the rule of slips; null texts have no words."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string").cast("binary"))
    counted = map_batches(rows, _count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def shared_start(a: str, b: str) -> int:
    """Letters that two words have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def boundary_nodes(last: list[str]) -> list[np.ndarray]:
    """Nodes of all prefixes of each part's last word, the empty one included: negative numbers,
    the same for the same prefix."""
    out, base = [], 0
    for i, word in enumerate(last):
        own = -(1 + base + np.arange(len(word) + 1, dtype=np.int64))
        if i:
            common = shared_start(last[i - 1], word)
            own[: common + 1] = out[-1][: common + 1]
        out.append(own)
        base += len(word) + 1
    return out


def part_nodes(part: int, own: list[str], last: list[str], known: list[np.ndarray]) -> list[np.ndarray]:
    """Nodes of all prefixes of a part's sorted words; new ones count up from the part's number."""
    before, nodes = (last[part - 1], known[part - 1]) if part else ("", known[0][:1])
    end, end_nodes, serial, out = last[part], known[part], part << 40, []
    for word in own:
        common = shared_start(before, word)
        reach = max(shared_start(word, end), common)
        fresh = np.arange(serial, serial + len(word) - reach, dtype=np.int64)
        serial += len(fresh)
        nodes = np.concatenate((nodes[: common + 1], end_nodes[common + 1 : reach + 1], fresh))
        out.append(nodes)
        before = word
    return out


def numbered(table: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n) to (word, n, place, nodes): nodes of the prefixes of each word, shortest first, and
    its place in code-point order; words are distinct."""
    ship(table.sparkSession)
    every = max(1, part_words // 4)
    total = table.count()
    sample = table.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(F.substring("word", 1, CUT_LETTERS).alias("c"))
    cuts = sorted({r["c"] for r in sample.distinct().collect()})[3::4] if total > part_words else []  # a word per part

    @F.pandas_udf("int")
    def part_of(values):
        return values.map(lambda v: bisect.bisect_right(cuts, v)).astype("int32")

    rows = table.select("word", "n").withColumn("part", part_of("word"))
    ends = rows.groupBy("part").agg(F.max("word").alias("last")).collect()  # a word per part
    ends = sorted((r["part"], r["last"]) for r in ends)
    order, last = {p: i for i, (p, _) in enumerate(ends)}, [w for _, w in ends]
    known = boundary_nodes(last)

    def run(group: pa.Table) -> pa.Table:
        part = order[group.column("part")[0].as_py()]
        group = group.sort_by("word")
        nodes = part_nodes(part, group.column("word").to_pylist(), last, known)
        place = pa.array((part << 40) + np.arange(group.num_rows), pa.int64())
        return pa.table([group.column("word"), group.column("n"), place, pa.array(nodes, pa.list_(pa.int64()))], ["word", "n", "place", "nodes"])

    return rows.groupBy("part").applyInArrow(run, "word string, n long, place long, nodes array<long>")


def pairs(nodes: DataFrame) -> DataFrame:
    """(word, n, place, heads, tails) to a row (p, s, kind, place, n) for each pair of nodes."""

    def run(batches):
        for batch in batches:
            p, s, kind, place, n = [], [], [], [], []
            for i in range(batch.num_rows):
                word = np.frombuffer(batch.column(0)[i].as_py().encode("utf-32-le"), "<u4")
                heads = batch.column(3)[i].values.to_numpy()
                tails = batch.column(4)[i].values.to_numpy()[::-1]
                size = len(word)
                p += [heads, heads[:-1]]
                s += [tails, tails[1:]]
                first = np.concatenate(([True], word[1:] != word[:-1]))
                kind += [np.zeros(size + 1, np.int8), np.where(first, FIRST, OTHER).astype(np.int8)]
                place.append(np.full(2 * size + 1, batch.column(2)[i].as_py()))
                n.append(np.full(2 * size + 1, batch.column(1)[i].as_py()))
            if p:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (p, s, kind, place, n)], ["p", "s", "kind", "place", "n"])

    return map_batches(nodes.select("word", "n", "place", "heads", "tails"), run, "p long, s long, kind byte, place long, n long")


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of nodes to (place, n_near, best): how many near words a word has, and the one that
    occurs most (the first in code-point order of equals) as (n, -place).  Words without any are left out.

    The window holds the words of one pair of nodes: one per letter of the alphabet at most, and one more.
    """
    at = Window.partitionBy("p", "s")
    ranked = at.orderBy((F.col("kind") != INSERTED).desc(), F.desc("n"), "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(F.col("n"), (-F.col("place")).alias("m"))
    rows = rows.withColumns({
        "all": F.count(F.lit(1)).over(at),
        "skipped": F.count(F.when(F.col("kind") != INSERTED, 1)).over(at),
        "longer": F.count(F.when(F.col("kind") == FIRST, 1)).over(at),
        "shorter": F.max(F.when(F.col("kind") == INSERTED, own)).over(at),
        "longest": F.max(F.when(F.col("kind") == FIRST, own)).over(at),
        "one": F.first(own).over(ranked),
        "two": F.nth_value(own, 2).over(ranked),
    })
    rows = rows.where(F.col("all") > 1)
    of_equal = F.when(F.col("skipped") > 1, F.when(F.col("one.m") == -F.col("place"), F.col("two")).otherwise(F.col("one")))
    of_short = F.when(F.col("kind") == FIRST, F.col("shorter"))
    inserted = F.col("kind") == INSERTED
    near = F.when(inserted, F.col("longer")).otherwise(F.col("skipped") - 1 + of_short.isNotNull().cast("long"))
    best = F.when(inserted, F.col("longest")).otherwise(F.greatest(of_equal, of_short))
    rows = rows.select("place", near.alias("near"), best.alias("best")).where("near > 0")
    return rows.groupBy("place").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, form) to (place, root): the end of each chain of forms, by doubling.  Counts grow
    at each step of a chain, so chains are short and have no cycles."""
    current = stage(forms.select("place", F.col("form").alias("root")))
    while True:
        then = current.select(F.col("place").alias("root"), F.col("root").alias("next"))
        moved = current.join(then, "root", "left")
        moved = stage(moved.select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = moved.select("place", "root")
        if moved.where("moved").isEmpty():
            return current


def variants(table: DataFrame, times: int = TIMES, part_words: int = PART_WORDS) -> DataFrame:
    """Distinct (word, n) to a row per word: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point.  ``form`` is the near
    word with the largest n (of equals the first in code-point order) if that is at least ``times``
    the word's own; ``root`` follows forms to the last.  An empty table gives an empty result.
    """
    heads = numbered(table, part_words).withColumnRenamed("nodes", "heads")
    turned = numbered(table.select(F.reverse("word").alias("word"), "n"), part_words)
    turned = turned.select(F.reverse("word").alias("word"), F.col("nodes").alias("tails"))
    both = stage(heads.join(turned, "word"))
    found = neighbours(pairs(both))
    rows = both.select("word", "n", "place").join(found, "place", "left")
    to = F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.m"))
    rows = stage(rows.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), to.alias("form_place"), F.when(to.isNotNull(), F.col("best.n")).alias("form_n")))
    ends = roots(rows.where("form_place is not null").select("place", F.col("form_place").alias("form")))
    names = rows.select("place", "word")
    named = [names.select(F.col("place").alias(f"{k}_place"), F.col("word").alias(k)) for k in ("form", "root")]
    rows = rows.join(ends.withColumnRenamed("root", "root_place"), "place", "left")
    rows = reduce(lambda r, k: r.join(k, k.columns[0], "left"), named, rows)
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of a corpus.  Rows repeat, and count, as they are; null texts have no words."""
    return variants(stage(words(docs, id_col, text_col)))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB SQL for the rows of the query ``op13_spelling_groups``; the check sum is folded byte by byte.
ORACLE = rf"""
with recursive steps as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc),
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) run from documents),
d as (select doc_id, run, count(*) n from r group by doc_id, run),
b as (select *, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)) bytes from d),
h as (select run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1])), 4294967295) h from b, steps),
a as (select case when h % {EVERY} = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, n from h),
w as (select word, sum(n)::bigint n from a where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
k as (select word, n, i, word[:i] || '_' || word[i + 2:] other, word[:i] || word[i + 2:] short from (select word, n, unnest(range(length(word))) i from w)),
near as (select x.word, y.word form, y.n form_n from k x join k y on x.other = y.other and x.word <> y.word
  union select k.word, w.word, w.n from k join w on k.short = w.word union select w.word, k.word, k.n from k join w on k.short = w.word),
best as (select word, count(*) n_near, list(form order by form_n desc, encode(form))[1] form, max(form_n) form_n from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when form_n >= {TIMES} * n then form end form, case when form_n >= {TIMES} * n then form_n end form_n from w left join best using (word)),
chain as (select word, word root, form next from f union all select chain.word, f.word, f.form from chain join f on chain.next = f.word)
select f.word, f.form, chain.root, f.n, f.n_near::bigint n_near, f.form_n from f join chain using (word) where chain.next is null
"""
