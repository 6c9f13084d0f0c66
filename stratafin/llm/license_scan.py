"""Licence scan in DataFrame functions only: TF-IDF cosine of the units of a text to templates, then
inheritance from the nearest directory above that has a licence file.

A text's units are its sentences (by line, and across the lines of a paragraph), its paragraphs, its
comments (block comments, and runs of lines that begin with a comment mark), and the whole text.
Unit and template are sparse vectors, (1 + ln uses) x idf for a word of the templates; any other
word weighs like a word that no file holds.  They meet by a join on words.  A template at or above
the threshold fits if the unit holds the words that tell the licence and its version from its
relatives; of those that fit a file, the one that explains most of it (the dot product with the
template of length one) is the file's own licence, so a whole licence text wins over its sentences.

Two filters keep texts of other kinds out of the join and lose nothing: a unit at the threshold holds
one of the words without which each template cannot reach it, and enough words of templates.

A file that is named like a licence file speaks for its directory; files without a licence of their
own take that of the nearest ancestor, found by equality joins of directories with the ancestors of
the distinct directories that need one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafin.llm.common import UPPER, lower_ascii, whole_text
from stratafin.llm.license_texts import templates
from stratafin.session import stage

#: Fixed value: names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
THRESHOLD = 0.75
DIGITS = 6
#: Where a text is cut: sentences within lines, sentences across the lines of a paragraph, paragraphs
#: (a line without letters or digits parts them), and lines of code, which leaves runs of comments.
CUTS = [r"[.!?][ \t\r]+|\n", r"[.!?][ \t\r\n]+|\n[^A-Za-z0-9]*\n", r"\n[^A-Za-z0-9]*\n", r"\n[ \t]*[A-Za-z0-9_@(){}<&$][^\n]*"]
BLOCK_COMMENT = r"(?s)/\*.*?\*/"


def words_in(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


TEMPLATES = templates()
VOCABULARY = sorted({w for _, _, t in TEMPLATES for w in words_in(t)})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit("[a-z0-9]+"), F.lit(0))


def held_words(text: Column) -> Column:
    """The distinct words of templates in a text."""
    return F.array_intersect(words_of(text), F.array(*map(F.lit, VOCABULARY)))


def document_frequencies(files: DataFrame, held: Column) -> tuple[int, dict[str, int]]:
    """Number of files and, for each template word, of files with it: as many numbers as words."""
    rows = files.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.get("", 0), {w: counts.get(w, 0) for w in VOCABULARY}


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def vectors(weight: dict[str, float]) -> list[dict[str, float]]:
    """Each template as a vector of length one."""
    out = []
    for _, _, t in TEMPLATES:
        words = words_in(t)
        raw = {w: (1 + math.log(words.count(w))) * weight[w] for w in set(words)}
        norm = math.sqrt(math.fsum(x * x for x in raw.values()))
        out.append({w: x / norm for w, x in raw.items()})
    return out


def needed_words(vecs: list[dict[str, float]], weight: dict[str, float]) -> list[str]:
    """Words of which a unit at the threshold holds at least one: for each template its rarest telling
    word, or else its heaviest words, without which the rest is shorter than the threshold."""
    found: set[str] = set()
    for (_, must, _), vec in zip(TEMPLATES, vecs, strict=True):
        if must:
            found.add(max(sorted(must), key=weight.get))
            continue
        left = 1.0
        for w in sorted(vec, key=lambda w: (-vec[w], w)):
            if left < (THRESHOLD - 0.001) ** 2:
                break
            found.add(w)
            left -= vec[w] ** 2
    return sorted(found)


def units_of(text: Column) -> Column:
    cut = [F.split(F.concat(F.lit("\n"), text), c) for c in CUTS]
    return F.array_distinct(F.concat(*cut, F.regexp_extract_all(text, F.lit(BLOCK_COMMENT), F.lit(0)), F.array(text)))


def own_licences(files: DataFrame, path_col: str, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns, ``__path``, and ``own`` (licence, cosine), null without a licence."""
    text = whole_text(text_col)
    # words are cut from every text once; a text is kept if it holds any word of the templates
    rows = files.select(*keep, F.col(path_col).cast("string").alias("__path"), text.alias("__text"), held_words(text).alias("__held"))
    rows = stage(rows.withColumn("__text", F.when(F.size("__held") > 0, F.col("__text"))).withColumn("__rid", F.monotonically_increasing_id()))
    n, df = document_frequencies(rows, F.col("__held"))
    weight = {w: idf(n, df[w]) for w in VOCABULARY}
    vecs = vectors(weight)
    needed = F.array(*map(F.lit, needed_words(vecs, weight)))
    units = rows.where(F.arrays_overlap("__held", needed)).select("__rid", F.posexplode(units_of(F.col("__text"))).alias("__u", "s")).select("__rid", "__u", words_of(F.col("s")).alias("words"))
    units = units.where(F.arrays_overlap("words", needed)).withColumn("known", F.filter("words", lambda w: w.isin(VOCABULARY)))
    strange = F.size("words") - F.size("known")
    # (1 + ln c)^2 is at most 4c/e, and no word weighs more than one that no file holds
    units = units.where(F.size("known") * F.lit(4 / math.e * (1 - THRESHOLD**2) + 1e-6) >= strange * F.lit(THRESHOLD**2 - 1e-6))
    counts = units.select("__rid", "__u", strange.alias("strange"), F.explode("known").alias("word")).groupBy("__rid", "__u", "strange", "word").count()

    posted = [(w, weight[w], [(i, vec[w], int(w in must)) for i, ((_, must, _), vec) in enumerate(zip(TEMPLATES, vecs, strict=True)) if w in vec]) for w in VOCABULARY]
    index = files.sparkSession.createDataFrame(posted, "word string, idf double, posted array<struct<t: int, x: double, must: int>>")
    v = (1 + F.log("count")) * F.col("idf")
    met = counts.join(index, "word").withColumn("v", v)
    length = F.struct(F.lit(-1).alias("t"), (F.col("v") * F.col("v")).alias("x"), F.lit(0).alias("must"))
    each = F.transform("posted", lambda p: F.struct(p["t"].alias("t"), (p["x"] * F.col("v")).alias("x"), p["must"].alias("must")))
    summed = met.select("__rid", "__u", "strange", F.inline(F.array_append(each, length))).groupBy("__rid", "__u", "strange", "t").agg(F.sum("x").alias("dot"), F.sum("must").alias("must"))
    one = summed.groupBy("__rid", "__u", "strange").agg(
        F.max(F.when(F.col("t") < 0, F.col("dot"))).alias("square"),
        F.collect_list(F.when(F.col("t") >= 0, F.struct("t", "dot", "must"))).alias("hits"),  # as many as templates
    )
    telling = F.array(*[F.lit(len(must)) for _, must, _ in TEMPLATES])
    norm = F.sqrt(F.col("square") + F.col("strange") * F.lit(idf(n, 0) ** 2))
    fits = F.transform("hits", lambda h: F.struct(F.round(h["dot"], DIGITS).alias("explains"), F.round(h["dot"] / norm, DIGITS).alias("cosine"), (-h["t"]).alias("template"), h["must"].alias("must")))
    fits = F.filter(fits, lambda h: (h["cosine"] >= THRESHOLD) & (h["must"] == F.get(telling, -h["template"])))
    best = one.select("__rid", F.array_max(fits).alias("b")).where("b is not null").groupBy("__rid").agg(F.max("b").alias("b"))
    names = F.array(*[F.lit(name) for name, _, _ in TEMPLATES])
    best = best.select("__rid", F.struct(F.get(names, -F.col("b.template")).alias("licence"), F.col("b.cosine").alias("cosine")).alias("own"))
    return rows.drop("__text", "__held").join(best, "__rid", "left").drop("__rid")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per input row: the kept columns, ``licence``, ``cosine``, ``basis`` (``own``,
    ``inherited`` or ``none``) and ``inherited_from`` (the directory).

    Null and empty texts have no notice.  A file with a null path neither gives nor takes.  Of
    several licence files in a directory the best cosine speaks, then the smaller licence name.
    """
    rows = stage(own_licences(files, path_col, keep, text_col).withColumn("__dir", folder(F.col("__path"))))
    name = F.regexp_extract("__path", "[^/]*$", 0)
    spoken = rows.where(name.rlike(LICENCE_FILE) & F.col("own").isNotNull())
    spoken = spoken.groupBy("__dir").agg(F.min(F.struct((-F.col("own.cosine")).alias("rank"), F.col("own.licence").alias("licence"))).alias("best"))
    spoken = spoken.select(F.col("__dir").alias("above"), F.col("best.licence").alias("licence"), (-F.col("best.rank")).alias("cosine"))

    needed = rows.where("own is null and __dir is not null").select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = needed.select("__dir", F.explode(F.array_distinct(above)).alias("above"))
    met = ancestors.join(spoken, "above")
    nearest = Window.partitionBy("__dir").orderBy(F.length("above").desc())
    given = met.withColumn("k", F.row_number().over(nearest)).where("k = 1").select("__dir", F.struct("licence", "cosine", "above").alias("given"))

    out = rows.join(given, "__dir", "left")
    take = F.col("own").isNull() & F.col("given").isNotNull()
    return out.select(
        *keep,
        F.when(take, F.col("given.licence")).otherwise(F.col("own.licence")).alias("licence"),
        F.when(take, F.col("given.cosine")).otherwise(F.col("own.cosine")).alias("cosine"),
        F.when(take, "inherited").when(F.col("own").isNotNull(), "own").otherwise("none").alias("basis"),
        F.when(take, F.col("given.above")).alias("inherited_from"),
    )


_LOW = UPPER.lower()
_VOCAB_SQL = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_SQL = ", ".join(f"({i}, '{name}', {must if must else '[]::varchar[]'}, {_quoted(t)})" for i, (name, must, t) in enumerate(TEMPLATES))
_UNITS_SQL = " || ".join([f"regexp_split_to_array(chr(10) || t, {_quoted(c)})" for c in CUTS] + [f"regexp_extract_all(t, {_quoted(BLOCK_COMMENT)})", "[t]"])
#: DuckDB SQL for the rows of the query ``op9_license_scan``; {path} is the query's path rule.  It
#: compares every unit, without the filters.
ORACLE = rf"""
with files as (select row_number() over () rid, doc_id, {{path}} as path, coalesce(text, '') as t from documents),
voc as (select unnest({_VOCAB_SQL}) w),
tpl(i, licence, must, txt) as (values {_TEMPLATE_SQL}),
n as (select count(*)::double n from files),
fw as (select distinct rid, w from (select rid, unnest(regexp_extract_all(translate(t, '{UPPER}', '{_LOW}'), '[a-z0-9]+')) w from files) where w in (select w from voc)),
idf as (select w, ln((1 + (select n from n)) / (1 + count(rid))) + 1 as x from voc left join fw using (w) group by w),
tw as (select i, w, count(*) c from (select i, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) w from tpl) group by i, w),
tv as (select i, w, (1 + ln(c)) * x / sqrt(sum(((1 + ln(c)) * x) ** 2) over (partition by i)) y, list_contains(must, w)::int m from tw join idf using (w) join tpl using (i)),
unit as (select rid, row_number() over () uid, u from (select rid, unnest(list_distinct({_UNITS_SQL.replace('{', '{{').replace('}', '}}')})) u from files)),
uw as (select rid, uid, w, count(*) c from (select rid, uid, unnest(regexp_extract_all(translate(u, '{UPPER}', '{_LOW}'), '[a-z0-9]+')) w from unit) group by all),
uv as (select rid, uid, w, c, x, (1 + ln(c)) * x v from uw left join idf using (w)),
un as (select uid, sqrt(sum(case when x is null then c * (ln(1 + (select n from n)) + 1) ** 2 else v * v end)) norm from uv group by uid),
cs as (select rid, uid, i, sum(v * y) dot, sum(m) m from uv join tv using (w) group by all),
best as (select rid, max([round(dot, {DIGITS}), round(dot / norm, {DIGITS}), -i]) b from cs join un using (uid) join tpl using (i) where round(dot / norm, {DIGITS}) >= {THRESHOLD} and m = len(must) group by rid),
own as (select rid, (select licence from tpl where i = (-b[3])::int) licence, b[2] cosine from best),
f as (select files.rid, doc_id, path, regexp_replace(path, '/?[^/]*$', '') dir, own.licence, own.cosine from files left join own using (rid)),
spoken as (select dir above, licence, cosine from f where licence is not null and regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')
   qualify row_number() over (partition by dir order by cosine desc, licence) = 1),
given as (select f.rid, spoken.* from f join spoken on (above = '' or dir = above or starts_with(dir, above || '/')) where f.licence is null
   qualify row_number() over (partition by f.rid order by length(above) desc) = 1)
select doc_id, coalesce(f.licence, given.licence) licence, coalesce(f.cosine, given.cosine) cosine,
  case when f.licence is not null then 'own' when given.licence is not null then 'inherited' else 'none' end as basis, given.above inherited_from
from f left join given using (rid)
"""
