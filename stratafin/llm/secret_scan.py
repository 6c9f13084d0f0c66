"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Each text is searched once.  Three kinds of candidates are always reported: ``assign`` (a keyword
with a value), ``access`` (an access key id) and ``hex`` (a long hexadecimal run).  The values of
all candidates, and of generic mixed tokens, are hashed and counted over the corpus by distinct
documents and distinct owners.  A value that at least ``min_owners`` owners hold is a widely copied
``example``; any other is ``live``.  A generic token is reported, as kind ``owned``, only if it is
live: no single document could tell it from a documentation sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import whole_text
from stratafin.session import stage

KINDS = ("assign", "access", "hex", "owned")
#: What a candidate of each kind looks like, and the group that holds its value.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
GENERIC = r"[A-Za-z0-9+/_-]{20,}"
MIN_ASSIGNED = 8
#: Distinct characters that a generic token needs to look random.
MIN_VARIETY = 12
MIN_OWNERS = 3

_SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, ord_: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, ord, end, value), in code points.

    The pieces between matches and the matches themselves give the positions by running sums.
    """
    regex = F.lit(pattern)
    matches, pieces = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else matches
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    ends = F.aggregate(steps, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    rows = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(ends, 2, F.size(matches)).alias("e"))
    rows = F.transform(
        rows,
        lambda r: F.struct((r["e"] - F.length(r["m"])).alias("start"), F.lit(ord_).alias("ord"), r["e"].alias("end"), r["v"].alias("value")),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array()).cast(_SPAN)


def candidates(text: Column) -> Column:
    """Every candidate of a text, the generic tokens included."""
    assign = F.filter(spans_of(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    varied = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= MIN_VARIETY
    generic = F.filter(
        spans_of(text, GENERIC, 3),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & ~s["value"].rlike("^[0-9a-f]+$") & ~s["value"].rlike("^AKIA") & varied(s["value"]),
    )
    return F.array_sort(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2), generic))


def ownership(rows: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(rid, owner, found) to (rid, spans): spans sorted, with the counts and class of their value.

    Values travel as hashes.  Counting is two-level, so a value in a third of the corpus is folded
    before it is shuffled; the join back is an equality join that AQE splits.
    """
    each = rows.select("rid", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.explode("found").alias("s"))
    each = each.select("rid", "owner", "s.start", "s.ord", "s.end", F.sha2("s.value", 256).alias("h"))
    by_owner = each.groupBy("h", "owner").agg(F.countDistinct("rid").alias("docs"))
    counts = by_owner.groupBy("h").agg(F.sum("docs").alias("docs"), F.count("*").alias("owners"))
    judged = each.join(counts, "h").withColumn("live", F.col("owners") < min_owners).where("ord < 3 or live")
    span = F.struct("start", "ord", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("ord") + 1).alias("kind"), "live", "owners", "docs")
    return judged.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), owner_col: str = "source", text_col: str = "text", min_owners: int = MIN_OWNERS) -> DataFrame:
    """One row per input row: the kept columns and ``spans`` (empty for null or clean texts).

    A null owner counts as one owner of its own.  Repeated rows are separate documents of the same
    owner.
    """
    rows = docs.select(*keep, F.col(owner_col).alias("__owner"), candidates(whole_text(text_col)).alias("__found"))
    rows = stage(rows.withColumn("__rid", F.monotonically_increasing_id()))
    found = rows.where(F.size("__found") > 0).select(F.col("__rid").alias("rid"), F.col("__owner").alias("owner"), F.col("__found").alias("found"))
    judged = ownership(found, min_owners).withColumnRenamed("rid", "__rid")
    none = F.array().cast(judged.schema["spans"].dataType)
    return rows.join(judged, "__rid", "left").select(*keep, F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, owner_col: str = "source", text_col: str = "text", min_owners: int = MIN_OWNERS) -> DataFrame:
    """The same rows and columns with every span replaced: ``[SECRET]`` if its value is live,
    ``[SAMPLE KEY]`` if it is widely copied.  ``n_chars`` follows where there is one.

    Only texts with a candidate take part in the joins; all others pass through untouched.
    """
    text = whole_text(text_col)
    some = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(GENERIC)
    dirty = stage(docs.where(some).withColumn("__found", candidates(text)).withColumn("__rid", F.monotonically_increasing_id()))
    found = dirty.where(F.size("__found") > 0).select(F.col("__rid").alias("rid"), F.col(owner_col).alias("owner"), F.col("__found").alias("found"))
    dirty = dirty.join(ownership(found, min_owners).withColumnsRenamed({"rid": "__rid", "spans": "__spans"}), "__rid", "left")
    raw = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done, s):
        mark = F.when(s["live"], F.lit("[SECRET]")).otherwise(F.lit("[SAMPLE KEY]"))
        new = F.concat(done["out"], F.substring(raw, done["at"] + 1, s["start"] - done["at"]), mark)
        return F.struct(F.when(s["start"] >= done["at"], new).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    clean = F.aggregate("__spans", start, step, lambda done: F.concat(done["out"], F.substring(raw, done["at"] + 1, F.length(raw))))
    dirty = dirty.withColumn(text_col, F.when(F.size("__spans") > 0, clean).otherwise(raw))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        dirty = dirty.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(kind))
    return docs.where(~some).select(*docs.columns).unionByName(dirty.select(*docs.columns))


def count_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["ord"] == kind)).cast("long")


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: DuckDB SQL for the rows of the query ``op5_secret_scan``.
ORACLE = rf"""
with docs as (select doc_id, row_number() over () rid, coalesce(source, '') as owner_, coalesce(text, '') as t from documents),
p(ord, kind, pat, grp) as (values
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  (1, 'access', '{ACCESS}', 0), (2, 'hex', '{HEX}', 0), (3, 'owned', '{GENERIC}', 0)),
hits as (
  select rid, owner_, 0 as ord, regexp_extract_all(t, (select pat from p where ord = 0)) m,
    regexp_extract_all(t, (select pat from p where ord = 0), 2) v, regexp_split_to_array(t, (select pat from p where ord = 0)) g from docs
  union all select rid, owner_, 1, regexp_extract_all(t, '{ACCESS}') m, m, regexp_split_to_array(t, '{ACCESS}') from docs
  union all select rid, owner_, 2, regexp_extract_all(t, '{HEX}') m, m, regexp_split_to_array(t, '{HEX}') from docs
  union all select rid, owner_, 3, regexp_extract_all(t, '{GENERIC}') m, m, regexp_split_to_array(t, '{GENERIC}') from docs),
flat as (select rid, owner_, ord, i, m[i] mi, v[i] vi, length(g[i]) gl, length(m[i]) ml
  from (select *, unnest(range(1, len(m) + 1)) i from hits)),
placed as (select rid, owner_, ord, vi, sum(gl + ml) over (partition by rid, ord order by i) e, ml from flat),
spans as (select rid, owner_, ord, vi, (e - ml)::bigint s, e::bigint e from placed where
  (ord = 0 and length(vi) >= {MIN_ASSIGNED}) or ord in (1, 2) or (ord = 3 and regexp_matches(vi, '[0-9]') and regexp_matches(vi, '[A-Za-z]')
   and not regexp_matches(vi, '^[0-9a-f]+$') and not regexp_matches(vi, '^AKIA') and len(list_distinct(string_split(vi, ''))) >= {MIN_VARIETY})),
own as (select vi, count(distinct owner_) owners from spans group by vi),
judged as (select rid, ord, s, e, (select kind from p where p.ord = spans.ord) kind, owners < {MIN_OWNERS} live from spans join own using (vi)
  where ord < 3 or owners < {MIN_OWNERS}),
agg as (select rid, count(*) filter (ord = 0) a, count(*) filter (ord = 1) k, count(*) filter (ord = 2) h,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord, e) filter (ord < 3) base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord, e) al,
  count(*) filter (live) nl, count(*) filter (not live) ne from judged group by rid)
select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(k, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(al, '') spans, coalesce(nl, 0)::bigint n_live, coalesce(ne, 0)::bigint n_example
from docs left join agg using (rid)
"""
