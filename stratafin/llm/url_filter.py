"""URL filtering by association rules, DataFrame and SQL functions only.

A URL becomes a set of tokens: scheme, host labels, words of the path, keys of the query.  FP-growth
mines the token combinations of labelled URLs together with their label; a combination A and a label
v form the rule A -> v with confidence count(A, v) / count(A).  Rules below the least support or
confidence go, and so do rules that a more general one beats.

Every remaining rule is posted in an inverted index under its rarest token.  Distinct token sets look
their tokens up, check the rest of the rules found, and the most confident one decides; the sets'
verdicts return to their URLs.  Hand-written rules on host and path come first.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafin.llm.common import lower_ascii
from stratafin.session import stage

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of the labelled URLs, least number of them, and least confidence of a mined rule.
SUPPORT, LEAST, CONFIDENCE = 0.005, 20, 0.5
#: The verdict where nothing matches.
OTHERWISE = "allow"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: str, i: int) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), _URL, i)


def host_of(url: str = "url") -> Column:
    return lower_ascii(_part(url, 2))


def path_of(url: str = "url") -> Column:
    return _part(url, 3)


def _named(kind: str, tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))


def tokens_of(url: str = "url") -> Column:
    """Sorted distinct tokens: scheme, host labels (parted at dots and hyphens), words of the path
    that aren't numbers, keys of the query; A-Z lower-cased.  Empty for a null or a URL without ://."""
    words = F.regexp_extract_all(lower_ascii(path_of(url)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    words = F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))
    keys = F.transform(F.split(lower_ascii(_part(url, 4)), "&"), lambda k: F.split(k, "=")[0])
    kinds = [("s:", F.array(lower_ascii(_part(url, 1)))), ("h:", F.split(host_of(url), "[.-]")), ("p:", words), ("q:", keys)]
    return F.array_sort(F.array_distinct(F.concat(*[_named(k, a) for k, a in kinds])))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest hand-written rule that fits, as (size, host size, rule, verdict), else null; of
    equally long ones that with the longer host, then the later in order of text."""
    found = []
    for verdict, own, start in rules:
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(len(own + start)).alias("size"), F.lit(len(own)).alias("own"), F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<size:int,own:int,rule:string,verdict:string>")


def labelled(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(tokens, label): URLs whose document, the last number of their path, has labels: ``block`` if
    any says that it is toxic or of low quality, else ``allow``.  Labels without a value don't count."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc"), bad.alias("bad")).groupBy("doc").agg(F.max("bad").alias("bad"))
    doc = F.expr("try_cast(number as bigint)")
    rows = pages.select(tokens_of(url).alias("tokens"), F.regexp_extract(path_of(url), r"([0-9]+)[^0-9]*$", 1).alias("number")).withColumn("doc", doc)
    rows = rows.join(marks.where("bad is not null"), "doc").where("size(tokens) > 0")
    return rows.select("tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))


def standing(rows: DataFrame) -> DataFrame:
    """(token): of tokens that always come together the first, so that a long common part of many
    URLs is one item and not a combination of each of its subsets."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token")
    where = [F.sum(F.xxhash64(F.lit(s), "row").cast("decimal(38,0)")).alias(f"w{s}") for s in (1, 2)]
    return seen.agg(F.count("*").alias("n"), *where).groupBy("n", "w1", "w2").agg(F.min("token").alias("token")).select("token")


def mine(rows: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """Labelled token sets (tokens, label) to rules (token, tokens, verdict, confidence, n), stored;
    ``token`` is the rarest of its tokens, under which a rule is posted.

    Without labelled rows, or with fewer than ``least``, there are no rules.
    """
    rows = stage(rows)
    total = rows.count()
    count = max(least, math.ceil(support * total))
    names = {v: "=" + v for v in ("allow", "block")}
    if total < count:
        return rows.sparkSession.createDataFrame([], "token string, tokens array<string>, verdict string, confidence double, n long")
    every = rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "label")
    kept = every.select("row", F.explode("tokens").alias("token")).join(standing(rows), "token")
    baskets = kept.select("row", "token").unionByName(every.select("row", F.concat(F.lit("="), "label").alias("token")))
    baskets = stage(baskets.groupBy("row").agg(F.collect_list("token").alias("items")).select("items"))  # no longer than the tokens of a URL
    model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / total).fit(baskets)
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    verdict = F.when(F.array_contains("items", names["block"]), "block").when(F.array_contains("items", names["allow"]), "allow")
    own = F.array_except("items", F.array(*[F.lit(n) for n in names.values()]))
    marked = sets.select(own.alias("tokens"), verdict.alias("verdict"), F.col("freq").alias("n")).where("verdict is not null and size(tokens) > 0")
    whole = sets.select(F.col("items").alias("tokens"), F.col("freq").alias("all"))
    rules = marked.join(whole, "tokens").withColumn("confidence", F.col("n") / F.col("all")).where(F.col("confidence") >= confidence)
    rules = stage(rules.select("tokens", "verdict", "confidence", "n"))
    general = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("best"))
    fewer = F.expr("transform(tokens, (t, i) -> filter(tokens, (u, j) -> j != i))")
    beaten = rules.select("tokens", "verdict", "confidence", F.explode(fewer).alias("fewer")).join(general, ["fewer", "verdict"]).where("best >= confidence")
    rules = rules.join(beaten.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    single = sets.where("size(items) = 1").select(F.col("items")[0].alias("token"), F.col("freq").alias("f"))
    posted = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(single, "token")
    posted = posted.groupBy("tokens", "verdict").agg(F.min(F.struct("f", "token"))["token"].alias("token"))
    return stage(rules.join(posted, ["tokens", "verdict"]).select("token", "tokens", "verdict", "confidence", "n"))


def decided(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (tokens) with a rule that matches: (tokens, best); the best is the most
    confident, then the shorter, then that with more URLs, then ``block``, then the first by tokens."""
    index = rules.withColumnRenamed("tokens", "ante")
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where("size(array_except(ante, tokens)) = 0")
    order = F.struct((-F.col("confidence")).alias("c"), F.size("ante").alias("s"), (-F.col("n")).alias("n"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("v"), F.col("ante"), F.col("verdict"))
    return found.groupBy("tokens").agg(F.min(order).alias("best"))


def judge(pages: DataFrame, rules: DataFrame, fixed=RULES, keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """One row per input row: the kept columns, host, path, rule (the hand-written one that decides,
    or null), verdict, and the tokens and confidence of the mined rule that decides (or null).

    A null URL, an empty one and one without ``://`` have neither host nor path nor tokens; nothing
    matches them and they are allowed, like every URL that no rule matches.
    """
    rows = pages.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = rows.withColumn("first", fixed_rule(F.col("host"), F.col("path"), fixed))
    best = stage(decided(rows.where("first is null").select("tokens").distinct(), rules))
    rows = rows.join(best, "tokens", "left")
    mined = F.col("first").isNull() & F.col("best").isNotNull()
    return rows.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.col("first.rule").alias("rule"),
        F.coalesce("first.verdict", F.when(mined, F.col("best.verdict")), F.lit(OTHERWISE)).alias("verdict"),
        F.when(mined, F.array_join("best.ante", " ")).alias("matched"),
        F.when(mined, -F.col("best.c")).alias("confidence"),
    )


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_part(i: int, lower: bool = True) -> str:
    found = f"regexp_extract(coalesce(url, ''), '{_URL}', {i})"
    return f"translate({found}, '{_UP}', '{_LOW}')" if lower else found


def _sql_fixed() -> str:
    rows = [f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then [{{'size': {len(h + p)}, 'own': {len(h)}, 'rule': '{h + p}', 'verdict': '{v}'}}] else [] end" for v, h, p in RULES]
    return "list_reverse_sort(flatten([" + ", ".join(rows) + "]))[1]"


#: DuckDB SQL for the rows of the query ``op12_url_filter``: every subset of a URL's tokens instead of FP-growth.
ORACLE = rf"""
with u as (select row_number() over () rid, page_id, {_sql_part(2)} host, {_sql_part(3, False)} path,
  list_sort(list_distinct(flatten([
    list_transform(list_filter([{_sql_part(1)}], lambda t: t <> ''), lambda t: 's:' || t),
    list_transform(list_filter(regexp_split_to_array({_sql_part(2)}, '[.-]'), lambda t: t <> ''), lambda t: 'h:' || t),
    list_transform(list_filter(regexp_extract_all({_sql_part(3)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: not regexp_full_match(t, '[0-9]+')), lambda t: 'p:' || t),
    list_transform(list_filter(list_transform(string_split({_sql_part(4)}, '&'), lambda k: string_split(k, '=')[1]), lambda t: t <> ''), lambda t: 'q:' || t)]))) tokens
  from pages),
p as (select *, {_sql_fixed()} first from u),
marks as (select doc_id doc, max(case when toxic = 1 or quality = 0 then 1 when toxic is not null or quality is not null then 0 end) bad from labels group by doc_id),
l as (select rid, tokens, bad from p join marks on marks.doc = try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') as bigint) where bad is not null and len(tokens) > 0),
t as (select rid, unnest(tokens) token from l),
st as (select list(token order by token)[1] token from (select token, list(rid order by rid) rows from t group by token) group by rows),
b as (select rid, list(token order by token) items from t join st using (token) group by rid),
least_n as (select greatest({LEAST}, cast(ceil({SUPPORT} * count(*)) as bigint)) least_n from l),
s as (select list_filter(items, lambda t, i: (m >> (i - 1)) & 1 = 1) ante, bad from (select rid, items, unnest(range(1, cast(1 << len(items) as bigint))) m from b) join l using (rid)),
c as (select ante, count(*) total, sum(bad) bad from s group by ante),
r as (select ante, n / total confidence, n, verdict from (
    select ante, total, bad n, 'block' verdict from c union all select ante, total, total - bad, 'allow' from c)
  where n >= (select least_n from least_n) and n / total >= {CONFIDENCE}),
sets as (select distinct tokens from p where first is null),
f as (select tokens, ante, confidence, n, verdict from sets join r on list_has_all(tokens, ante)),
best as (select tokens, ante, confidence, verdict from f qualify row_number() over (partition by tokens order by confidence desc, len(ante), n desc, verdict = 'block' desc, ante) = 1)
select page_id, host, path, first.rule rule, coalesce(first.verdict, best.verdict, '{OTHERWISE}') verdict,
  case when first is null then array_to_string(ante, ' ') end matched, case when first is null then confidence end confidence
from p left join best using (tokens)
"""
