"""URL verdicts by rules, carried to aliases.

A rule names a host (it and all its subdomains) and a path prefix; of those that fit, the longest wins.  A page that no rule
fits takes its aliases' verdict: pages and link targets joined by canonical links and refresh redirects form components
(distributed, see components.py); an explicitly allowed member allows the component's undecided pages, else a blocked one
blocks them, else they are allowed.  A page's own rule is never overruled.  Built-in expressions and joins only.

Targets may be absolute, without a scheme, from the root, or relative to the page; dot segments are taken as they stand.

Defined cases: a null url, or one without `://`, has empty host and path, no rule and no alias; repeated pages are judged
each; a null html has no links; an empty table gives no rows; a html of any length is searched whole; ties between rules of
one length go to allow, then to the lesser; columns besides id, url and html, whatever their names, are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .components import components

#: Verdict, host, path prefix: the fixed rules of the query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this go through a join instead of one expression.
INLINE = 200
_TAG = r"(?i)<(?:link|meta)\s[^>]*>"
_CANONICAL, _REFRESH = r"(?i)\srel\s*=\s*[\"']?canonical[\"'\s>/]", r"(?i)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s>/]"
_HREF, _TARGET = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)", r"(?i)url\s*=\s*[\"']?([^\"'>;\s]+)"

#: Of a url: up to its host's end, and up to the last slash of its path.
_SITE, _FOLDER = r"^[^/?#]*://[^/?#]*", r"^([^/?#]*://[^/?#]*[^?#]*/)[^/?#]*"


def host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER))


def path(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def resolve(base: Column, target: Column) -> Column:
    """A link's target as a url of its own; null if it is empty or a place in the page itself."""
    site = F.regexp_extract(base, _SITE, 0)
    folder = F.regexp_extract(base, _FOLDER, 1)
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(site == "", F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), target))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(site, F.lit("/"))), target))
    )


def key(url: Column) -> Column:
    """What names a page among aliases: host, path and query; null without a host."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), path(url), query))


def _fits(rule, h: Column, p: Column) -> Column:
    return ((h == rule[1]) | h.endswith("." + rule[1])) & p.startswith(rule[2])


def decide(df: DataFrame, rules: list[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> DataFrame:
    """df with `rule` (host and path of the longest that fits, or null) and `own` (its verdict)."""
    h, p = F.col(host_col), F.col(path_col)
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "own": F.lit(None).cast("string")})
    if len(rules) <= INLINE:
        pick = lambda value: F.coalesce(*(F.when(_fits(r, h, p), F.lit(value(r))) for r in longest))
        return df.withColumns({"rule": pick(lambda r: r[1] + r[2]), "own": pick(lambda r: r[0])})
    table = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(longest)], "rank int, own string, rule_host string, rule_path string")
    hosted, pathed = fresh(df, "h", "p")
    parts = F.split(F.col("h"), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    pairs = df.select(h.alias("h"), p.alias("p")).distinct().withColumn("rule_host", F.explode(tails)).join(table, "rule_host").where(F.col("p").startswith(F.col("rule_path")))
    best = pairs.groupBy("h", "p").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "own"), "rank").alias("b"))
    best = best.select(F.col("h").alias(hosted), F.col("p").alias(pathed), "b.rule", "b.own")
    return df.join(best, (h == F.col(hosted)) & (p == F.col(pathed)), "left").drop(hosted, pathed)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (u, v) between page keys: canonical links and refresh redirects."""
    tags = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_TAG), F.lit(0))).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1))
    return tags.select(key(F.col("url")).alias("u"), key(resolve(F.col("url"), target)).alias("v")).where("u is not null and v is not null and u <> v").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and `source` (rule, alias or default).  edges: further alias
    pairs of urls (u, v)."""
    url = F.col(url_col)
    own = decide(pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), key(url).alias("key")), rules)
    pairs = links(pages, url_col, html_col) if html_col else None
    if edges is not None:
        more = edges.select(key(F.col("u")).alias("u"), key(F.col("v")).alias("v")).where("u is not null and v is not null and u <> v")
        pairs = more if pairs is None else pairs.union(more)
    carried = None
    if pairs is not None:
        member = components(pairs)
        sides = member.select("node", "component", F.concat(F.lit("x://"), "node").alias("u")).select("node", "component", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
        judged = decide(sides, rules)
        verdicts = judged.groupBy("component").agg(F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("carried"))
        carried = member.join(verdicts, "component").select(F.col("node").alias("key"), "carried")
    own = own.join(carried, "key", "left") if carried is not None else own.withColumn("carried", F.lit(None).cast("string"))
    return own.select("page_id", "host", "path", "rule", F.coalesce("own", "carried", F.lit("allow")).alias("verdict"), F.when(F.col("own").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias").otherwise("default").alias("source"))


def _sql_host(u: str) -> str:
    return f"CASE WHEN strpos(coalesce({u}, ''), '://') = 0 THEN '' ELSE translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') END"


def _sql_path(u: str) -> str:
    return f"CASE WHEN strpos(coalesce({u}, ''), '://') = 0 THEN '' ELSE regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) END"


def _sql_key(u: str) -> str:
    return f"CASE WHEN ({_sql_host(u)}) <> '' THEN ({_sql_host(u)}) || ({_sql_path(u)}) || regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1) END"


def _sql_resolve(u: str, t: str) -> str:
    site, folder = f"regexp_extract({u}, '{_SITE}')", f"regexp_extract({u}, '{_FOLDER}', 1)"
    return f"""CASE WHEN {t} = '' OR starts_with({t}, '#') THEN NULL WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {t} WHEN {site} = '' THEN NULL
 WHEN starts_with({t}, '//') THEN regexp_extract({u}, '^[^:]*:') || {t} WHEN starts_with({t}, '/') THEN {site} || {t} WHEN starts_with({t}, '?') THEN regexp_extract({u}, '^[^?#]*') || {t}
 ELSE CASE WHEN {folder} <> '' THEN {folder} ELSE {site} || '/' END || {t} END"""


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda h, p, value: "CASE " + " ".join(f"WHEN ({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}') THEN '{value(r)}'" for r in longest) + " END"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, {_sql_host('url')} AS host, {_sql_path('url')} AS path, {_sql_key('url')} AS key FROM pages),
o AS (SELECT *, {case('host', 'path', lambda r: r[1] + r[2])} AS rule, {case('host', 'path', lambda r: r[0])} AS own FROM p),
t AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
l AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?canonical["''\\s>/]') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*["'']?refresh["''\\s>/]') THEN regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''>;\\s]+)', 1) END AS target FROM t),
w AS (SELECT url, {_sql_resolve('url', 'target')} AS target FROM l),
e AS (SELECT {_sql_key('url')} AS u, {_sql_key('target')} AS v FROM w),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
r(node, seen) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON r.seen = b.u),
j AS (SELECT node, {case(_sql_host("('x://' || seen)"), _sql_path("('x://' || seen)"), lambda r: r[0])} AS own FROM r),
c AS (SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS carried FROM j GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, carried, 'allow') AS verdict, CASE WHEN own IS NOT NULL THEN 'rule' WHEN carried IS NOT NULL THEN 'alias' ELSE 'default' END AS source
FROM o LEFT JOIN c ON o.key = c.node
"""
