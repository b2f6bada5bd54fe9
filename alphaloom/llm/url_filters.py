"""URL filters: host and path rules, and decisions that follow redirects.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains, and the
longest fitting rule decides. Urls that no rule fits are decided through redirect equivalence: the
canonical link and the refresh of each page (and any given redirect pairs) are edges between urls,
components of the graph are found by distributed star steps, and a component's decision is "allow"
if an allow rule fits any url in it (explicit allow has precedence), else "block" if a block rule
does, else "allow". Urls are compared without fragment, with scheme and host in lower case and an empty
path as "/", so pages at one address are aliases too. Links are looked for in the whole page but for its
comments and scripts; references in them are decoded, and relative ones (//host, /path, path, ?query,
dot segments) resolved against the page's url.

Only the links travel, never whole components: a component is one row with two flags.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule, has no
aliases and is allowed; a null page, a link of another kind (mailto: and the like), one to the page itself
or a relative one on a page without url gives no edge; repeated rows are
judged each by itself; a null page_id stays as it is; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import table, written
from alphaloom.llm.components import components

#: Verdict, host, beginning of the path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Up to so many rules are one expression; more are joined by host.
INLINE_RULES = 64
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(url: Column) -> Column:
    """What two urls of one resource share; null if it is no absolute url."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1), _UPPER, _LOWER)
    rest = F.btrim(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))
    return F.when(F.length(scheme) > 0, F.concat(scheme, F.lit("://"), host(url), F.when(F.startswith(rest, F.lit("/")), F.lit("")).otherwise(F.lit("/")), rest))


def _decoded(text: Column) -> Column:
    """``text`` with numeric character references and the named ones that urls hold decoded."""

    def one(out: Column, m: Column) -> Column:
        digits = F.regexp_extract(m, "&#[xX]?([0-9A-Fa-f]+)", 1)
        number = F.when(F.rlike(m, F.lit("&#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), F.replace(out, m, letter)).otherwise(out)

    text = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[xX][0-9A-Fa-f]{1,8}|[0-9]{1,8});?"), 0)), text, one)
    for name, letter in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("sol", "/"), ("colon", ":"), ("quest", "?"), ("equals", "="), ("period", "."), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(letter))
    return text


def _resolved(url: Column, target: Column) -> Column:
    """The absolute url of a link on the page at ``url``; null if it leads to no other page."""
    site = F.regexp_extract(url, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(site, r"^([^:]*:)", 1)
    here = path(url)
    folder = F.when(here == "", "/").otherwise(F.regexp_extract(here, r"(?s)^(.*/)", 1))
    full = (
        F.when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, here, target))
        .otherwise(F.concat(site, folder, target))
    )
    start, way, rest = (F.regexp_extract(full, r"(?s)^([^:]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    parts = F.split(way, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    straight = F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    full = F.when(F.rlike(way, F.lit(r"/\.\.?(?:/|$)")), F.concat(start, straight, rest)).otherwise(full)
    other = F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    return F.when((target == "") | F.startswith(target, F.lit("#")), None).when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target).when(other | (site == ""), None).otherwise(full)


def rule_of(frame: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``frame`` (with columns host and path) and the longest fitting rule: columns rule and decided, null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    if len(order) <= INLINE_RULES:
        rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verdict, name, start in reversed(order):
            fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit(start))
            rule, decided = F.when(fits, name + start).otherwise(rule), F.when(fits, verdict).otherwise(decided)
        return frame.withColumns({"rule": rule, "decided": decided})
    spark = frame.sparkSession
    keyed = spark.createDataFrame([(v, h, p) for v, h, p in order], "decided string, suffix string, start string")
    rows = written(spark, frame.withColumn("_row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = rows.select("_row", "path", F.explode(suffixes).alias("suffix")).join(keyed, "suffix").where(F.startswith("path", F.col("start")))
    fits = fits.select("_row", F.struct(F.length(F.concat("suffix", "start")).alias("n"), F.concat("suffix", "start").alias("rule"), "decided").alias("r"))
    best = fits.groupBy("_row").agg(F.max("r").alias("r")).select("_row", "r.rule", "r.decided")
    return rows.join(best, "_row", "left").drop("_row")


def page_links(pages: DataFrame) -> DataFrame:
    """Edges between addresses: a page's url to its canonical link and to where its refresh leads."""
    html = F.regexp_replace(F.col("html"), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    quoted_parts = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,64}+>"""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:link|meta)\b(?:{quoted_parts}|[^>]*+>)"), 0)

    def value(tag: Column, name: str) -> Column:
        pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.btrim(_decoded(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))), F.lit(_BLANK))

    canonical = F.transform(F.filter(tags, lambda t: F.rlike(t, F.lit("(?i)^<link")) & F.rlike(value(t, "rel"), F.lit(r"(?i)(?:^|\s)canonical(?:\s|$)"))), lambda t: value(t, "href"))
    refresh = F.transform(F.filter(tags, lambda t: F.rlike(t, F.lit("(?i)^<meta")) & F.rlike(value(t, "http-equiv"), F.lit(r"(?i)^refresh$"))), lambda t: F.btrim(F.regexp_extract(value(t, "content"), r"""(?is)^[0-9.\s]*[;,\s]\s*(?:url\s*=)?\s*["']?([^"']*)""", 1), F.lit(_BLANK)))
    asked = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where(F.lower("html").rlike("canonical|refresh"))
    found = asked.select("url", F.explode(F.concat(canonical, refresh)).alias("to"))
    return found.select(_address(F.col("url")).alias("a"), _address(_resolved(F.col("url"), F.col("to"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict. ``redirects`` has columns a and b, two urls of one resource."""
    url = F.col("url").cast("string")
    own = rule_of(pages.select("page_id", _address(url).alias("address"), host(url).alias("host"), path(url).alias("path")), rules)
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(_address(F.col("a")).alias("a"), _address(F.col("b")).alias("b")).where("a is not null and b is not null and a <> b"))
    group = written(spark, components(spark, links, "a", "b"), "aliases")
    # decisions on every url that is known: pages and the ends of links
    ends = rule_of(group.select("component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    linked = ends.groupBy("component").agg(F.max((F.col("decided") == "allow").cast("int")).alias("allow"), F.max((F.col("decided") == "block").cast("int")).alias("block"))
    alias = written(spark, group.join(linked, "component").select(F.col("node").alias("address"), "allow", "block"), "decisions")
    same = F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").otherwise("allow")
    # rows that a rule decides, or without an address, have nothing to look up: they stay where they are, not on one key
    asks = F.col("decided").isNull() & F.col("address").isNotNull()
    found = own.where(asks).join(alias, "address", "left").select("page_id", "host", "path", "rule", same.alias("verdict"))
    return found.unionByName(own.where(~asks).select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages"), RULES)


#: DuckDB SQL for op8's rows: the first canonical link and the first refresh of a page, relative ones resolved (dot segments and
#: references other than &amp; left aside). Components are walked by a recursive query.
OP8_SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
base AS (
  SELECT row_number() OVER () AS r, page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g') AS html,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1) AS site, url
  FROM pages),
tags AS (
  SELECT r, scheme, site, path, url, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>|<link\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?\s*([^"''>\s]*)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>', 0), '(?is)[;,]\s*(?:url\s*=)?\s*["'']?\s*([^"''>\s]*)', 1)]) AS t,
    unnest([regexp_matches(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b'), true]) AS meant
  FROM base WHERE scheme <> ''),
targets AS (
  SELECT r, url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
              WHEN t = '' OR starts_with(t, '#') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
              WHEN starts_with(t, '//') THEN scheme || ':' || t
              WHEN starts_with(t, '/') THEN scheme || '://' || site || t
              WHEN starts_with(t, '?') THEN scheme || '://' || site || path || t
              ELSE scheme || '://' || site || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(?s:.*)/', 0) END || t END AS t
  FROM (SELECT * REPLACE (replace(t, '&amp;', '&') AS t) FROM tags WHERE meant)),
address AS (
  SELECT u, lower(regexp_extract(u, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1))
         || CASE WHEN starts_with(regexp_extract(u, '^(?s:.*?)://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || trim(regexp_extract(u, '^(?s:.*?)://[^/?#]*([^#]*)', 1)) AS a
  FROM (SELECT t AS u FROM targets UNION SELECT url FROM base) WHERE regexp_matches(u, '^\s*[A-Za-z][A-Za-z0-9+.-]*://')),
links AS (
  SELECT x.a AS a, y.a AS b FROM targets JOIN address x ON targets.url = x.u JOIN address y ON targets.t = y.u WHERE x.a <> y.a),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
url_rules AS (
  SELECT n.b AS address, arg_max(rules.verdict, length(rules.h || rules.p)) AS decided
  FROM (SELECT DISTINCT b FROM reach) n JOIN rules
    ON (regexp_extract(n.b, '://([^/?#]*)', 1) = rules.h OR ends_with(regexp_extract(n.b, '://([^/?#]*)', 1), '.' || rules.h))
   AND starts_with(regexp_extract(n.b, '://[^/?#]*([^?#]*)', 1), rules.p)
  GROUP BY n.b),
alias AS (
  SELECT reach.a AS address, max(CASE WHEN decided = 'allow' THEN 1 ELSE 0 END) AS allow, max(CASE WHEN decided = 'block' THEN 1 ELSE 0 END) AS block
  FROM reach LEFT JOIN url_rules ON reach.b = url_rules.address GROUP BY reach.a),
fit AS (
  SELECT base.r, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.verdict, length(rules.h || rules.p)) AS decided
  FROM base JOIN rules ON (base.host = rules.h OR ends_with(base.host, '.' || rules.h)) AND starts_with(base.path, rules.p)
  GROUP BY base.r)
SELECT base.page_id, base.host, base.path, fit.rule,
       coalesce(fit.decided, CASE WHEN alias.allow = 1 THEN 'allow' WHEN alias.block = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM base LEFT JOIN fit ON base.r = fit.r LEFT JOIN address ON base.url = address.u LEFT JOIN alias ON address.a = alias.address
"""
