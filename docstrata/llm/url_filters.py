"""URL filters with redirect equivalence.

Rules decide on the urls they fit. Redirects and canonical links make urls aliases of each other; connected components
over those links carry a block to aliases that no rule fits, unless an alias is allowed by a rule. In the graph a url
stands in its normal form (RFC 3986): scheme and host in lower case, no default port, no dot segments, no fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import discard, lower_ascii, materialise, owning
from docstrata.llm.components import components

#: Host and path, and what is decided; the longest that fits wins. Order plays no part.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: What holds no links, up to the end where it is not closed; a canonical link, a refresh, a base, and their targets.
NO_LINKS = r"(?i)<!--[\s\S]*?(?:-->|\z)|<script\b[\s\S]*?(?:</script\s*>|\z)"
LINK = r"""(?i)<link\b[^<>]*\brel\s*=\s*["']?\s*canonical\b[^<>]*>"""
REFRESH = r"""(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^<>]*>"""
BASE = r"""(?i)<base\b[^<>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s<>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s<>]+)"""
#: Character references that stand in urls, the ampersand last.
REFERENCES = (("&#x2F;", "/"), ("&#47;", "/"), ("&#58;", ":"), ("&#x3A;", ":"), ("&#x26;", "&"), ("&#38;", "&"), ("&amp;", "&"))
#: An absolute url: scheme, user, host and port, path, query.
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"
DOTS = r"/\.\.?(/|$)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty for null and for urls without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty like the host."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, and the url's path starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; none goes above the root."""
    parts = F.split(path, "/")

    def step(seen: Column, part: Column) -> Column:
        up = F.when(F.size(seen) > 0, F.slice(seen, F.lit(1), F.size(seen) - 1)).otherwise(seen)
        return F.when(part == ".", seen).when(part == "..", up).otherwise(F.concat(seen, F.array(part)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(DOTS), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The normal form of a url; one that is not absolute stands as it is, without its fragment."""
    part = [F.regexp_extract(url, ABSOLUTE, i) for i in range(6)]
    scheme, host = lower_ascii(part[1]), lower_ascii(part[3])
    plain = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
    path = F.when(part[4] == "", F.lit("/")).otherwise(without_dots(part[4]))
    whole = F.concat(scheme, F.lit("://"), part[2], plain, path, part[5])
    return F.when(part[0] != "", whole).otherwise(F.regexp_extract(url, r"^[^#]*", 0))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once per row: nothing is substituted through a generator's output."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def resolved(links: DataFrame, base: str, to: str, out: str) -> DataFrame:
    """``links`` with the node that each target is, read on a page whose node is the column ``base``: null for targets
    without host, such as ``mailto:``, and for relative ones where the base is not absolute. An empty target, or a fragment
    alone, is the page itself. The columns' own names must not begin with two underscores."""
    target = F.col(to)
    for name, char in REFERENCES:
        target = F.replace(target, F.lit(name), F.lit(char))
    columns = links.columns
    links = _once(links, "__own", F.regexp_extract(target, r"^[^#]*", 0))
    links = _once(links, "__origin", F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    links = _once(links, "__path", F.regexp_extract(base, ABSOLUTE, 4))
    own, origin, path = F.col("__own"), F.col("__origin"), F.col("__path")
    absolute = (
        F.when(own == "", F.col(base))
        .when(own.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(own.rlike(ABSOLUTE), own))
        .when(origin == "", F.lit(None))
        .when(own.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), own))
        .when(own.startswith("/"), F.concat(origin, own))
        .when(own.startswith("?"), F.concat(origin, path, own))
        .otherwise(F.concat(origin, F.regexp_extract(path, r"^[\s\S]*/", 0), own))
    )
    links = _once(links, "__absolute", absolute)
    return links.select(*columns, node_of(F.col("__absolute")).alias(out))


def alias_links(pages: DataFrame) -> DataFrame:
    """``u, v``: the node of a page's url, and those to which its canonical link and its refresh point, the first of each.
    Only pages that name one of them are searched."""
    html = F.col("html").cast("string")
    named = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))
    found = pages.where(F.col("url").isNotNull() & named).select(F.col("url").alias("url"), html.alias("html"))
    found = _once(_once(found, "u", node_of(F.col("url"))), "body", F.regexp_replace("html", NO_LINKS, ""))
    first = lambda tag, to: F.regexp_extract(F.regexp_extract("body", tag, 0), to, 1)
    found = _once(found, "b", first(BASE, HREF)).withColumn("t", F.explode(F.array(first(LINK, HREF), first(REFRESH, REFRESH_URL))))
    found = resolved(found.where("t <> ''").select("u", "b", "t"), "u", "b", "base")
    found = _once(found, "on", F.when(F.col("b") == "", F.col("u")).otherwise(F.coalesce("base", "u")))
    return resolved(found, "on", "t", "v").select("u", "v").where("u <> v")


def url_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every url with a link to another: urls are numbered once, so that rounds move numbers."""
    links = materialise(links.where("u is not null and v is not null and u <> v").distinct(), "links")
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    nodes = materialise(ends.withColumn("id", F.monotonically_increasing_id()), "nodes")
    number = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    edges = links.join(number("u"), "u").join(number("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    stars = components(edges)
    roots = materialise(stars.withColumnRenamed("node", "id"), "roots")
    discard(links, stars)
    return owning(nodes.join(roots, "id").select("node", "root"), nodes, roots)


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``pages``: ``page_id, url, html``; ``redirects``, if given: ``from_url, to_url``, as a crawler logged them. Other
    columns, whatever their names, play no part. A rule that fits decides. Otherwise the url is blocked if an alias of
    it, on a page or only linked to, is blocked by a rule and none is allowed by one; all else is allowed. Null urls and
    urls without ``://`` have an empty host and path, fit no rule and are allowed, unless the url is an alias. Null html
    has no links. Rules fit a page's url as it is written, and an alias in its normal form. Repeated rows are judged
    alike; an empty table gives an empty result.

    Links are extracted where the page lies; only they and, of pages, the narrow columns are shuffled. What is known of a
    component, and which urls are blocked, is written before it is joined, so that hot ones are split.
    """
    links = alias_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    found = url_components(links)
    rooted = materialise(found, "rooted")
    discard(found)
    decided = rooted.select("root", verdict_of(rule_of(host_of(F.col("node")), path_of(F.col("node")), rules), rules).alias("verdict"))
    blocked = decided.groupBy("root").agg(F.bool_or(F.col("verdict") == "block").alias("block"), F.bool_or(F.col("verdict") == "allow").alias("allow"))
    blocked = materialise(blocked.where("block and allow is not true").select("root"), "blocked")
    aliases = rooted.join(blocked, "root", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    aliases = materialise(aliases, "aliases")
    discard(rooted, blocked)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", node_of(F.col("url")).alias("_url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    joined = judged.join(aliases, F.col("_url") == F.col("_node"), "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return owning(joined.select("page_id", "host", "path", "rule", verdict.alias("verdict")), aliases)


def filter_urls_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """DuckDB SQL of ``filter_urls`` over ``pages``: verdicts of rules spread along the links, both ways."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda url, i: f"regexp_extract({url}, {q(ABSOLUTE)}, {i})"

    def rule(host: str, path: str) -> str:
        cases = []
        for name, _ in sorted(rules, key=lambda r: -len(r[0])):
            h, slash, rest = name.partition("/")
            cases.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{slash + rest}') THEN '{name}'")
        return f"CASE {' '.join(cases)} END"

    def verdict(of: str) -> str:
        cases = [f"WHEN {of} = '{name}' THEN '{said}'" for name, said in rules]
        return f"CASE {' '.join(cases)} END"

    def noded(name: str, source: str, url: str, out: str) -> str:
        """Tables that end in ``source`` with the normal form of a url."""
        kept = """list_reduce(list_transform(seg[2:], lambda x: [x]), lambda seen, x: CASE WHEN x[1] = '.' THEN seen
          WHEN x[1] = '..' THEN seen[1:len(seen) - 1] ELSE list_concat(seen, x) END, CAST([] AS VARCHAR[]))"""
        return f"""{name}_parts AS (SELECT *, {lower(part(url, 1))} AS sch, {lower(part(url, 3))} AS hst, {part(url, 4)} AS pth, string_split({part(url, 4)}, '/') AS seg FROM {source}),
{name}_clean AS (SELECT *, CASE WHEN pth = '' THEN '/' WHEN regexp_matches(pth, {q(DOTS)})
    THEN '/' || array_to_string(CASE WHEN seg[-1] IN ('.', '..') THEN list_concat({kept}, ['']) ELSE {kept} END, '/') ELSE pth END AS pth2,
  CASE sch WHEN 'http' THEN regexp_replace(hst, ':(80)?$', '') WHEN 'https' THEN regexp_replace(hst, ':(443)?$', '') ELSE hst END AS hst2 FROM {name}_parts),
{name} AS (SELECT * EXCLUDE (sch, hst, pth, seg, pth2, hst2),
  CASE WHEN {part(url, 0)} <> '' THEN sch || '://' || {part(url, 2)} || hst2 || pth2 || {part(url, 5)} ELSE regexp_extract({url}, '^[^#]*') END AS {out} FROM {name}_clean)"""

    def aimed(name: str, source: str, base: str, to: str, out: str) -> str:
        """Tables that end in ``source`` with the node of a link's target."""
        for ref, char in REFERENCES:
            to = f"replace({to}, '{ref}', '{char}')"
        return f"""{name}_own AS (SELECT *, regexp_extract({to}, '^[^#]*') AS own, regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS org, {part(base, 4)} AS bpath FROM {source}),
{name}_abs AS (SELECT * EXCLUDE (own, org, bpath), CASE WHEN own = '' THEN {base}
  WHEN regexp_matches(own, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(own, {q(ABSOLUTE)}) THEN own END
  WHEN org = '' THEN NULL WHEN starts_with(own, '//') THEN regexp_extract({base}, '^[^:]*:') || own WHEN starts_with(own, '/') THEN org || own
  WHEN starts_with(own, '?') THEN org || bpath || own ELSE org || regexp_extract(bpath, '^(?s:.)*/') || own END AS abs_url FROM {name}_own),
{noded(name, f"{name}_abs", "abs_url", out)}"""

    first = lambda tag, to: f"regexp_extract(regexp_extract(body, {q(tag)}), {q(to)}, 1)"
    host = lambda u: "coalesce(" + lower(rf"regexp_extract({u}, '^(?s:.)*?://([^/?#]*)', 1)") + ", '')"
    path = lambda u: rf"coalesce(regexp_extract({u}, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '')"
    return rf"""
WITH RECURSIVE {noded("urls", "pages", "url", "u")},
linked AS (SELECT u, regexp_replace(html, {q(NO_LINKS)}, '', 'g') AS body FROM urls WHERE url IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
tags AS (SELECT u, {first(BASE, HREF)} AS b, unnest([{first(LINK, HREF)}, {first(REFRESH, REFRESH_URL)}]) AS t FROM linked),
{aimed("based", "tags", "u", "b", "base_url")},
told AS (SELECT u, t, CASE WHEN b = '' THEN u ELSE coalesce(base_url, u) END AS base FROM based WHERE t <> ''),
{aimed("aims", "told", "base", "t", "v")},
e AS MATERIALIZED (SELECT u, v FROM aims WHERE u <> v UNION SELECT v, u FROM aims WHERE u <> v
), ruled AS (SELECT a, {verdict("r")} AS said FROM (SELECT a, {rule("h", "p")} AS r FROM (SELECT a, {host("a")} AS h, {path("a")} AS p FROM (SELECT DISTINCT u AS a FROM e)))
), marks(a, said) AS (SELECT a, said FROM ruled WHERE said IS NOT NULL UNION SELECT e.v, marks.said FROM marks JOIN e ON marks.a = e.u
), blocked AS (SELECT a FROM marks GROUP BY a HAVING bool_or(said = 'block') AND NOT bool_or(said = 'allow')
), judged AS (SELECT page_id, u, host, path, {rule("host", "path")} AS rule FROM (SELECT page_id, u, {host("url")} AS host, {path("url")} AS path FROM urls))
SELECT page_id, host, path, rule, coalesce({verdict("rule")}, CASE WHEN blocked.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN blocked ON judged.u = blocked.a"""
