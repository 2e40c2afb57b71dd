"""URL filters with redirect equivalence.

Rules judge a url by its host and path.  Where no rule fits, the verdict comes from aliases: urls joined by canonical links or
redirects (all of those in the page's markup, or given as a table), after dropping what does not change the page (scheme, ``www.`` and ``m.``,
fragment, tracking parameters, a final slash or ``.html``).  Connected components over these edges carry decisions: an
explicitly allowed alias makes its component allowed, else a blocked one makes it blocked.  Without either a url is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import connected_components

# Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "utm_[a-z]*|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first by text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def alias_key(url: Column) -> Column:
    """What urls of one page share; null where there is no host."""
    host = F.regexp_replace(host_of(url), r"\A(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)\z", "")
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(rf"\A({TRACKING})=")))), "&")
    return F.when(host != "", F.concat(host, path, F.lit("?"), kept))


def markup_targets(html: Column) -> Column:
    """The urls of all canonical links and refreshes of a page, as written."""
    tag = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""
    found = F.concat(F.regexp_extract_all(html, F.lit(tag), F.lit(1)), F.regexp_extract_all(html, F.lit(refresh), F.lit(1)))
    return F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def base_of(html: Column, url: Column) -> Column:
    """What relative targets of a page start from: its first ``<base href>``, else its url."""
    base = F.regexp_extract(html, r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.when(base != "", absolute(F.replace(base, F.lit("&amp;"), F.lit("&")), url)).otherwise(url)


def absolute(target: Column, base: Column) -> Column:
    """A target completed from an absolute url, dot segments resolved; null for other schemes (``mailto:``)."""
    own, rest = F.regexp_extract(target, r"(?s)\A[^?#]*", 0), F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1)
    folder = F.regexp_extract(F.concat(path_of(base), F.when(path_of(base) == "", "/").otherwise("")), r"(?s)\A.*/", 0)
    path = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    # a final . or .. names a folder; the first part is empty, as the path starts with /
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)\z", "$1/"), "/")
    plain = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step), "/")
    place = F.concat(F.lit("http://"), host_of(base))
    return (
        F.when(F.rlike(target, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.rlike(target, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("?")), F.concat(place, path_of(base), target))
        .when(F.startswith(target, F.lit("#")), base)
        .when(host_of(base) != "", F.concat(place, F.when(F.contains(path, F.lit("/.")), plain).otherwise(path), rest))
    )


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    ``redirects`` (source, target) adds edges to those of the markup.  A null url or one without ``://`` has an empty host and
    path, fits no rule, has no aliases and is allowed.  Repeated rows are judged alike.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), alias_key(F.col("url")).alias("alias"))
    placed = placed.withColumn("rule", rule).withColumn("own", verdict)
    tagged = pages.where(F.rlike("html", F.lit("(?i)canonical|refresh")))
    tagged = tagged.select("url", base_of(F.col("html"), F.col("url")).alias("base"), F.explode(markup_targets(F.col("html"))).alias("target"))
    edges = tagged.select(alias_key(F.col("url")).alias("a"), alias_key(absolute(F.col("target"), F.col("base"))).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")))
    groups = connected_components(edges.where("a is not null and b is not null")).withColumnRenamed("node", "alias")
    placed = placed.join(groups, "alias", "left").withColumn("component", F.coalesce("component", "alias"))
    decided = (
        placed.where("own is not null and component is not null")
        .groupBy("component")
        .agg(F.when(F.max(F.col("own") == "allow"), F.lit("allow")).otherwise(F.lit("block")).alias("shared"))
    )
    return placed.join(decided, "component", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict")
    )


def oracle_sql(rules: tuple[tuple[str, str, str], ...] = RULES) -> str:
    """The same over ``pages`` in plain SQL; components by a recursive walk of the edges."""

    def host(u: str) -> str:
        return f"translate(coalesce(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"

    def alias(u: str) -> str:
        parts = f"string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&')"
        kept = f"array_to_string(list_sort([x for x in {parts} if x <> '' and not regexp_matches(x, '^({TRACKING})=')]), '&')"
        h = f"regexp_replace({host(u)}, '^(www|m)\\.', '')"
        return f"case when {h} <> '' then {h} || regexp_replace({path(u)}, '(/|\\.html)$', '') || '?' || {kept} end"

    fits = {
        own + start: f"((host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '{start}'))" for _, own, start in rules
    }
    longest = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    rule = " ".join(f"when {fits[o + s]} then '{o + s}'" for _, o, s in longest)
    own = " ".join(f"when {fits[o + s]} then '{w}'" for w, o, s in longest)
    link = "regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>'), '(?i)href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    meta = "regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>'), '(?i)url\\s*=\\s*[\"'']?([^\"''\\s>;]+)', 1)"
    return f"""
        with recursive p as (
            select page_id, url, {host("url")} as host, {path("url")} as path, {alias("url")} as alias,
                   replace(coalesce(nullif({link}, ''), nullif({meta}, '')), '&amp;', '&') as target from pages),
        r as (select *, case {rule} end as rule, case {own} end as own,
                     case when contains(target, '://') then target when starts_with(target, '//') then 'http:' || target
                          when starts_with(target, '/') then 'http://' || host || target end as goal from p),
        e as (select alias as a, {alias("goal")} as b from r where goal is not null),
        both_ways as (select a, b from e where a is not null and b is not null union select b, a from e where a is not null and b is not null),
        walk(node, seen) as (select a, a from both_ways union select w.node, b.b from walk w join both_ways b on b.a = w.seen),
        c as (select node, min(seen) as component from walk group by node),
        g as (select r.*, coalesce(c.component, r.alias) as component from r left join c on c.node = r.alias),
        d as (select component, case when bool_or(own = 'allow') then 'allow' else 'block' end as shared
              from g where own is not null and component is not null group by component)
        select page_id, host, path, rule, coalesce(own, shared, 'allow') as verdict from g left join d using (component)"""
