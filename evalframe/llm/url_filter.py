"""URL filters (operator 2) with redirect equivalence.

Rules of host and path decide where they fit. Elsewhere a url takes over the
decision of its aliases: the connected component over redirect and
canonical-link edges. If a url of the component is allowed by a rule, allow
takes precedence; else, if one is blocked by a rule, it is blocked; else it is
allowed. Everything is DataFrame expressions; see ``components`` for the graph.

Edges are what pages say (canonical links and refresh redirects in their html),
what servers redirect (spellings of one address: scheme, default port, ``www.``
or ``m.``, a slash, ``index.html`` or ``.html`` at the end, tracking parameters,
fragment), and what a canonical link would say of mirrors: pages that carry the
same whole article. The last two go through a node for the address or article,
so many aliases are a star, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.components import components

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Then up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits: by host, then path. Null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones come first in the CASE
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _node(url: Column) -> Column:
    """A url as a node: without fragment (servers do not see it), with the host in lower case."""
    return F.when(url.contains("://"), F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def _absolute(href: Column, base: Column) -> Column:
    """A link's target as an absolute url."""
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(href == "", F.lit(None))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), href))
    )


_QUOTED = r"""\s*=\s*["']?([^"'\s>]+)"""


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of each page's url and its canonical link or refresh redirect, from its whole html."""
    link = F.regexp_extract("html", r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref""" + _QUOTED, 1)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    found = pages.where("url is not null and html is not null").select("url", F.explode(F.array(link, refresh)).alias("href"))
    return found.where("href <> ''").select(_node(F.col("url")).alias("a"), _node(_absolute(F.col("href"), F.col("url"))).alias("b"))


_HTTP = "(?s)^https?://.*"
_PORT, _PREFIX, _END, _TRACKING = ":(80|443)?$", r"^(www|m)\.", r"(/index\.html?|\.html?|/)$", "^(utm_|ref=|fbclid=|gclid=)"


def canonical(url: Column) -> Column:
    """The address of which a url is a spelling; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), _PORT, ""), _PREFIX, "")
    path = F.regexp_replace(path_of(url), _END, "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)), "&")
    scheme = F.when(url.rlike(_HTTP), F.lit("https://")).otherwise(F.regexp_extract(url, r"(?s)^(.*?://)", 1))
    return F.when(url.contains("://"), F.concat(scheme, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of each page's url and the node of its address, and that of its article, where another url has the same."""
    article = F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    mirror = F.when(F.trim(article) != "", F.concat(F.lit("article "), F.sha2(article, 256)))
    keys = pages.where(F.col("url").contains("://")).select(_node(F.col("url")).alias("a"), F.explode(F.array(canonical(F.col("url")), mirror)).alias("b"))
    keys = keys.where("b is not null")
    shared = keys.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("b")
    return keys.join(shared, "b").select("a", "b").where("a <> b")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Host, path, fitting rule and verdict of every page.

    ``redirects`` (``from_url``, ``to_url``), if given, adds edges to those of the pages. A null
    url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is allowed.
    Repeated rows are judged alike; an empty table gives an empty result; extra columns are not returned.
    """
    edges = link_edges(pages).unionByName(alias_edges(pages))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("from_url")).alias("a"), _node(F.col("to_url")).alias("b")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"), _node(F.col("url")).alias("node"))
    name, verdict = _fitting(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": name, "own": verdict})
    alias = components(edges)
    # any url of the graph counts, whether it is a page or only a link's target
    rank = F.when(_fitting(host_of(F.col("node")), path_of(F.col("node")), rules)[1] == "allow", 2).when(_fitting(host_of(F.col("node")), path_of(F.col("node")), rules)[1] == "block", 1).otherwise(0)
    decided = alias.groupBy("component").agg(F.max(rank).alias("rank"))
    by_node = alias.join(decided, "component").select("node", "rank")
    out = urls.join(by_node, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("rank") == 1, "block").otherwise("allow")).alias("verdict"))


def oracle_sql() -> str:
    """The same in DuckDB SQL for absolute link targets, with reachability instead of components."""
    def host(u: str) -> str:
        return f"translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"

    def node(u: str) -> str:
        return f"CASE WHEN {u} LIKE '%://%' THEN regexp_extract({u}, '^(.*?://)', 1, 's') || {host(u)} || regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"

    def rule(what: int) -> str:
        whens = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, k)[what]}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
        return f"CASE {' '.join(whens)} END"

    path = "regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    link = """regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')"""
    meta = """regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), '\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1, 'is')"""
    query = "list_filter(string_split(regexp_extract({u}, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '" + _TRACKING + "'))"
    plain = f"regexp_replace(regexp_replace({host('{u}')}, '{_PORT}', ''), '{_PREFIX}', '') || regexp_replace({path}, '{_END}', '')"
    address = f"CASE WHEN {{u}} LIKE '%://%' THEN CASE WHEN {{u}} LIKE 'http://%' OR {{u}} LIKE 'https://%' THEN 'https://' ELSE regexp_extract({{u}}, '^(.*?://)', 1, 's') END || {plain} || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END END"
    article = "regexp_extract(html, '<article\\b[^>]*>(.*?)</article>', 1, 'is')"
    return f"""
WITH RECURSIVE found AS (SELECT url, unnest([{link}, {meta}]) AS href FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
keys AS (SELECT {node('url')} AS a, unnest([{address.replace('{u}', 'url')}, CASE WHEN trim({article}, ' ') <> '' THEN 'article ' || sha256({article}) END]) AS b FROM pages WHERE url LIKE '%://%'),
edges AS (SELECT {node('url')} AS a, {node("replace(href, '&amp;', '&')")} AS b FROM found WHERE href LIKE '%://%'
          UNION SELECT a, b FROM keys WHERE b IN (SELECT b FROM keys GROUP BY b HAVING min(a) <> max(a)) AND a <> b),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
parts AS (SELECT a AS node, {host('b')} AS host, {path.format(u='b')} AS path FROM reach),
decided AS (SELECT node, max(CASE {rule(1)} WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS rank FROM parts GROUP BY node),
urls AS (SELECT page_id, {node('url')} AS node, coalesce({host('url')}, '') AS host, coalesce({path.format(u='url')}, '') AS path FROM pages)
SELECT page_id, host, path, {rule(0)} AS rule,
       coalesce({rule(1)}, CASE WHEN rank = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN decided USING (node)
"""
