"""URL filters whose block decisions reach the aliases of a URL.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides. URLs joined by redirect or
canonical links are aliases: distributed connected components carry a block to every alias that has no rule of
its own. An explicit allow keeps its URL, whatever its aliases.
"""

import re
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F

from turnlab.llm.common import cut, small_batches
from turnlab.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"

def lowered(column):
    """A-Z in lower case; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url):
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or url."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url):
    """What follows the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url):
    """A URL without fragment, scheme and host in lower case: what redirects and canonical links name."""
    head = lowered(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1))
    return F.when(url.contains("://"), F.concat(head, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def rule_table(spark, rules):
    """(host, path, rule, verdict) of rules given as (verdict, host, path)."""
    rows = [(lowered_text(h), p, f"{h}{p}", v) for v, h, p in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string")


def lowered_text(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def judged(rows, rules):
    """``rows`` (with __host and __path) and the rule and verdict of the longest rule that fits, or null.

    Rules meet distinct hosts only: each host is cut into its own name and the domains above it.
    """
    parts = F.split("__host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)),
                          lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = (rows.select("__host").distinct().select("__host", F.explode(domains).alias("host")).join(rules, "host")
               .groupBy(F.col("__host").alias("__of")).agg(F.reverse(F.array_sort(F.collect_list(
                   F.struct(F.length("rule").alias("size"), "rule", "path", "verdict")))).alias("__rules")))
    fitting = cut(fitting, "host-rules")  # so that its size is known when it is joined
    first = F.get(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"])), F.lit(0))
    return (rows.join(fitting, F.col("__host") == F.col("__of"), "left").withColumn("__first", first)
            .withColumn("rule", F.col("__first.rule")).withColumn("ruled", F.col("__first.verdict"))
            .drop("__of", "__rules", "__first"))


_TAG = re.compile(r"""<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*>""", re.I)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_MOVED = re.compile(r"""\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", re.I)


def link_targets(html):
    """What the canonical links and refresh instructions of a page name, in page order."""
    for tag in _TAG.findall(html):
        known = {k.lower(): unescape(a or b or c).strip() for k, a, b, c in _ATTRIBUTE.findall(tag)}
        if "canonical" in known.get("rel", "").lower().split():
            yield known.get("href", "")
        elif known.get("http-equiv", "").lower() == "refresh":
            moved = _MOVED.match(known.get("content", ""))
            yield moved.group(1).strip() if moved else ""


def page_links(pages, url="url", html="html"):
    """(a, b): the canonical and refresh links of pages, as nodes. Targets are resolved against the page's URL."""
    small_batches(pages.sparkSession)

    def run(batches):
        for part in batches:
            out = []
            for source, page in zip(part["url"], part["html"]):
                for target in link_targets(page):
                    try:
                        out.append((source, urljoin(source, target)))
                    except ValueError:  # no URL, so no link
                        continue
            yield pd.DataFrame(out, columns=["source", "target"])

    found = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(
        F.col("url").contains("://") & F.lower("html").rlike("canonical|http-equiv"))
    links = found.mapInPandas(run, "source string, target string")
    return links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"))


def filter_urls(pages, rules, page_id="page_id", url="url", html="html", redirects=None):
    """One row per page: page_id, host, path, rule (or null) and verdict.

    ``rules`` are (verdict, host, path); ``redirects`` is a table of further links (source, target). A page without
    a rule is blocked if an alias, itself a page or not, is blocked by a rule; otherwise it is allowed. A null url or
    one without :// has an empty host and path and no aliases. Repeated pages each get a row, an empty table
    gives none; other columns are not read.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("source")), node_of(F.col("target"))))
    members = cut(connected_components(links), "aliases")
    own = judged(members.select("node", "component", host_of("node").alias("__host"), path_of("node").alias("__path")),
                 table)
    blocked = (own.groupBy("component").agg(F.max(F.col("ruled") == BLOCK).alias("blocked")).where("blocked")
               .join(members, "component").select(F.col("node").alias("__node")).distinct())
    rows = judged(pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("__host"), path_of(url).alias("__path"),
                               node_of(F.col(url)).alias("__url")), table)
    alias = rows.join(blocked, F.col("__url") == F.col("__node"), "left")
    verdict = F.coalesce("ruled", F.when(F.col("__node").isNotNull(), BLOCK).otherwise(ALLOW))
    return alias.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), "rule",
                        verdict.alias("verdict"))


#: The contract's rules.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"),
         (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]

ORACLE = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, p, v)),
split AS (SELECT row_number() OVER () AS r, page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS n
    FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
ruled AS (SELECT split.*, rule, v, regexp_extract(url, '^[^#]*') AS node FROM split LEFT JOIN
    (SELECT * FROM fits WHERE n = 1) USING (r)),
link AS (SELECT node AS a, regexp_extract(html, '<link rel="canonical" href="([^"#]*)', 1) AS b FROM ruled
    WHERE regexp_matches(html, '<link rel="canonical" href="[^"]')),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node) AS (SELECT node FROM ruled WHERE v = 'block' UNION SELECT b FROM ways JOIN reach ON a = reach.node)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END)
    AS verdict FROM ruled
"""
