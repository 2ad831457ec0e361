"""URL verdicts with redirect equivalence (operator 7).

Rules name a host and a path; the longest that fits an url decides it. Pages
that redirect to one another or name one canonical address are one page under
several names: distributed connected components over those edges carry a block
to every alias that no rule decides, unless a rule allows a member of the same
set: an explicit allow goes before a propagated block.

Defined results: a null url, or one without `://`, has empty host and path, no
rule and no edges, and is allowed; rows that repeat are each judged; null html
has no edges; every canonical link and refresh of a page is an edge, and relative
addresses are resolved against the page's. Only the columns named are read. The rules are a short list that
becomes one expression; nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.graph import connected_components
from granary.plans.staging import stage

# The rules of the query, as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: A page's address in its canonical link or its refresh header.
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>;]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?` or `#`, with A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?` or `#`."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): addresses that pages say are the same, without fragments and without self-links."""
    html = F.coalesce("html", F.lit(""))
    said = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (_LINK, _REFRESH)))
    out = pages.select(address(F.col("url")).alias("src"), F.explode(F.array_distinct(said)).alias("to")).where("src is not null")
    there = F.trim(F.replace(F.col("to"), F.lit("&amp;"), F.lit("&")))
    return out.select("src", address(resolved(there, F.col("src"))).alias("dst")).where("dst is not null and src <> dst")


def resolved(link: Column, page: Column) -> Column:
    """The full address that a link on a page means; null where it has another scheme than a web page's, or is empty."""
    base = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    steps = F.split(F.concat(folder, F.regexp_extract(link, r"(?s)^([^?#]*)", 1)), "/")
    # A last step that only moves ends in the folder it names.
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)

    def walk(done: Column, step: Column) -> Column:
        back = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(step == "..", back).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    walked = F.array_join(F.aggregate(F.slice(steps, 2, F.size(steps)), F.slice(steps, 1, 1), walk), "/")
    relative = F.concat(base, walked, F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1))
    return (
        F.when((link == "") | link.startswith("#"), None).when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, r"(?s)^(.*?):", 1), F.lit(":"), link))
        .when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .otherwise(relative)
    )


def address(url: Column) -> Column:
    """The name under which an url is one node: lower-case scheme and host, its path and query, no fragment; null where there is none."""
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def url_verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    edges: further (src, dst) redirects between urls, beside what the pages say.
    """
    judged = pages.select("page_id", "url", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"), "html")
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", address(F.col("url")))
    links = page_edges(pages)
    if edges is not None:
        links = links.union(edges.select(address(F.col("src")), address(F.col("dst"))))
    sets = stage(connected_components(stage(links.distinct(), "links")), "aliases")
    nodes = sets.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    ruled = nodes.groupBy("component").agg(F.max(F.col("own.verdict") == "block").alias("blocked"), F.max(F.col("own.verdict") == "allow").alias("allowed"))
    spread = stage(ruled.where("blocked and not coalesce(allowed, false)").select("component"), "blocked-sets")
    aliases = sets.join(spread, "component").select("node", F.lit(True).alias("alias_blocked"))
    out = judged.drop("html").join(aliases, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
