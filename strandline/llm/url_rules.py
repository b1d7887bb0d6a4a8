"""URL filters with redirect equivalence, DataFrame functions only.

Rules (action, host, path) fit a host and its subdomains where the url's path starts with the rule's; the longest wins,
of equally long ones an allow. Urls are nodes by their key (no scheme, `www.`, fragment, utm_ parameters or closing
slash). Redirects (`<meta http-equiv=refresh>`, or a table) and canonical links of the pages are edges; components are
aliases of each other. A url without a rule of its own takes its component's decision: allow if any alias has an allow
rule (explicit allows precede), else block if any has a block rule, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stage
from strandline.llm.components import components

#: Fixed values of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer rule lists are joined by host suffix; shorter ones are an expression of each row.
INLINE_RULES = 200
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """The node's name; null for what is no url."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.startswith("utm_") & (x != "")), "&")
    name = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(_rest(url).isNotNull(), F.concat(name, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def match_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (host, path, ...) with rule and action of the rule that wins; null where none fits."""
    if len(rules) <= INLINE_RULES:
        fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(a == "allow").alias("allow"), F.lit(h + p).alias("rule"))) for a, h, p in rules]
        best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
        return df.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "action": F.when(F.col("_best.allow"), "allow").when(F.col("_best").isNotNull(), "block")}).drop("_best")
    table = df.sparkSession.createDataFrame(rules, "_a string, _h string, _p string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    urls = df.select("host", "path").distinct()
    fit = urls.withColumn("_h", F.explode(suffixes)).join(table, "_h").where(F.col("path").startswith(F.col("_p")))
    one = F.max(F.struct(F.length(F.concat("_h", "_p")).alias("size"), (F.col("_a") == "allow").alias("allow"), F.concat("_h", "_p").alias("rule"))).alias("_best")
    return df.join(fit.groupBy("host", "path").agg(one), ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "action": F.when(F.col("_best.allow"), "allow").when(F.col("_best").isNotNull(), "block")}).drop("_best")


def resolved(url: Column, to: Column) -> Column:
    """to as an absolute url, read from the page's url where it is relative; dot segments are worked off."""
    head, path = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1), path_of(url)
    own = F.regexp_extract(to, r"^([^?#]*)", 1)
    full = F.when(to.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), own))
    step = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when((x == ".") | (x == ""), a).otherwise(F.concat(a, F.lit("/"), x))
    flat = F.aggregate(F.split(full, "/"), F.lit(""), step)
    rest = F.substring(to, F.length(own) + 1, F.length(to))
    local = F.when(to.startswith("?"), F.concat(head, path, to)).when(to.startswith("#"), url).otherwise(F.concat(head, flat, rest))
    return F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to).when(to.startswith("//"), F.concat(F.regexp_extract(url, "^([^:/?#]*:)", 1), to)).when(head != "", local)


def page_edges(pages: DataFrame) -> DataFrame:
    """(url, to) of all canonical links and refreshes in html, relative ones resolved."""
    each = [F.coalesce(F.regexp_extract_all("html", F.lit(x), F.lit(1)), F.array().cast("array<string>")) for x in (CANONICAL, REFRESH)]
    found = pages.select("url", F.explode(F.concat(*each)).alias("to")).where((F.col("to") != "") & F.col("url").isNotNull())
    return found.select("url", resolved(F.col("url"), F.regexp_replace("to", "&amp;", "&")).alias("to")).where("to IS NOT NULL")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    redirects: more edges (url, to). Null urls and such without `://` have empty host and path, no aliases and no rule
    unless one fits the empty host: they are allowed. Repeated rows are judged alike; an empty table gives no row; null
    html has no edges; edges to what is no url are left out; other columns are left out."""
    base = pages.select(F.col("page_id"), F.col("url").cast("string"))
    edges = page_edges(pages.select(F.col("url").cast("string"), F.col("html").cast("string")))
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("url").cast("string"), F.col("to").cast("string")))
    edges = stage(edges, "url-edges")
    node = F.xxhash64(key_of(F.col("url")))
    named = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(key_of(F.col("url")).isNotNull(), node).alias("node"))
    judged = match_rules(named, rules)
    ends = edges.select(F.explode(F.array("url", "to")).alias("url")).where(key_of(F.col("url")).isNotNull())
    ends = match_rules(ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node.alias("node")), rules)
    pairs = edges.where(key_of(F.col("url")).isNotNull() & key_of(F.col("to")).isNotNull()).select(node.alias("a"), F.xxhash64(key_of(F.col("to"))).alias("b"))
    tree = stage(components(pairs), "url-tree")
    said = judged.select("node", "action").union(ends.select("node", "action")).where("node IS NOT NULL AND action IS NOT NULL").distinct()
    of = said.join(tree, "node", "left").select(F.coalesce("component", "node").alias("component"), "action")
    decided = of.groupBy("component").agg(F.min("action").alias("decision"))  # allow sorts before block
    spread = decided.join(tree, "component").select("node", "decision").union(decided.select(F.col("component").alias("node"), "decision")).distinct()
    open_ = judged.where("action IS NULL").join(stage(spread, "url-decisions"), "node", "left")
    verdict = F.coalesce("action", "decision", F.lit("allow")).alias("verdict")
    ruled = judged.where("action IS NOT NULL").withColumn("decision", F.lit(None).cast("string"))
    columns = ["page_id", "host", "path", "rule", "action", "decision"]
    return ruled.select(*columns).union(open_.select(*columns)).select("page_id", "host", "path", "rule", verdict)
