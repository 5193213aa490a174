"""URL filter (native): host and path rules, carried over redirect and canonical-link aliases.

Edge cases: a null url or one without "://" has an empty host and path, fits no rule and is allowed; a null html has no
links; repeated pages keep their rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import ascii_lower, materialise
from mnemos.llm.components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path
#: Beyond so many rules they are a table that is joined, not one expression.
MAX_INLINE_RULES = 500


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_expression(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of the rule's text and verdict; null where none fits. Of rules of one length
    the greater text holds, of equal texts a block."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """urls(host, path, ...) with rule and rule_verdict. A DataFrame of rules has verdict, host, path.

    A short list becomes one conditional expression. A long one is joined on the distinct (host, path)'s host suffixes.
    Both settle ties as rule_expression says.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_INLINE_RULES:
            hit = rule_expression(F.col("host"), F.col("path"), rules)
            return urls.withColumn("_hit", hit).withColumns({"rule": F.col("_hit.rule"), "rule_verdict": F.col("_hit.verdict")}).drop("_hit")
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    sites = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    table = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    best = (
        sites.withColumn("_h", F.explode(suffixes)).join(table, "_h").where(F.col("path").startswith(F.col("_p")))
        .groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("_h", "_p")).alias("n"), F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))).alias("_hit"))
    )
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_hit.rule"), "rule_verdict": F.col("_hit.verdict")}).drop("_hit")


def url_key(url: Column) -> Column:
    """A url without its fragment, which no server sees, with scheme and host in lower case and no dot segments."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    part = lambda k: F.regexp_extract(bare, r"^([^:/?#]+://)([^/?#@]*@)?([^/?#]*)([^?]*)(.*)", k)
    known = F.concat(ascii_lower(part(1)), part(2), ascii_lower(part(3)), _without_dots(part(4)), part(5))
    return F.when(bare.rlike(r"^[^:/?#]+://"), known).otherwise(bare)


def _without_dots(path: Column) -> Column:
    """A path that begins with "/", its segments "." and ".." resolved."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    last = F.when(path.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))).otherwise(path)


def _targets(html: Column) -> Column:
    """What the page's canonical links and refresh redirects name, as written, outside of comments."""
    head = F.coalesce(html, F.lit(""))
    head = F.when(head.contains("<!--"), F.regexp_replace(head, r"(?s)<!--.*?-->", "")).otherwise(head)
    canonical = F.regexp_extract_all(head, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?(?:[a-z]+\s+)*canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    refresh = F.regexp_extract_all(head, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""), 1)
    return F.concat(canonical, refresh)


def resolve(target: Column, page: Column) -> Column:
    """The absolute url that a target names on a page (a key). Null for a mere fragment and for a scheme without "//"."""
    scheme = F.regexp_extract(page, r"^([^:/?#]+:)//", 1)
    origin = F.regexp_extract(page, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(page, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^.*/", 0)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(origin, target)).when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def _computed(df: DataFrame, *columns: Column) -> DataFrame:
    """select, whose columns are computed there once: a projection above isn't merged with it, so what it names several times
    isn't written out, and nested, as often."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): a page and the address that it redirects to or calls canonical, relative ones resolved against the page."""
    found = pages.where(F.col(url).rlike(r"^[^:/?#]+://")).select(F.col(url).alias("_page"), F.explode(_targets(F.col(html))).alias("_target"))
    named = _computed(found, url_key(F.col("_page")).alias("src"), F.col("_target").alias("_target"))
    aimed = _computed(named, F.col("src").alias("src"), resolve(F.col("_target"), F.col("src")).alias("_to"))
    keyed = _computed(aimed, F.col("src").alias("src"), url_key(F.col("_to")).alias("dst"))
    return keyed.where("dst is not null and dst != '' and src != dst").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, edges: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    A rule of the url's own decides. Else the url takes the decision of its aliases, the connected component over
    redirect and canonical-link edges: allow if any alias is allowed by a rule, else block if any is blocked, else
    `default`. edges (src, dst) adds to or, without an html column, stands for the links read from the pages.
    """
    links = alias_edges(pages, url, html) if html in pages.columns else None
    if edges is not None:
        given = edges.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst"))
        links = given if links is None else links.union(given)
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    judged = match_rules(named, rules)
    verdict = F.col("rule_verdict")
    if links is not None:
        links = materialise(links, "url-links")
        if not links.isEmpty():
            members = connected_components(links)
            nodes = members.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
            own = match_rules(nodes, rules)
            spread = own.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("_allow"), F.max(F.col("rule_verdict") == "block").alias("_block"))
            heard = materialise(
                members.join(spread.where("_allow or _block"), "component").select(F.col("node").alias("_key"), F.when(F.col("_allow"), "allow").otherwise("block").alias("_heard")), "url-heard"
            )
            judged = judged.withColumn("_key", url_key(F.col("_url"))).join(heard, "_key", "left")
            verdict = F.coalesce(verdict, F.col("_heard"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit(default)).alias("verdict"))
