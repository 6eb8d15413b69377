"""URL filters with redirect equivalence (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import Scratch
from basalt.llm.components import connected_components

#: Rules up to which they are compiled into one expression; longer lists are joined.
COMPILED = 100

Rule = tuple[str, str]  # (allow or block, host/path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match(rows: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """`rows` with columns rule and rule_verdict more: of the rules whose host is the row's or a parent
    domain of it, and whose path the row's starts with, the longest; null if none fits. Of rules that
    differ in the verdict only, allow wins."""
    split = [(verdict, r, r.partition("/")[0], "/" + r.partition("/")[2]) for verdict, r in rules]
    none = F.lit(None).cast("struct<n:int,verdict:string,rule:string>")
    rank = lambda verdict, r: F.struct(F.length(r).alias("n"), F.when(verdict == "allow", "b").otherwise("a").alias("verdict"), r.alias("rule"))
    if len(split) <= COMPILED:
        best = none
        for verdict, r, h, p in split:
            fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
            one = F.when(fits, rank(F.lit(verdict), F.lit(r)))
            best = F.greatest(best, one)
        out = rows.withColumn("__best", best)
    else:
        listed = rows.sparkSession.createDataFrame(split, "__verdict string, __rule string, __host string, __path string")
        labels = F.split(host, r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        hosts = rows.select(host, path).distinct().withColumn("__host", F.explode(suffixes))
        hit = hosts.join(listed, "__host").filter(F.col(path).startswith(F.col("__path")))
        hit = hit.groupBy(host, path).agg(F.max(rank(F.col("__verdict"), F.col("__rule"))).alias("__best"))
        out = rows.join(hit, [host, path], "left")
    verdict = F.when(F.col("__best.verdict") == "b", "allow").when(F.col("__best.verdict") == "a", "block")
    return out.select("*", F.col("__best.rule").alias("rule"), verdict.alias("rule_verdict")).drop("__best")


def node(url: Column) -> Column:
    """What stands for a URL in the alias graph: without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, "#.*", "")
    head = F.regexp_extract(bare, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def resolve(ref: Column, base: Column) -> Column:
    """A reference in a page at `base`, as a URL."""
    scheme = F.regexp_extract(base, r"\A([^:/?#]+):", 1)
    root = F.regexp_extract(base, r"\A([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"\A([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    ref = F.replace(F.trim(ref), F.lit("&amp;"), F.lit("&"))
    found = F.when(ref.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), ref).when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
    found = found.when(ref.startswith("/"), F.concat(root, ref))
    return found.when(~ref.rlike(r"\A([#?]|\Z|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), ref))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): edges from pages to what their canonical link or refresh redirect names."""
    h = F.col("html")
    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).filter(h.ilike("%canonical%") | h.ilike("%refresh%"))
    some = some.withColumn("html", F.regexp_replace(h, r"(?is)<!--.*?-->|<script\b.*?</script>", ""))
    canonical = F.transform(
        F.regexp_extract_all(h, F.lit(r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)"""), F.lit(1)),
        lambda tag: F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    refresh = F.transform(
        F.regexp_extract_all(h, F.lit(r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)"""), F.lit(1)),
        lambda tag: F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    refs = some.select("url", F.explode(F.concat(canonical, refresh)).alias("ref"))
    return refs.select(node(F.col("url")).alias("src"), node(resolve(F.col("ref"), F.col("url"))).alias("dst")).dropna()


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`.

    A URL with a rule gets the rule's verdict, so an explicit allow holds against all aliases. One
    without is blocked if any URL of its component is blocked by a rule, and else allowed. Components
    are those of canonical links and refresh redirects in the pages and of `redirects` (src, dst), over
    URLs without fragments; URLs that have no page link and carry verdicts too.

    A null or odd URL has empty host and path and no aliases: allowed. Null html has no links. Rows with
    null ids and repeated rows are returned as given; an empty table gives no rows; other columns are
    ignored. Pages of a hot host don't meet anywhere: only URLs with links are joined, by URL."""
    scratch = Scratch(pages.sparkSession)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = match(rows, rules).withColumn("node", node(F.col("url")))
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("src")), node(F.col("dst"))).dropna())
    members = connected_components(edges, scratch)
    host, path = parts(F.col("node"))
    ruled = match(members.select("node", "component", host.alias("host"), path.alias("path")), rules)
    bad = ruled.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "block").alias("bad")).filter("bad")
    bad = scratch.keep(members.join(bad, "component").select("node", "bad"))
    # Rows that have a rule needn't know; of others, copies of one URL may be many, so salt them.
    need, rest = rows.filter("rule is null and node is not null"), rows.filter("rule is not null or node is null")
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    need = need.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int")).join(salted, ["node", "salt"], "left")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    need = need.select("page_id", "host", "path", "rule", own.alias("verdict"))
    return need.unionByName(rest.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict")))
