"""URL filters: fixed host and path rules, then link-graph propagation for what no rule decides.

Host edges come from the pages' links. Trust flows from hosts of allowed pages along links, distrust from hosts
of blocked pages against them (who links to a blocked host is suspect), and general weight from all pages along
links: three personalised PageRanks in one table. A host is blocked if its distrust exceeds its trust and at
least `threshold` of its general weight. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from .common import ascii_lower, beside, column, cut

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, THRESHOLD = 0.85, 0.5
#: Propagation ends when no host's mass moves by more than this in a few steps; the bound lies past that for any seed mass under 1e7.
TOLERANCE, ROUNDS = 1e-6, 200


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or a url without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or a url without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, n): how many pages of src link to dst, each counted once however many links it has. A relative link goes to the page's own host."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""), 1)
    host = lambda x, own: F.when(x.startswith("//"), url_host(F.concat(F.lit("x:"), x))).when(x.contains("://"), url_host(x)).otherwise(own)
    each = pages.where(F.col(host_col) != "").select(F.col(host_col).alias("src"), found.alias("found"))
    each = each.select("src", F.explode_outer(let(F.col("src"), lambda own: F.array_distinct(F.transform("found", lambda x: host(x, own))))).alias("dst"))
    return each.where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, weight) of personalised PageRank, after steps until none moves by more than tolerance, `rounds` at most.

    edges: (src, dst, n). seeds: (host, trust, distrust, weight), the restart mass of each host. Trust and weight
    follow edges in proportion to n; distrust follows them backwards. Mass at a host without edges is lost.
    A host's links to itself are solved in place (Jacobi steps), so they need no steps of their own.
    Sums are rounded to 12 digits, so the order of additions does not show.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    flow = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("along"), F.lit(0.0).alias("against"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("along"), (F.col("n") / F.col("into")).alias("against"))
    both = flow.union(back)
    kept = lambda c: 1 - damping * F.coalesce(c, F.lit(0.0))
    loops = cut(both.where(F.col("host") == F.col("to")).groupBy("to").agg(F.sum("along").alias("along_self"), F.sum("against").alias("against_self")))
    share = {c: kept(F.col("against_self" if c == "distrust" else "along_self")) for c in ("trust", "distrust", "weight")}
    steps = cut(both.where(F.col("host") != F.col("to")).join(loops, "to", "left").select("host", "to", (F.col("along") * damping / share["trust"]).alias("along"), (F.col("against") * damping / share["distrust"]).alias("against")))
    names = ("trust", "distrust", "weight")
    restart = cut(seeds.join(loops.withColumnRenamed("to", "host"), "host", "left").select("host", *[(F.col(c) * (1 - damping) / share[c]).alias(c) for c in names]))
    rank = before = cut(seeds.select("host", *names))
    for k in range(rounds):
        moved = steps.join(rank, "host").select(F.col("to").alias("host"), *[(F.col(c) * F.col("against" if c == "distrust" else "along")).alias(c) for c in names])
        rank = moved.union(restart).groupBy("host").agg(*[F.round(F.sum(c), 12).alias(c) for c in names])
        if k % 3 == 2 or k == rounds - 1:
            rank = cut(rank)
            moved = rank.union(before.select("host", *[(-F.col(c)).alias(c) for c in names])).groupBy("host").agg(*[F.abs(F.sum(c)).alias(c) for c in names])
            if (moved.agg(F.max(F.greatest(*names))).first()[0] or 0.0) <= tolerance:
                break
            before = rank
    return rank


def url_filter(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of pages with host, path, rule and verdict (allow or block).

    The longest rule that fits decides. Without one, the page's host decides: block if its distrust exceeds its
    trust and is `threshold` of its weight or more, else allow; an empty host is allowed. Null urls have empty host
    and path; null html has no links. Repeated rows count as pages of their own; an empty table gives an empty
    table. Columns of pages pass through, whatever their names (result columns replace input columns of the same name).
    """
    made = ("host", "path", "rule", "verdict")
    url = F.col(url_col)
    # the caller's columns travel as one, so their names meet none of those made here
    judged = pages.select(F.struct(*[column(c) for c in beside(pages.columns, *made)]).alias("row"), url_host(url).alias("host"), url_path(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "by_rule": verdict})
    links = cut(host_edges(pages.select(url_host(url).alias("host"), F.col(html_col).alias("html"))))
    is_ = lambda v: F.sum(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(is_("allow").alias("trust"), is_("block").alias("distrust"), F.count("*").cast("double").alias("weight"))
    rank = propagate(links, cut(seeds), rounds, damping)
    bad = rank.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * F.col("weight"))).select("host", F.lit("block").alias("by_links"))
    rows = judged.join(bad, "host", "left")
    old = beside(pages.columns, *made)
    return rows.select(*[F.col("row")[c].alias(c) for c in old], "host", "path", "rule", F.coalesce("by_rule", "by_links", F.lit("allow")).alias("verdict"))


def op4_url_filter(pages: DataFrame) -> DataFrame:
    """The columns of the query: page_id, host, path, rule, verdict."""
    return url_filter(pages.select("page_id", "url", "html")).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")
