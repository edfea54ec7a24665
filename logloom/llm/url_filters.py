"""URL filters: rules by host and path, and link-graph propagation for the rest.

A rule fits its host and all subdomains where the path starts with the rule's;
the longest fitting rule decides.  Other pages are judged by their host: trust
spreads from seeds along links (personalised PageRank), distrust from blocked
seeds against them, both over host edges that are summed per host pair before
anything iterates.  A host is blocked when its distrust reaches ``FLOOR`` and is
more than its trust.  Blocked seeds are hosts under a block rule for all paths;
trusted seeds are other hosts under an allow rule.

Rules are a parameter of at most ``MOST_RULES`` entries, so that they can be an
expression.  Defined results: a null url or one without '://' has host and path
'', no rule, and is allowed unless '' is reached by distrust; repeated rows are
judged one by one; a null id stays null; a null page has no links; pages of any
length are searched whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, needed

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 1000
DAMPING, ROUNDS, SETTLED, FLOOR = 0.85, 30, 1e-6, 0.05

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _under(host: Column, name: str) -> Column:
    return (host == name) | host.endswith("." + name)


def _choice(rules, value) -> Column:
    """The value of the longest rule that fits columns host and path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(_under(F.col("host"), rule[1]) & F.col("path").startswith(rule[2]), F.lit(value(rule))).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) after propagation of seeds (kind, host, seed) along edges (kind, source, target, share)."""
    store = Stored(seeds.sparkSession, "ranks")
    base = store.put(seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score")))
    edges = store.put(edges)
    rank, kept = base, store.n
    for _ in range(rounds):
        moved = rank.join(edges, (rank.kind == edges.kind) & (rank.host == edges.source)).select(edges.kind, F.col("target").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score"))
        new = store.put(base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")))
        both = new.unionByName(rank.select("kind", "host", (-F.col("score")).alias("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d"))
        change = both.agg(F.max("d")).first()[0] or 0.0
        if store.n - 2 >= kept:
            store.drop(store.n - 2)
        rank = new
        if change < SETTLED:
            break
    return rank


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    store = Stored(pages.sparkSession, "urls")
    pages = needed(pages, page_id=id_col, url=url_col, html=html_col)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER))).alias("targets"))
    rows = store.put(parts)
    links = rows.select("host", F.explode("targets").alias("target")).where("host != target").groupBy("host", "target").agg(F.count("*").cast("double").alias("weight"))
    links = store.put(links)
    out = links.groupBy("host").agg(F.sum("weight").alias("total"))
    into = links.groupBy("target").agg(F.sum("weight").alias("total"))
    forward = links.join(out, "host").select(F.lit("trust").alias("kind"), F.col("host").alias("source"), "target", (F.col("weight") / F.col("total")).alias("share"))
    backward = links.join(into, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("host").alias("target"), (F.col("weight") / F.col("total")).alias("share"))
    hosts = rows.select("host").unionByName(links.select(F.col("target").alias("host"))).distinct()
    no = F.lit(False)
    blocked = no
    allowed = no
    for verdict, name, start in rules:
        if verdict == "block" and start in ("", "/"):
            blocked = blocked | _under(F.col("host"), name)
        elif verdict == "allow":
            allowed = allowed | _under(F.col("host"), name)
    seeds = hosts.select(F.when(blocked, "distrust").when(allowed, "trust").alias("kind"), "host", F.lit(1.0).alias("seed")).where("kind is not null")
    ranks = propagate(forward.unionByName(backward), seeds)
    scores = ranks.groupBy("host").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)), 9).alias(k) for k in ("trust", "distrust")))
    zero = F.lit(0.0)
    judged = rows.join(scores, "host", "left").select("page_id", "host", "path", _choice(rules, lambda r: r[1] + r[2]).alias("rule"), _choice(rules, lambda r: r[0]).alias("by_rule"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    by_links = F.when((F.col("distrust") >= FLOOR) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_links).alias("verdict"), "trust", "distrust")
