"""URL judgement by rules and by link-graph propagation, in DataFrame functions only.

Rules decide the urls they fit. Elsewhere a host is judged over the links between hosts.
Trust starts at allowed pages and follows links; next to a plain walk from all pages it gives
the share of a host's PageRank that comes from trusted pages. Distrust starts at blocked pages and goes
against links: the distrust of a host is the mass that a personalised PageRank from this host would
place on blocked pages, found for all hosts at once. Its weights are those of the linking host's own links,
so that a much-linked bad host does not spread thin over those who link to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Production rules: action, host and path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: What is left to move after STEPS rounds is below 0.85**64 = 3e-5 of any host's value.
DAMPING, STEPS = 0.85, 64
#: Rounds between two written tables.
UNROLLED = 4
#: Blocked hosts that are broadcast to the pages.
BROADCAST_HOSTS = 200_000
#: A host is blocked if its distrust, less the trusted share of it, exceeds this. A host that links nowhere must
#: have two thirds of its pages blocked, one that only links to wholly blocked hosts is over it; see the README.
THRESHOLD = 0.1

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls. Of equally long ones the first listed wins."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: -len(r[1])):
        fits = _fits(text, host, path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule.otherwise(none)), (none if action is None else action.otherwise(none))


def node_of(host: Column) -> Column:
    """The name of a host in the link graph: without user and port, for pages and links alike."""
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", "")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. A link without a host stays inside its own, whatever ``<base>`` says."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("dst")
    links = pages.where(F.col("html").isNotNull()).select(node_of(host_of(F.col("url"))).alias("src"), target)
    links = links.select("src", node_of(F.translate("dst", _UPPER, _LOWER)).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _round(state: DataFrame, start: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    """One step of all three walks."""
    flow = (
        edges.join(state, F.col("a") == F.col("host"))
        .groupBy("b")
        .agg(F.sum(F.col("f") * F.col("trust")).alias("ft"), F.sum(F.col("r") * F.col("distrust")).alias("fd"), F.sum(F.col("f") * F.col("mass")).alias("fm"))
    )
    got = lambda seed, c: (1 - damping) * F.col(seed) + damping * F.coalesce(c, F.lit(0.0))
    return start.join(flow, F.col("host") == F.col("b"), "left").select("host", got("t0", F.col("ft")).alias("trust"), got("b0", F.col("fd")).alias("distrust"), got("p0", F.col("fm")).alias("mass"))


def host_scores(pages: DataFrame, links: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust): the trusted share of a host's PageRank and the blocked share of where it leads, both 0 to 1.

    ``steps`` rounds, or fewer once no value of any host changes at all: a host's values depend on the hosts it
    is linked with, directly or not, and on no others. ``pages`` holds host (as in the graph) and action. State is written to the shared
    folder every few rounds.
    """
    count = lambda c: F.sum(c.cast("double"))
    has = lambda act: count(F.coalesce(F.col("action") == act, F.lit(False)).cast("int"))
    seeds = pages.where("host <> ''").groupBy("host").agg(has("allow").alias("t0"), (has("block") / F.count("*")).alias("b0"), F.count("*").cast("double").alias("p0"))
    links = stored(links, "links")
    linked = bool(links.limit(1).count())
    if linked:
        ends = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
        seeds = stored(seeds.join(ends, "host", "full").na.fill(0.0), "seeds")
    state = seeds.select("host", *[(F.col(c) * (1 - damping)).alias(v) for c, v in (("t0", "trust"), ("b0", "distrust"), ("p0", "mass"))])
    if linked:
        out = links.groupBy("src").agg(F.sum("n").alias("o")).withColumnRenamed("src", "x")
        weighed = links.join(out, F.col("src") == F.col("x")).withColumn("w", F.col("n") / F.col("o"))
        forward = weighed.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("f"), F.lit(0.0).alias("r"))
        backward = weighed.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("f"), F.col("w").alias("r"))
        edges = stored(forward.union(backward), "edges")
        state = stored(state, "masses")
        for _ in range(0, steps, UNROLLED):
            after = state
            for _ in range(UNROLLED):
                after = _round(after, seeds, edges, damping)
            after = stored(after, "masses")
            both = after.join(state.toDF("host", "t_", "d_", "m_"), "host")
            moved = both.where((F.col("trust") != F.col("t_")) | (F.col("distrust") != F.col("d_")) | (F.col("mass") != F.col("m_")))
            state = after
            if not moved.limit(1).count():
                break
    return state.select("host", F.when(F.col("mass") > 0, F.col("trust") / F.col("mass")).otherwise(0.0).alias("trust"), "distrust")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path. Where no rule fits, the
    verdict is block if distrust * (1 - trust) > threshold at the host, else allow; an empty host is allowed.
    Null html has no links; very long html is read whole. A null page_id is a page like any other. Repeated rows are judged each and count each; an empty table gives an empty
    result; other columns are ignored.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    seen = parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), node_of(F.col("host")).alias("node"))
    scores = host_scores(seen.select(F.col("node").alias("host"), "action"), host_links(pages))
    bad = stored(scores.where(F.col("distrust") * (1 - F.col("trust")) > threshold).select(F.col("host").alias("bad")), "bad")
    # Pages of a hot host stay in their tasks while the bad hosts are few; beyond that the adaptive join splits hot hosts.
    judged = seen.join(F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad, F.col("node") == F.col("bad"), "left")
    verdict = F.coalesce("action", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
