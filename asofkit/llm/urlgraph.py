"""URL verdicts: host rules, and trust propagated over the link graph where no rule fits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

#: Verdict, host and path prefix.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<(?:a|area|link|form|iframe|base)\s[^>]*?(?:href|action|src)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def sites(hosts: DataFrame) -> DataFrame:
    """src, dst, w between each host of more than two labels and the host without its first label, both ways.

    The parts of a site belong together as far as its own name says; w is the number of pages
    below. Hosts of digits and dots alone are addresses and have no such parts.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.array_join(F.slice("l", i + 1, F.size("l")), "."))
    named = hosts.where(~F.col("host").rlike(r"^[0-9.:]*$")).select("pages", labels.alias("l")).where((F.size("l") > 2) & ~F.exists("l", lambda x: x == ""))
    steps = named.select("pages", parents.alias("p")).select("pages", F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("e"))
    up = steps.groupBy("e.src", "e.dst").agg(F.sum("pages").cast("double").alias("w"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def steps_for(damping: float, tolerance: float) -> int:
    """After so many steps every walk has less than ``tolerance`` of its mass on its way."""
    return math.ceil(math.log(tolerance) / math.log(damping)) + 1


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, max_steps: int | None = None) -> DataFrame:
    """Personalised PageRank of every kind of seed: (kind, host, m, score), each kind's score summing to 1.

    seeds: kind, host, mass. edges: kind, src, dst, share (of what leaves src). Mass goes out step
    by step for as many steps as leave less than ``tolerance`` of it on its way (or ``max_steps``);
    m is what passed a host, and score is scaled, as what hosts without links would keep returns to
    the seeds. Every step is a written table, so a lost executor repeats one step at most.
    """
    at = materialise(seeds.select("kind", "host", F.col("mass").alias("m")), "walk")
    gone = [at]  # steps that are not in the sum yet; ten at a time keep the plan small
    total: DataFrame | None = None

    def added(parts: list[DataFrame]) -> DataFrame:
        out = materialise(reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("m").alias("m")), "ranks")
        for p in parts:
            if p is not at:
                discard(p)
        return out

    enough = steps_for(damping, tolerance)
    for _ in range(enough if max_steps is None else min(enough, max_steps)):
        # A host's mass, not their sum: of exposures every host may have much.
        if (at.agg(F.max("m")).first()[0] or 0.0) == 0.0:
            break
        src = at.withColumnRenamed("host", "src")
        at = materialise(src.join(edges, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("m") * F.col("share") * damping).alias("m")), "walk")
        gone.append(at)
        if len(gone) == 10:
            total, gone = added([*gone[:-1], *([total] if total is not None else [])]), [at]
    total = added([*gone, *([total] if total is not None else [])])
    discard(at)
    whole = {r["kind"]: r["m"] for r in total.groupBy("kind").agg(F.sum("m").alias("m")).collect()}  # one row a kind
    scale = reduce(lambda c, k: F.when(F.col("kind") == k, F.lit(1.0 / whole[k])).otherwise(c), whole, F.lit(1.0))
    return total.select("kind", "host", "m", (F.col("m") * scale).alias("score"))


def judge(
    pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-4, max_steps: int | None = None, seed_share: float = 0.5, least: float = 0.05
) -> DataFrame:
    """Judge every page by its url's longest fitting rule, or else by its host.

    A host is a trusted (blocked) seed if a rule allows (blocks) more than ``seed_share`` of its
    pages. Edges are the links between hosts, absolute or by '//', and those of a site: each host of
    more than two labels with the host without its first label, both ways. Trust follows the edges,
    distrust follows them backwards: who links to blocked hosts is distrusted.

    Both scores depend on how many seeds and linking hosts there are, so they decide as shares: a host's
    trust_share is the trusted seeds' part of what walks that start at every host bring to it, distrust_share
    the blocked seeds' part of such walks backwards. Where many hosts link to one blocked host, walks backwards
    part among them, and the share of each is small; so distrust is also passed back undivided, each
    host taking it over its own links alone: exposure is the chance that a walk along the
    host's links, which stops with 1 - ``damping`` at each, meets a blocked seed. A host is blocked
    if its distrust_share or its exposure is at least ``least`` and exceeds its trust_share; other
    hosts, unlinked ones too, are allowed. Relative links and links within a host are no edges.

    Null urls or such without '://' have an empty host and path, fit no rule and are allowed. Null
    html has no links. Repeated pages count each; extra columns are ignored; an empty table gives
    an empty result. Returns page_id, host, path, rule, verdict, trust, distrust, trust_share,
    distrust_share, exposure and decided (by which of the last two a host is blocked, else null).
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = materialise(
        pages.select(
            F.col("page_id"),
            host.alias("host"),
            path.alias("path"),
            rule_for(host, path, rules).alias("r"),
            F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1)), lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))).alias("links"),
        ),
        "pages",
    )
    known = base.where(F.col("host") != "")
    share = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0)) / F.count("*")
    hosts = known.groupBy("host").agg(share("allow").alias("a"), share("block").alias("b"), F.count("*").alias("pages"))
    marked = hosts.select("host", F.when(F.col("a") > seed_share, "trust").when(F.col("b") > seed_share, "distrust").alias("kind")).where("kind is not null")
    seeds = materialise(marked, "seeds")
    blocked = seeds.where("kind = 'distrust'").select("host")
    n = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}
    mass = reduce(lambda c, k: F.when(F.col("kind") == k, F.lit(1.0 / n[k])).otherwise(c), n, F.lit(0.0))
    links = (
        known.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
        .where((F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("w"))
    )
    links = materialise(links.unionByName(sites(hosts)).groupBy("src", "dst").agg(F.sum("w").alias("w")), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    shares = materialise(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("share")), "edges")
    onward = shares.where("kind = 'trust'")
    # Exposure comes back over the host's own links; a blocked seed ends the walk.
    back = onward.select(F.lit("exposure").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    back = back.join(blocked.withColumnRenamed("host", "dst"), "dst", "left_anti").select("kind", "src", "dst", "share")
    everywhere = [shares.where(F.col("kind") == k).withColumn("kind", F.lit(name)) for k, name in (("trust", "all"), ("distrust", "all_back"))]
    edges = materialise(reduce(DataFrame.unionByName, [shares, *everywhere, back]), "edges")
    linked = links.select(F.col("src").alias("host")).union(links.select("dst")).distinct()
    one = F.lit(1.0).alias("mass")
    starts = seeds.withColumn("mass", mass).unionByName(blocked.select(F.lit("exposure").alias("kind"), "host", one))
    for name in ("all", "all_back"):
        starts = starts.unionByName(linked.select(F.lit(name).alias("kind"), "host", one))
    ranks = propagate(starts, edges, damping, tolerance, max_steps)
    of = lambda k, c, name: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0.0)).alias(name)
    made = [of("trust", "score", "trust"), of("distrust", "score", "distrust"), of("exposure", "m", "exposure"), of("trust", "m", "good"), of("distrust", "m", "bad"), of("all", "m", "all"), of("all_back", "m", "all_back")]
    part = lambda m, kind, every: F.when(F.col(every) > 0, F.col(m) * float(n.get(kind, 0)) / F.col(every)).otherwise(0.0)
    scores = ranks.groupBy("host").agg(*made).withColumns({"trust_share": part("good", "trust", "all"), "distrust_share": part("bad", "distrust", "all_back")})
    blocks = lambda c: (F.col(c) >= least) & (F.col(c) > F.col("trust_share"))
    scores = scores.withColumn("decided", F.when(blocks("distrust_share"), "distrust_share").when(blocks("exposure"), "exposure"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("decided").isNotNull(), "block").otherwise("allow"))
    numbers = ("trust", "distrust", "trust_share", "distrust_share", "exposure")
    return base.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers], F.when(F.col("r.rule").isNull(), F.col("decided")).alias("decided"),
    )


def op10_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
