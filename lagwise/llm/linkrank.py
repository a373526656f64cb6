"""URL filters by link-graph propagation: personalised PageRank from trusted hosts
and reversed distrust from blocked ones, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed rules: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
ROUNDS = 10
#: A host is blocked if its distrust is over its trust by more than this; a host
#: all of whose pages rules block has a distrust of 1 before any link counts.
MARGIN = 0.5
#: Judging goes on until no score can grow by more than TOLERANCE; in more than
#: MOST_ROUNDS it is given up with an error.
TOLERANCE = MARGIN * 1e-6
MOST_ROUNDS = 300
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Target of a link with a host of its own; the group is the host, perhaps with user and port.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""


def host_of(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def node_of(host):
    """The name by which pages and links of a host meet: without user and port."""
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst, n: links of pages from one host to another."""
    linked = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER))
    return (pages.select(node_of(F.col(host)).alias("src"), F.explode(linked).alias("dst"))
            .withColumn("dst", node_of(F.col("dst"))).where("src <> dst and src <> '' and dst <> ''")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """host, score: PageRank that starts anew at the seeds (host, weight).

    edges: src, dst, n. A host's score flows along its edges by n; what a host
    without edges holds is lost. Scores are in units of a seed of weight 1 that no
    link reaches, not shares of the whole, so they mean the same in any corpus.
    With a tolerance, rounds go on until all scores together can grow by no more than
    it, and more than `rounds` are an error; without, there are just so many.
    Sums to each host are partial aggregations. Every round is staged in the shared
    folder."""
    home = seeds.select("host", F.col("weight").cast("double").alias("score"))
    if not edges.limit(1).count():
        return home
    outs = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = stage(edges.join(outs, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    # what a round adds to the scores is what flows on in the next
    score = home.withColumn("added", F.col("score"))
    for _ in range(rounds):
        flow = (share.join(score.where("added > 0"), share["src"] == score["host"])
                .select(F.col("dst").alias("host"), (F.col("share") * F.col("added") * damping).alias("score")))
        score = stage(score.select("host", "score", F.lit(0.0).alias("added")).unionByName(flow.withColumn("added", F.col("score")))
                      .groupBy("host").agg(F.sum("score").alias("score"), F.sum("added").alias("added")))
        # all further rounds together add at most damping / (1 - damping) of this one
        if tolerance is not None and (score.agg(F.sum("added")).first()[0] or 0.0) * damping <= tolerance * (1 - damping):
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"scores did not settle in {rounds} rounds")
    return score.select("host", "score")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
          damping: float = DAMPING, rounds: int = MOST_ROUNDS, margin: float = MARGIN, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages.

    Pages that a rule fits have the rule's verdict. Hosts seed trust by the share of
    their pages that rules allow and distrust by the share that rules block. Trust
    flows along the links between hosts, distrust against them, to the hosts that
    link to bad ones. Other pages are blocked if their host's distrust is over its
    trust by more than margin, and allowed otherwise: hosts that nothing reaches, and pages without a host, are
    allowed. A null url has no host and path; null html has no links; an empty table
    gives no rows, repeated rows each return. Pages and links whose hosts differ only in
    user or port share seeds, links and scores; the column host is as in the url.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    ruled = parts.withColumn("node", node_of(F.col("host"))).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = stage(ruled.where("node <> ''").groupBy(F.col("node").alias("host")).agg(
        (F.count_if(F.col("fit.verdict") == "allow") / F.count(F.lit(1))).alias("good"),
        (F.count_if(F.col("fit.verdict") == "block") / F.count(F.lit(1))).alias("bad")))
    edges = stage(host_edges(parts))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = propagate(edges, seeds.where("good > 0").select("host", F.col("good").alias("weight")), damping, rounds, tolerance)
    bad = propagate(back, seeds.where("bad > 0").select("host", F.col("bad").alias("weight")), damping, rounds, tolerance)
    scores = (trust.withColumn("distrust", F.lit(0.0)).unionByName(bad.select("host", F.lit(0.0).alias("score"), F.col("score").alias("distrust")))
              .groupBy("host").agg(F.sum("score").alias("trust"), F.sum("distrust").alias("distrust")))
    out = ruled.drop("html").join(stage(scores.withColumnRenamed("host", "node")), "node", "left")
    none = F.lit(0.0)
    method = F.when(F.coalesce("distrust", none) - F.coalesce("trust", none) > margin, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"),
                      F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))


def query(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB; the rounds are those of a recursive query over nodes, each of which gives what
    a round adds, until all later ones together can't add more than TOLERANCE."""
    lower = f"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"
    node = lambda c: f"regexp_replace({c}, '^.*@|:[0-9]*$', '', 'g')"
    case = lambda f: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{f(h, p, v)}'"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))) + " END"
    link = f"""translate(unnest(regexp_extract_all(coalesce(html, ''), '{HREF[4:].replace("'", "''")}', 1, 'i')), '{_UPPER}', '{_LOWER}')"""
    sql = [f"""p AS (SELECT page_id, {lower} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, html FROM pages)""",
           f"r AS (SELECT page_id, host, path, {node('host')} AS node, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS fit FROM p)",
           "s AS (SELECT node, count(*) FILTER (fit = 'allow') / count(*) AS good, count(*) FILTER (fit = 'block') / count(*) AS bad FROM r WHERE node <> '' GROUP BY 1)",
           f"l AS (SELECT {node('host')} AS src, {link} AS dst FROM p)",
           f"m AS (SELECT src, {node('dst')} AS dst FROM l)",
           "e AS (SELECT src, dst, count(*) AS n FROM m WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2)"]
    for kind, weight, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        sql += [f"{kind}w AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM e)",
                f"""{kind}r(node, added, total) AS (SELECT node, {weight}, sum({weight}) OVER () FROM s WHERE {weight} > 0
                UNION ALL SELECT node, added, sum(added) OVER () FROM (
                  SELECT dst AS node, sum(share * added) * {DAMPING} AS added FROM {kind}w JOIN {kind}r ON src = node
                  WHERE total * {DAMPING} > {TOLERANCE} * {1 - DAMPING} GROUP BY dst))""",
                f"{kind}s AS (SELECT node, sum(added) AS score FROM {kind}r GROUP BY node)"]
    return (f"WITH RECURSIVE {', '.join(sql)} SELECT page_id, host, path, rule, coalesce(fit, CASE WHEN coalesce(ds.score, 0) - coalesce(ts.score, 0) > {MARGIN} "
            "THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN ts USING (node) LEFT JOIN ds USING (node)")
