"""URL filters: host and path rules, and link-graph propagation for what no rule fits.

The longest fitting rule decides. Pages without a rule take the verdict of their host, over
distinct weighted host edges: personalised PageRank spreads trust from hosts with allowed
pages along links, and distrust goes from hosts with blocked pages against the links, as the
mean over a host's own links (a host that links to bad ones is bad, however many others link
to them as well). A host's seed weight is the share of its pages that a rule allows (blocks).
A host is blocked when its distrust exceeds its trust by more than ``MARGIN`` of what an
unlinked, wholly blocked host has.

All of it is DataFrame work: edges are pre-aggregated before the first shuffle, each round is
two equi-joins and one sum per host, and is written to the shared folder.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed; null or empty html has no links; links to the own host and repeated links within a
page count nothing more; where trust balances distrust the host is allowed; repeated pages count as pages of their own; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from railguard.session import durable

#: The contract's rules: (host and path, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Rules are a parameter that ends up in one expression; a list beyond this is refused.
MOST_RULES = 200
DAMPING = 0.85
#: Scores only grow, and what a round leaves out shrinks by the damping: after ROUNDS rounds
#: less than TOLERANCE of a seed is missing. Rounds stop before when the sums stand still.
TOLERANCE = 0.01
ROUNDS = ceil(log(TOLERANCE) / log(DAMPING))
STILL = 1e-9
MARGIN = 0.5

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; else empty."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), *_LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts it."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        here = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(here & F.startswith(path, F.lit("/" + start)), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of ``src`` that link to another host ``dst``."""
    target = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = (
        pages.filter(F.contains("html", F.lit("://")) | F.contains("html", F.lit("//")))
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
        .select(F.col("host").alias("src"), host_of(target).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
    )
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def host_scores(judged: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from ``judged`` (host, html, rule_verdict)."""
    edges = durable(host_edges(judged))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = durable(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    share = lambda verdict: F.avg(F.when(F.col("rule_verdict") == verdict, 1.0).otherwise(0.0))
    seeds = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    targets = shares.select(F.col("dst").alias("host")).distinct()
    hosts = durable(
        targets.join(seeds, "host", "full").select(
            "host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")
        )
    )
    scores = hosts.select(
        "host", "good", "bad", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust")
    )
    if shares.isEmpty():  # nothing to spread: every round would give the same
        return scores
    before = None
    for _ in range(rounds):
        forth = shares.join(scores.select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (F.col("share") * F.col("trust")).alias("t"), F.lit(0.0).alias("d")
        )
        back = shares.join(scores.select(F.col("host").alias("dst"), "distrust"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("share") * F.col("distrust")).alias("d")
        )
        flow = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        scores = durable(
            hosts.join(flow, "host", "left").select(
                "host",
                "good",
                "bad",
                ((1 - damping) * F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                ((1 - damping) * F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            )
        )
        now = scores.agg(F.sum("trust"), F.sum("distrust")).first()
        if before and max(now[i] - before[i] for i in (0, 1)) < STILL:
            break
        before = now
    return scores


def filtered(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    named = pages.select(
        "page_id",
        "html",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule]) if rules else F.create_map()
    judged = named.withColumn("rule_verdict", F.try_element_at(verdicts, "rule")) if rules else named.withColumn(
        "rule_verdict", F.lit(None).cast("string")
    )
    bad = (F.col("distrust") - F.col("trust")) > MARGIN * (1 - DAMPING)
    hosts = host_scores(judged).filter(bad).select("host", F.lit("block").alias("host_verdict"))
    return judged.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict")
    )


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _op2_sql() -> str:
    """The same rounds as chained tables."""
    lower = f"translate({{}}, '{_LOWER[0]}', '{_LOWER[1]}')"
    host = lambda u: (
        f"CASE WHEN contains({u}, '://') THEN "
        + lower.format(f"regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*', 0)")
        + " ELSE '' END"
    )
    fits = []
    for rule, _ in sorted(RULES, key=lambda r: -len(r[0])):
        name, _, start = rule.partition("/")
        fits.append(
            f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{rule}'"
        )
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    rounds = []
    for i in range(1, ROUNDS + 1):
        rounds.append(f"""
r{i} AS MATERIALIZED (
  SELECT h.host, good, bad, {1 - DAMPING} * good + {DAMPING} * coalesce(t, 0) AS trust,
         {1 - DAMPING} * bad + {DAMPING} * coalesce(d, 0) AS distrust
  FROM hosts h LEFT JOIN (
    SELECT host, sum(t) AS t, sum(d) AS d FROM (
      SELECT dst AS host, share * trust AS t, 0 AS d FROM shares JOIN r{i - 1} p ON src = p.host
      UNION ALL
      SELECT src, 0, share * distrust FROM shares JOIN r{i - 1} p ON dst = p.host)
    GROUP BY host) f ON f.host = h.host)""")
    link = _LINK.replace("'", "''")
    return f"""
WITH named AS (
  SELECT page_id, html, coalesce({host('url')}, '') AS host,
         coalesce(CASE WHEN contains(url, '://')
           THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END, '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM named),
judged AS (SELECT *, CASE rule {verdict} END AS rule_verdict FROM ruled),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM judged),
edges AS (
  SELECT src, dst, count(*)::DOUBLE AS weight
  FROM (SELECT src, {host("(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END)")} AS dst FROM links)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
seeds AS (
  SELECT host, avg(CASE WHEN rule_verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good,
         avg(CASE WHEN rule_verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad
  FROM judged WHERE host <> '' GROUP BY host),
hosts AS MATERIALIZED (
  SELECT coalesce(s.host, t.host) AS host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM seeds s FULL JOIN (SELECT DISTINCT dst AS host FROM shares) t ON s.host = t.host),
r0 AS MATERIALIZED (
  SELECT host, good, bad, {1 - DAMPING} * good AS trust, {1 - DAMPING} * bad AS distrust FROM hosts),{','.join(rounds)}
SELECT page_id, j.host, path, rule,
       coalesce(rule_verdict, CASE WHEN r.distrust - r.trust > {MARGIN * (1 - DAMPING)} THEN 'block' END, 'allow')
         AS verdict
FROM judged j LEFT JOIN r{ROUNDS} r ON j.host = r.host
"""


OP2_SQL = _op2_sql()
