"""Parameter selection: tie-banded argmin and nested leave-one-domain-out scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from railguard.functions.columns import TOLERANCE
from railguard.operators.layout import Keys
from railguard.operators.reshape import top_one


def argmin_with_ties(
    scores: DataFrame, group: list[str], score: str, tie_break: list[Column],
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Per group: rows within ``tolerance`` of the minimum, then the tie-break order."""
    best = F.min(score).over(Window.partitionBy(*group))
    near = scores.withColumn("_best", best).filter(F.col(score) <= F.col("_best") + tolerance)
    return top_one(near.drop("_best"), group, tie_break)


def grid_scores(
    units: DataFrame, keys: Keys, points: list[dict[str, float]], score: str = "mae"
) -> DataFrame:
    """Grid arrays per unit -> unit-macro mean per domain and grid point (long rows).

    The mean over units is taken per array position before the grid becomes rows.
    """
    means = units.groupBy(keys.domain).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("records").alias("records"),
        *[F.avg(F.get("errors", F.lit(i))).alias(f"_m{i}") for i in range(len(points))],
    )
    rows = [
        F.struct(*[F.lit(float(v)).alias(k) for k, v in p.items()], F.col(f"_m{i}").alias(score))
        for i, p in enumerate(points)
    ]
    return means.select(keys.domain, "units", "records", F.inline(F.array(*rows)))


def excluded_pairs(domains: DataFrame, domain: str = "domain") -> DataFrame:
    """All ordered (outer, inner) pairs of distinct domains.  Domains are a short list."""
    names = F.array_sort(F.collect_set(domain))
    listed = domains.select(domain).distinct().agg(names.alias("names"))
    return (
        listed.select(F.explode("names").alias("outer_domain"), "names")
        .select("outer_domain", F.explode("names").alias("inner_domain"))
        .filter(F.col("outer_domain") != F.col("inner_domain"))
    )


def nested_selection(
    inner_scores: DataFrame, params: list[str], tie_break: list[Column], score: str = "mae"
) -> DataFrame:
    """Per outer domain: equal mean over inner domains, then the tie-banded argmin.

    ``inner_scores``: outer_domain, inner_domain, parameters, score.  The outer domain's
    own labels never enter, because it is never one of its inner domains.
    """
    means = (
        inner_scores.filter(F.col("outer_domain") != F.col("inner_domain"))
        .groupBy("outer_domain", *params)
        .agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("inner_domains"))
    )
    return argmin_with_ties(means, ["outer_domain"], score, tie_break).withColumn(
        "outer_labels_used", F.lit(False)
    )


def decision_verdict(gates: dict[str, Column], certificates: set[str]) -> list[Column]:
    """REJECT when a certificate fails, RETAIN when every gate holds, else NARROW.

    ``certificates`` names the gates that are promises of the method rather than findings
    of the evaluation: none of them may fail, however good the findings are.
    """
    kept = F.lit(True)
    for name in sorted(certificates):
        kept = kept & gates[name]
    everything = kept
    for name, flag in gates.items():
        everything = everything & flag if name not in certificates else everything
    entries = [x for k, v in gates.items() for x in (F.lit(k), v)]
    verdict = F.when(~kept | kept.isNull(), "REJECT").when(everything, "RETAIN").otherwise("NARROW")
    return [F.create_map(*entries).alias("gates"), verdict.alias("verdict")]


def robustness_class(
    mean: Column, left_out_high: Column, without_most_units: Column, without_most_records: Column,
    p_value: Column, level: float = 0.05,
) -> Column:
    """ROBUST, QUALIFIED or CONTRADICTED for a contrast where negative favours the method.

    Robust: significant, negative whichever domain is left out, and negative without the
    domain of most units and that of most records.
    """
    lasting = (left_out_high < 0) & (without_most_units < 0) & (without_most_records < 0)
    return (
        F.when(mean >= 0, "CONTRADICTED")
        .when(lasting & (p_value <= level), "ROBUST")
        .otherwise("QUALIFIED")
    )
