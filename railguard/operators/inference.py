"""Inference for many contrasts at once: bootstrap intervals and exact small-n tests.

A contrast is a set of per-domain differences (``contrast_id, domain, difference``).
Domains are declared, top-level data sets, so a contrast fits one row; the size is
checked and a larger one fails instead of being collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from railguard.functions.columns import TOLERANCE, is_finite
from railguard.functions.draws import MODULUS, first_place, stretch_sums, uniform_index, uniform_index_array
from railguard.operators.ordering import numbered_by_range

MAX_DOMAINS = 10_000
#: Domains of an exact sign-flip test: a task holds the 2^22 sums of half of them.
MAX_SIGN_FLIP = 44
#: Sums of the other half that one task looks up.
HALF_BLOCK = 1 << 16
#: Non-zero differences of a signed-rank test (a task holds about their square, 32 MB here).
MAX_SIGNED_RANK = 2_000
#: Units of a contrast that are held as one row (8 MB); larger contrasts join their draws.
ARRAY_UNITS = 1_000_000
#: Draws that a task makes at a time.
DRAWS_HELD = 1 << 20
BLOCK = 256
#: Units of a domain whose draws are read off the ring of places (see ``functions.draws``).
RING_UNITS = 1_000_000
#: Domains of a two-stage contrast up to which every task picks them again for itself.
RING_DOMAINS = 64
#: Parts that the ring is cut into, each one a task per domain, and contrasts in a task.
RING_PARTS, RING_CONTRASTS = 32, 8

# Two-sided 95% critical values of Student's t for 1 to 30 degrees of freedom.
T_CRITICAL_95 = [
    12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469119, 2.3646243, 2.3060041,
    2.2621572, 2.2281389, 2.2009852, 2.1788128, 2.1603687, 2.1447867, 2.1314495, 2.1199053,
    2.1098156, 2.1009220, 2.0930241, 2.0859634, 2.0796138, 2.0738731, 2.0686576, 2.0638986,
    2.0595386, 2.0555294, 2.0518305, 2.0484071, 2.0452296, 2.0422725,
]


def contrast_arrays(contrasts: DataFrame, limit: int = MAX_DOMAINS) -> DataFrame:
    """One row per contrast: differences sorted by domain as ``values``, with ``n``.

    Sizes are counted and checked first; only then are the domains of a contrast collected.
    """
    packed = F.array_sort(F.collect_list(F.struct("domain", "difference")))
    counted = contrasts.groupBy("contrast_id").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.agg(F.max("n")).first()[0] or 0
    if largest > limit:
        raise ValueError(f"a contrast has {largest} domains, at most {limit} fit one row")
    rows = contrasts.groupBy("contrast_id").agg(F.count(F.lit(1)).alias("n"), packed.alias("_p"))
    return rows.select("contrast_id", "n", F.transform("_p", lambda s: s["difference"]).alias("values"))


def _replicates(df: DataFrame, reps: int, ids: list[str]) -> DataFrame:
    """Every row repeated for ``rep`` in [0, reps), spread over the cluster in blocks."""
    blocks = -(-reps // BLOCK)
    spread = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = F.col("_block") * BLOCK
    last = F.least(first + (BLOCK - 1), F.lit(reps - 1))
    return (
        spread.repartition(*ids, "_block")
        .withColumn("rep", F.explode(F.sequence(first, last)))
        .drop("_block")
    )


def _array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cluster_replicates(contrasts: DataFrame, reps: int, seed: int) -> DataFrame:
    """Bootstrap means: domains resampled with replacement, one row per replicate."""
    rows = _replicates(contrast_arrays(contrasts), reps, ["contrast_id"])
    drawn = F.transform(
        F.sequence(F.lit(0), (F.col("n") - 1).cast("int")),
        lambda j: F.get("values", uniform_index(F.col("n"), seed, F.col("rep"), j).cast("int")),
    )
    return rows.select("contrast_id", "rep", (_array_sum(drawn) / F.col("n")).alias("replicate"))


def percentile_interval(
    replicates: DataFrame, group: list[str], level: float = 0.95, comparisons: int = 1
) -> DataFrame:
    """Percentile interval of the replicates; ``comparisons`` > 1 gives the Bonferroni form."""
    tail = (1.0 - level) / (2.0 * comparisons)
    # The number of replicates per contrast is a declared parameter, so this is bounded.
    q = F.percentile("replicate", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return replicates.groupBy(*group).agg(q.alias("_q")).select(
        *group, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high")
    )


def cluster_bootstrap(contrasts: DataFrame, reps: int = 100_000, seed: int = 17, **kw) -> DataFrame:
    point = contrasts.groupBy("contrast_id").agg(F.avg("difference").alias("point"))
    interval = percentile_interval(cluster_replicates(contrasts, reps, seed), ["contrast_id"], **kw)
    return point.join(interval, "contrast_id")


def indexed_units(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units numbered inside their domain, and one row per domain with its position and size."""
    # A domain may hold most units, so numbering must not gather it in one task.
    numbered = numbered_by_range(units, ["contrast_id", "domain"], "unit", "i")
    sizes = numbered.groupBy("contrast_id", "domain").agg(F.count(F.lit(1)).alias("m"))
    by_contrast = Window.partitionBy("contrast_id")
    sizes = sizes.withColumns(
        {
            "d": F.row_number().over(by_contrast.orderBy("domain")) - 1,
            "n": F.count(F.lit(1)).over(by_contrast),
        }
    )
    return numbered, sizes


def two_stage_replicates(units: DataFrame, reps: int, seed: int) -> DataFrame:
    """Resample domains, then units inside every drawn domain; one mean per replicate.

    ``units``: contrast_id, domain, unit, difference.  Draws are rows joined to units on
    (domain, unit number), an evenly spread key, so a domain with a third of all units is
    no hot spot, and sums per slot are combined before they are shuffled.
    """
    numbered, sizes = indexed_units(units)
    slots = _replicates(
        sizes.select("contrast_id", "n").distinct(), reps, ["contrast_id"]
    ).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    slots = slots.withColumn("d", uniform_index(F.col("n"), seed, F.col("rep"), F.col("slot")))
    # One row per domain: a bounded, checked list (see contrast_arrays).
    slots = slots.join(F.broadcast(sizes.drop("n")), ["contrast_id", "d"])
    draws = slots.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
    draws = draws.withColumn(
        "i",
        uniform_index(F.col("m"), seed + 1, F.col("rep"), F.col("slot"), F.col("j")),
    )
    joined = draws.join(numbered, ["contrast_id", "domain", "i"])
    means = joined.groupBy("contrast_id", "rep", "slot").agg(F.avg("difference").alias("mean"))
    return means.groupBy("contrast_id", "rep").agg(F.avg("mean").alias("replicate"))


def unit_arrays(units: DataFrame) -> DataFrame | None:
    """Per contrast the differences of its units, a list per domain, both in order.

    None when a contrast has more than ``ARRAY_UNITS`` units: then draws are joined instead.
    """
    counted = units.groupBy("contrast_id").agg(F.count(F.lit(1)).alias("n"))
    if (counted.agg(F.max("n")).first()[0] or 0) > ARRAY_UNITS:
        return None
    pick = lambda name: lambda s: s[name]
    domains = units.groupBy("contrast_id", "domain").agg(
        F.array_sort(F.collect_list(F.struct("unit", "difference"))).alias("_u")
    )
    listed = domains.select(
        "contrast_id", F.struct("domain", F.transform("_u", pick("difference")).alias("values")).alias("_d")
    )
    rows = listed.groupBy("contrast_id").agg(F.array_sort(F.collect_list("_d")).alias("_d"))
    return rows.select(
        "contrast_id", F.transform("_d", pick("domain")).alias("domains"), F.transform("_d", pick("values")).alias("values")
    )


def _resampled(arrays: DataFrame, reps: int, draw, by_domain: bool) -> DataFrame:
    """Replicates of every contrast (and domain) by ``draw(values, reps)``, a block per row."""
    names = ["contrast_id", *["domain"] * by_domain, "replicate"]
    kind = arrays.schema["contrast_id"].dataType.simpleString()
    schema = f"contrast_id {kind}, " + "domain string, " * by_domain + "replicate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (contrast, block) in enumerate(zip(ids, blocks)):
                values = [x.values.to_numpy() for x in batch.column(3)[i]]
                domains = batch.column(2)[i].as_py()
                numbers = np.arange(block * BLOCK, min((block + 1) * BLOCK, reps))
                for d, out in draw(values, numbers):
                    columns = [pa.array([contrast] * len(out)), *[pa.array([domains[d]] * len(out))] * by_domain]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names=names)

    blocks = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // BLOCK) - 1))))
    dealt = blocks.select("contrast_id", "block", "domains", "values").repartition("contrast_id", "block")
    return dealt.mapInArrow(run, schema)


def _means(values: np.ndarray, seed: int, reps: np.ndarray, *position: int, last: int | None = None) -> np.ndarray:
    """Mean of one resample of ``values`` per replicate, some replicates at a time."""
    m = len(values)
    out = np.empty(len(reps))
    step = max(1, DRAWS_HELD // m)
    for at in range(0, len(reps), step):
        part = reps[at : at + step, None]
        tail = () if last is None else (last,)
        out[at : at + step] = values[uniform_index_array(m, seed, part, *position, np.arange(m), *tail)].mean(1)
    return out


def two_stage_by_arrays(arrays: DataFrame, reps: int, seed: int) -> DataFrame:
    """Replicates of ``two_stage_replicates`` without a row per draw."""

    def draw(values, numbers):
        total = np.zeros(len(numbers))
        for slot in range(len(values)):
            picked = uniform_index_array(len(values), seed, numbers, slot)
            for d in np.unique(picked):
                rows = picked == d
                total[rows] += _means(values[d], seed + 1, numbers[rows], slot)
        yield 0, total / len(values)

    return _resampled(arrays, reps, draw, False)


def units_by_arrays(arrays: DataFrame, reps: int, seed: int) -> DataFrame:
    def draw(values, numbers):
        for d, own in enumerate(values):
            yield d, _means(own, seed, numbers, last=d)

    return _resampled(arrays, reps, draw, True)


def ring_rows(units: DataFrame, domains: int | None = None) -> DataFrame | None:
    """Per domain position and size the differences of contrasts with these, as lists.

    Such contrasts draw the same unit numbers, so a task draws once for all of them. None when a
    domain has more than ``RING_UNITS`` units, a contrast has more than ``domains`` domains, or a
    difference is not finite: then draws are made one by one.
    """
    sizes = units.groupBy("contrast_id", "domain").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(~is_finite("difference")).alias("_broken")
    )
    per_contrast = sizes.groupBy("contrast_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), F.sum("_broken").alias("broken")
    )
    most = per_contrast.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("broken").alias("broken")).first()
    if (most["m"] or 0) > RING_UNITS or most["broken"] or (domains is not None and (most["n"] or 0) > domains):
        return None
    listed = units.groupBy("contrast_id", "domain").agg(
        F.array_sort(F.collect_list(F.struct("unit", "difference"))).alias("_u")
    )
    by_contrast = Window.partitionBy("contrast_id")
    numbered = listed.select(
        "contrast_id", "domain", F.size("_u").alias("m"),
        (F.row_number().over(by_contrast.orderBy("domain")) - 1).alias("d"),
        F.count(F.lit(1)).over(by_contrast).alias("n"),
        F.transform("_u", lambda u: u["difference"]).alias("values"),
    )
    alike = ["n", "d", "m"]
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("contrast_id")) - 1
    packed = numbered.withColumn("pack", F.floor(place / RING_CONTRASTS)).groupBy(*alike, "pack").agg(
        F.collect_list(F.struct("contrast_id", "domain", "values")).alias("held")
    )
    parts = F.explode(F.sequence(F.lit(0), F.lit(RING_PARTS - 1)))
    return packed.select(*alike, "pack", parts.alias("part"), "held")


def _ring_means(rows: DataFrame, stretches, running: int) -> DataFrame:
    """Means of all stretches: contrast_id, domain, rep, slot and mean.

    ``stretches(n, d)`` gives replicate, slot and first place of each. Differences become whole
    numbers, as fine as a sum of ``m`` of them allows, so sums are exact and parts may be added
    in any order.
    """
    held = rows.schema["held"].dataType.elementType
    kinds = [held[c].dataType.simpleString() for c in ("contrast_id", "domain")]
    schema = f"contrast_id {kinds[0]}, domain {kinds[1]}, m bigint, rep bigint, slot bigint, bits int, total bigint"
    names = ["contrast_id", "domain", "m", "rep", "slot", "bits", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, d, m, part = (batch.column(c)[i].as_py() for c in range(4))
                own = batch.column(4)[i].values
                values = np.stack([x.values.to_numpy() for x in own.field("values")], axis=1)
                largest = np.abs(values).max(axis=0) * m
                bits = np.where(largest > 0, 61 - np.frexp(largest)[1], 0).clip(-1000, 1000)
                whole = np.rint(np.ldexp(values, bits)).astype(np.int64)
                rep, slot, starts = stretches(n, d)
                low, high = (MODULUS * (part + k) // RING_PARTS for k in (0, 1))
                number, sums = stretch_sums(whole, running, starts, low, high)
                size = len(number)
                for k, (contrast, domain) in enumerate(zip(own.field("contrast_id").to_pylist(), own.field("domain").to_pylist())):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([contrast] * size, batch.schema.field("held").type.value_type.field("contrast_id").type),
                        pa.array([domain] * size, batch.schema.field("held").type.value_type.field("domain").type),
                        pa.array(np.full(size, m, np.int64)), pa.array(rep[number]), pa.array(slot[number]),
                        pa.array(np.full(size, bits[k], np.int32)), pa.array(np.ascontiguousarray(sums[:, k])),
                    ], names=names)

    # Rows may be large: many partitions, so that a batch holds few of them.
    dealt = rows.repartition(8 * RING_PARTS, "n", "d", "m", "pack", "part")
    parts = dealt.select("n", "d", "m", "part", "held").mapInArrow(run, schema)
    key = ["contrast_id", "domain", "rep", "slot"]
    summed = parts.groupBy(*key).agg(F.sum("total").alias("_t"), F.first("bits").alias("_b"), F.first("m").alias("_m"))
    return summed.select(*key, (F.col("_t") * F.pow(F.lit(2.0), -F.col("_b")) / F.col("_m")).alias("mean"))


def two_stage_by_ring(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """Replicates of ``two_stage_replicates``; no place of the ring is drawn twice."""

    def stretches(n, d):
        numbers = np.arange(reps, dtype=np.int64)
        picked = [(numbers[uniform_index_array(n, seed, numbers, s) == d], s) for s in range(n)]
        rep = np.concatenate([r for r, _ in picked])
        slot = np.concatenate([np.full(len(r), s, np.int64) for r, s in picked])
        return rep, slot, first_place(seed + 1, 2, rep, slot)

    means = _ring_means(rows, stretches, 2)
    return means.groupBy("contrast_id", "rep").agg(F.avg("mean").alias("replicate"))


def units_by_ring(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """Replicates of ``unit_replicates``; no place of the ring is drawn twice."""

    def stretches(n, d):
        rep = np.arange(reps, dtype=np.int64)
        return rep, np.zeros(reps, np.int64), first_place(seed, 1, rep, 0, d)

    return _ring_means(rows, stretches, 1).withColumnRenamed("mean", "replicate")


def two_stage_bootstrap(units: DataFrame, reps: int = 100_000, seed: int = 17, **kw) -> DataFrame:
    domains = units.groupBy("contrast_id", "domain").agg(F.avg("difference").alias("difference"))
    point = domains.groupBy("contrast_id").agg(F.avg("difference").alias("point"))
    rows = ring_rows(units, RING_DOMAINS)
    if rows is not None:
        drawn = two_stage_by_ring(rows, reps, seed)
    else:
        arrays = unit_arrays(units)
        drawn = two_stage_replicates(units, reps, seed) if arrays is None else two_stage_by_arrays(arrays, reps, seed)
    return point.join(percentile_interval(drawn, ["contrast_id"], **kw), "contrast_id")


def unit_bootstrap(units: DataFrame, reps: int, seed: int, **kw) -> DataFrame:
    """Units resampled within each domain: an interval per contrast and domain."""
    group = ["contrast_id", "domain"]
    point = units.groupBy(*group).agg(F.avg("difference").alias("point"))
    rows = ring_rows(units)
    if rows is not None:
        means = units_by_ring(rows, reps, seed)
    else:
        arrays = unit_arrays(units)
        means = unit_replicates(units, reps, seed) if arrays is None else units_by_arrays(arrays, reps, seed)
    return point.join(percentile_interval(means, group, **kw), group)


def unit_replicates(units: DataFrame, reps: int, seed: int) -> DataFrame:
    """Draws as rows joined to units, for contrasts too large for one row."""
    numbered, sizes = indexed_units(units)
    slots = _replicates(sizes, reps, ["contrast_id", "domain"])
    draws = slots.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
    draws = draws.withColumn("i", uniform_index(F.col("m"), seed, F.col("rep"), F.col("j"), F.col("d")))
    return (
        draws.join(numbered, ["contrast_id", "domain", "i"])
        .groupBy("contrast_id", "domain", "rep")
        .agg(F.avg("difference").alias("replicate"))
    )


def _half_sums(values: np.ndarray) -> np.ndarray:
    """The sums of all sign assignments of ``values``."""
    sums = np.zeros(1)
    for v in values:
        sums = np.concatenate((sums - v, sums + v))
    return sums


def _fitting(contrasts: DataFrame, limit: int) -> DataFrame:
    """Contrasts of at most ``limit`` differences; a larger one must not stop the others."""
    counted = contrasts.groupBy("contrast_id").agg(F.count(F.lit(1)).alias("n"))
    return contrasts.join(counted.filter(F.col("n") <= limit).select("contrast_id"), "contrast_id", "left_semi")


def sign_flip(contrasts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Exact two-sided sign-flip p-value over all 2^n assignments (n <= ``MAX_SIGN_FLIP``).

    The assignments of the two halves of the domains meet in the middle: the sums of one half
    are sorted, and for each sum of the other half two searches count the extreme totals. The
    other half is dealt over tasks in blocks. A larger contrast gets NULL.
    """
    arrays = contrast_arrays(_fitting(contrasts, MAX_SIGN_FLIP), MAX_SIGN_FLIP)
    first = F.floor(F.col("n") / 2).cast("int")
    blocks = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), first) / HALF_BLOCK).cast("int"))
    dealt = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).repartition("contrast_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ordered = None, np.zeros(1)
        for batch in batches:
            for row in batch.to_pylist():
                values, n = np.array(row["values"], float), row["n"]
                if row["contrast_id"] != known:
                    known, ordered = row["contrast_id"], np.sort(_half_sums(values[n // 2 :]))
                size = min(HALF_BLOCK, 1 << n // 2)
                low = n // 2 - (size.bit_length() - 1)  # domains whose signs name the block
                signs = [1 if row["block"] >> i & 1 else -1 for i in range(low)]
                others = _half_sums(values[low : n // 2]) + float(np.dot(signs, values[:low]))
                bound = (abs(values.mean()) - tolerance) * n
                over = len(ordered) - np.searchsorted(ordered, bound - others, "left")
                under = np.searchsorted(ordered, -bound - others, "right")
                # A bound of zero or less is met by every total.
                extreme = int((over + under).sum()) if bound > 0 else size * len(ordered)
                yield pa.RecordBatch.from_pylist([{"contrast_id": known, "extreme": extreme, "n": n}])

    counted = dealt.select("contrast_id", "n", "values", "block").mapInArrow(
        run, "contrast_id string, extreme bigint, n bigint"
    )
    exact = counted.groupBy("contrast_id").agg(
        F.pow(F.lit(2.0), F.max("n")).cast("bigint").alias("assignments"), F.sum("extreme").alias("_extreme")
    )
    named = contrasts.select("contrast_id").distinct()
    return named.join(exact, "contrast_id", "left").select(
        "contrast_id", "assignments", (F.col("_extreme") / F.col("assignments")).alias("sign_flip_p")
    )


def wilcoxon(contrasts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Exact two-sided signed-rank p-value; zero differences are dropped, ties share ranks.

    A contrast of more than ``MAX_SIGNED_RANK`` non-zero differences gets no row.
    """
    nonzero = contrasts.filter(F.col("difference") != 0)
    size = Window.partitionBy("contrast_id").orderBy(F.abs("difference"))
    tied = Window.partitionBy("contrast_id", F.abs("difference"))
    mid = F.rank().over(size) + (F.count(F.lit(1)).over(tied) - 1) / 2.0
    ranked = _fitting(nonzero, MAX_SIGNED_RANK).select(
        "contrast_id",
        "domain",
        F.when(F.col("difference") > 0, mid).otherwise(-mid).alias("difference"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                # Doubled mid-ranks are whole numbers: one halving per rank gives the chances of all sums.
                signed = np.round(2 * np.array(row["values"])).astype(np.int64)
                chances, upto = np.zeros(int(np.abs(signed).sum()) + 1), 0
                chances[0] = 1.0
                for r in np.abs(signed).tolist():
                    moved = 0.5 * chances[: upto + 1]
                    chances[: upto + 1] = moved
                    chances[r : r + upto + 1] += moved
                    upto += r
                far = np.abs(2 * np.arange(len(chances)) - upto) >= abs(int(signed.sum())) - tolerance
                p = float(chances[far].sum())
                yield pa.RecordBatch.from_pylist([{"contrast_id": row["contrast_id"], "wilcoxon_p": p}])

    arrays = contrast_arrays(ranked, MAX_SIGNED_RANK).repartition("contrast_id")
    return arrays.select("contrast_id", "values").mapInArrow(run, "contrast_id string, wilcoxon_p double")


def binomial_tail(trials: Column, upto: Column) -> Column:
    """Two-sided sign-test probability ``min(1, 2 * P(X <= upto))`` for fair coins."""
    # State: (binomial coefficient, running sum), so no factorial is ever formed.
    folded = F.aggregate(
        F.sequence(F.lit(0), upto.cast("int")),
        F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct(
            (a["c"] * (trials - k) / (k + 1)).alias("c"), (a["s"] + a["c"]).alias("s")
        ),
    )
    return F.least(F.lit(1.0), 2.0 * folded["s"] / F.pow(F.lit(2.0), trials.cast("double")))


def sign_test(contrasts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Exact two-sided sign test; 1 when every difference is a tie (no trial speaks against it)."""
    d = F.col("difference")
    counts = contrasts.groupBy("contrast_id").agg(
        F.count_if(d < -tolerance).alias("wins"),
        F.count_if(F.abs(d) <= tolerance).alias("ties"),
        F.count_if(d > tolerance).alias("losses"),
    )
    trials = F.col("wins") + F.col("losses")
    p = binomial_tail(trials, F.least("wins", "losses"))
    return counts.withColumn("sign_p", F.when(trials > 0, p).otherwise(1.0))


def t_interval(contrasts: DataFrame) -> DataFrame:
    """Mean, median, standard error and 95% Student t interval per contrast."""
    stats = contrasts.groupBy("contrast_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("difference").alias("mean"),
        F.percentile("difference", 0.5).alias("median"),
        (F.stddev_samp("difference") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"),
    )
    table = F.array(*[F.lit(v) for v in T_CRITICAL_95])
    # Beyond 30 degrees of freedom: Cornish-Fisher expansion around the normal quantile.
    z, df = F.lit(1.959963985), (F.col("n") - 1).cast("double")
    wide = z + (z * z * z + z) / (4.0 * df)
    critical = F.when(F.col("n") <= 31, F.get(table, (F.col("n") - 2).cast("int"))).otherwise(wide)
    half = critical * F.col("standard_error")
    return stats.withColumn("t_low", F.col("mean") - half).withColumn("t_high", F.col("mean") + half)


def small_sample_summary(contrasts: DataFrame) -> DataFrame:
    """All exact small-n statistics of every contrast in one table.

    The sign-flip test is NULL for a contrast with more than ``MAX_SIGN_FLIP`` domains, the
    signed-rank test for one with more than ``MAX_SIGNED_RANK`` non-zero differences; its
    other statistics, and those of other contrasts, stand.
    """
    parts = [t_interval(contrasts), sign_test(contrasts), sign_flip(contrasts), wilcoxon(contrasts)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "contrast_id", "left")
    return out
