"""Quantiles, curves, exports, contracts, joins and inference on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from railguard.functions import draws
from railguard.operators import contracts, curves, inference, joins, metrics, quantiles
from railguard.operators.layout import Keys, Trajectories
from railguard.plans import models
from railguard.sources import exports, nested, sinks, tables


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(400, 0.5), rng.random(601)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "g string, x double")
    got = {(r["g"], r["prob"]): r["quantile"]
           for r in quantiles.exact_quantiles(df, ["g"], "x", [0.0, 0.37, 0.5, 0.99, 1.0]).collect()}
    for p in (0.0, 0.37, 0.5, 0.99, 1.0):
        assert got[("a", p)] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got[("b", p)] == 1.0


def test_quantiles_of_several_columns_at_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 3_000
    wide = np.where(rng.random(n) < 0.5, np.exp(rng.normal(0, 60, n)), -rng.random(n))
    columns = {"smooth": rng.normal(size=n), "few": rng.integers(0, 11, n) / 100, "wide": wide, "tied": np.full(n, 2.5)}
    rows = [(*map(float, row), None if i % 3 else float(i), None) for i, row in enumerate(zip(*columns.values()))]
    df = spark.createDataFrame(rows, "smooth double, few double, wide double, tied double, holes double, none double")
    columns["holes"] = np.arange(0.0, n, 3)
    probs = [0.0, 0.5, *[i / 32 for i in range(1, 32)], 1.0]
    for bound in (quantiles.ORDERED, 3):  # the small one narrows cells again and again
        monkeypatch.setattr(quantiles, "ORDERED", bound)
        got = quantiles.column_quantiles(df, [*columns, "none"], probs)
        assert got.pop("none") == []
        for name, values in columns.items():
            assert got[name] == pytest.approx(np.quantile(values, probs), rel=1e-12, abs=1e-14)


def test_trees_pass_over_cells_not_records(spark, monkeypatch):
    rows = [(float(i % 40), None if i % 7 == 0 else float(i % 5), 1.0 + i % 3, 0.1 * (i % 5) + 0.01 * (i % 40)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "a double, b double, w double, truth double")
    fitted = []
    kept = models.durable
    monkeypatch.setattr(models, "durable", lambda cells: fitted.append(kept(cells)) or fitted[-1])
    for kind, bound in (("boosting", 0.02), ("forest", 0.05)):
        pipeline = models.build_pipeline(["a", "b"], "truth", kind=kind, weight="w", **({"numTrees": 8} if kind == "forest" else {}))
        scored = models.predict(pipeline.fit(df.unionAll(df)), df)
        error = scored.filter("b IS NOT NULL").agg(F.avg(F.abs(F.col("prediction") - F.col("truth")))).first()[0]
        assert error < bound
        cells = fitted[-1]
        assert cells.count() <= 240
        # Every record is in a cell: weights and weighted labels add up.
        sums = cells.agg(F.sum(models.CELL_WEIGHT), F.sum(F.col(models.CELL_WEIGHT) * F.col("truth"))).first()
        assert sums[0] == pytest.approx(2 * sum(r[2] for r in rows))
        assert sums[1] == pytest.approx(2 * sum(r[2] * r[3] for r in rows))


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 0.2), ("a", 2.0, 0.4), ("a", 3.0, 0.4), ("b", 5.0, 1.0)],
                               "g string, x double, w double")
    got = {r["g"]: r["weighted_median"] for r in quantiles.weighted_median(df, ["g"], "x", "w").collect()}
    assert got == {"a": 2.0, "b": 5.0}


def curve(n=64, step=12.0, **change):
    t = np.arange(n) * step
    row = {"current": np.full(n, 1.1), "voltage": 3.0 + 0.001 * t, "charge": 1.1 * t / 3600,
           "time": t, "temperature": np.full(n, 25.0), "nominal": 1.1}
    row.update(change)
    return tuple(x if np.isscalar(x) else [None if v is None else float(v) for v in x] for x in row.values())


def early(spark, rows):
    schema = ("current array<double>, voltage array<double>, charge array<double>, time array<double>, "
              "temperature array<double>, nominal double")
    df = spark.createDataFrame(rows, schema)
    return curves.early_features(
        df, current="current", voltage="voltage", charge="charge", time="time",
        temperature="temperature", nominal=F.col("nominal"),
    ).collect()


def test_curve_features_of_a_straight_line(spark):
    row = early(spark, [curve()])[0]
    f = row["features"]
    assert row["reason"] is None
    assert f["voltage_at_300s"] == pytest.approx(3.3)
    assert f["voltage_slope_per_hour"] == pytest.approx(3.6)
    assert f["current_c_mean"] == pytest.approx(1.0) and f["points"] == 51.0
    assert f["delta_q_per_nominal"] == pytest.approx(600 / 3600)
    assert f["temperature_available"] == 1.0 and f["temperature_mean"] == pytest.approx(25.0)


def test_curve_rejections_in_order(spark):
    n = 64
    t = np.arange(n) * 12.0
    nan = [math.nan] * n
    cases = {
        "misaligned_or_short_charge_arrays": curve(voltage=np.ones(5)),
        "invalid_nominal_capacity": curve(nominal=0.0),
        "no_positive_charge_increment": curve(charge=np.zeros(n)),
        "insufficient_finite_charge_points": curve(current=nan),
        "charge_window_not_covered": curve(time=np.arange(n) * 1.0),
        "insufficient_points_in_charge_window": curve(n=4, step=500.0),
        "nonpositive_early_charge_throughput": curve(charge=np.where(t < 20, t, 1.0 - t)),
    }
    got = [r["reason"] for r in early(spark, list(cases.values()))]
    assert got == list(cases)


def test_clock_reset_and_nan_points_are_handled(spark):
    n = 64
    t = np.arange(n) * 12.0
    t[40:] -= t[40] - 12.0  # the clock restarts
    volts = 3.0 + 0.001 * np.arange(n) * 12.0
    volts[5] = math.nan
    row = early(spark, [curve(time=t, voltage=volts)])[0]
    assert row["reason"] is None and row["features"]["points"] == 50.0
    assert row["features"]["voltage_at_60s"] == pytest.approx(3.06)


def test_row_form_equals_array_form(spark):
    rng = np.random.default_rng(5)
    n = 80
    t = np.cumsum(rng.uniform(5, 20, n))
    v, i = 3 + rng.random(n), 0.5 + rng.random(n)
    q = np.cumsum(rng.random(n) * 0.01)
    wide = early(spark, [curve(n=n, time=t, voltage=v, current=i, charge=q)])[0]["features"]
    rows = [("d", "u", k, float(t[k]), float(v[k]), float(i[k]), float(q[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "domain string, unit string, pos int, t double, v double, i double, q double")
    long = curves.features_from_rows(
        Trajectories.plan(df, Keys(order=("pos",))), current="i", voltage="v", charge="q", time="t", nominal=1.1
    ).first()["features"].asDict()
    for name, value in long.items():
        assert value == pytest.approx(wide[name], abs=1e-9), name


def export_files(folder):
    (folder / "a.txt").write_text(
        "~ made by hand\n~Time[h],U[V],I[A],Ah[Ah],Cyc-Count\n0.0,3.1,0.5,77777,1\n0.1,3.2,0.5,77777,1\nx,3.3,0.5,1,2,9,9,9\n"
    )
    (folder / "b.txt").write_bytes(
        "~ caf\xb5\n~Time[h] U[V] I[A] Ah[Ah] Cyc-Count\n0,5 3,1 -0,5 1,25 7\n".encode("latin-1")
    )
    return str(folder)


def test_text_exports(spark, tmp_path):
    lines = exports.read_lines(spark, export_files(tmp_path))
    rows = exports.with_seconds(exports.prediction_fields(lines)).orderBy("file", "line").collect()
    assert [r["file"] for r in rows] == ["a.txt", "a.txt", "b.txt"]
    assert [r["seconds"] for r in rows] == [0.0, 360.0, 1800.0]
    # The outcome counter never reaches the prediction side.
    assert not any("77777" in str(r) for r in rows)
    label = exports.label_fields(lines).filter("file = 'b.txt'").select(exports.number("cumulative_raw")).first()
    assert label[0] == 1.25
    assert exports.header_inventory(lines).agg(F.sum("files")).first()[0] == 2


def test_two_headers_are_refused(spark, tmp_path):
    head = "~Time[h],U[V],I[A],Ah[Ah],Cyc-Count\n"
    (tmp_path / "c.txt").write_text(head + head + "0,1,1,1,1\n")
    with pytest.raises(contracts.ContractViolation):
        exports.prediction_fields(exports.read_lines(spark, str(tmp_path)))


def test_clock_text(spark):
    df = spark.createDataFrame([("1:02:03,5",), ("bad",)], "x string")
    assert [r[0] for r in df.select(exports.clock_seconds("x")).collect()] == [3723.5, None]


def test_nested_units_from_json(spark, tmp_path):
    (tmp_path / "u.json").write_text(
        '{"cell_id": "c1", "nominal_capacity_in_Ah": 1.0, "cycle_data": [{"cycle_number": 2, "current_in_A": [1, 2]}]}\n'
    )
    units = nested.read_units(spark, str(tmp_path), "json")
    row = nested.explode_cycles(units, ["cell_id"]).first()
    assert (row["cycle_index"], row["cycle_number"], row["current_in_A"]) == (0, 2, [1.0, 2.0])


def test_sinks_refuse_overwrite_and_manifest_sees_changes(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "t")
    assert sinks.write_parquet(df, path) == 10
    with pytest.raises(Exception):
        sinks.write_parquet(df, path)
    before = sinks.file_manifest(spark, str(tmp_path), "*.parquet")
    saved = spark.createDataFrame([r for r in before.collect()], before.schema)
    (tmp_path / "t" / "extra.parquet").write_bytes(b"x")
    diff = sinks.manifest_difference(saved, sinks.file_manifest(spark, str(tmp_path), "*.parquet"))
    assert [r["status"] for r in diff.collect()] == ["untracked"]


def test_contracts(spark):
    df = spark.createDataFrame([("A", 1.0), (None, math.nan), ("  ", 2.0), ("NaN", math.inf)], "id string, x double")
    assert contracts.blank_ids(df, "id").count() == 3
    assert contracts.not_finite(df, ["x"]).first()["violations"] == 2
    with pytest.raises(contracts.ContractViolation):
        contracts.require_columns(df, ["id", "y"])
    with pytest.raises(contracts.ContractViolation):
        contracts.forbid_columns(["a", "truth"], ["truth"])
    with pytest.raises(contracts.ContractViolation):
        contracts.forbid_columns(["a", "a"], [])
    with pytest.raises(contracts.ContractViolation):
        contracts.enforce(contracts.blank_ids(df, "id"), "ids")


def test_joins_fail_closed(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 5.0)], "k int, y double")
    with pytest.raises(contracts.ContractViolation):
        joins.complete_join(a, b, ["k"])
    with pytest.raises(Exception):
        joins.lookup(a, b, ["k"]).agg(F.sum("x")).select("*").collect() and joins.lookup(a, b, ["k"]).collect()
    assert joins.lookup(a, b, ["k"], required=False).count() == 2
    with pytest.raises(contracts.ContractViolation):
        joins.lookup(a, b.union(b), ["k"])


def test_strict_json_and_csv(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"x": NaN}')
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "bad.json"), "x double").collect()
    (tmp_path / "t.csv").write_text("x,y\n1,a\n")
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), "x int, y string").first()["x"] == 1


def contrast(spark, values, name="c"):
    rows = [(name, f"d{i:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "contrast_id string, domain string, difference double")


def test_sign_flip_and_wilcoxon_against_enumeration(spark):
    values = np.array([-0.3, -0.1, 0.05, -0.2, -0.4, 0.1, -0.15, -0.25, -0.35, -0.05, -0.6, -0.7])
    df = contrast(spark, values)
    codes = np.arange(1 << len(values))
    signs = np.where((codes[:, None] >> np.arange(len(values))) & 1, 1.0, -1.0)
    want = np.mean(np.abs((signs * values).mean(axis=1)) >= abs(values.mean()) - 1e-12)
    row = inference.sign_flip(df).first()
    assert row["assignments"] == 4096 and row["sign_flip_p"] == pytest.approx(want)
    order = np.abs(np.round(values, 10))
    ranks = np.array([(np.sum(order < v) + (np.sum(order == v) + 1) / 2) for v in order])
    stat = abs(np.sum(np.sign(values) * ranks))
    want = np.mean(np.abs((signs * ranks).sum(axis=1)) >= stat - 1e-12)
    assert inference.wilcoxon(df).first()["wilcoxon_p"] == pytest.approx(want, abs=0.02)


def test_published_small_sample_values(spark):
    # Eleven wins and one loss of twelve: two-sided sign test 26 / 4096.
    row = inference.sign_test(contrast(spark, [-1.0] * 11 + [1.0])).first()
    assert row["sign_p"] == pytest.approx(26 / 4096)
    # Six of six wins: 2 / 64; all ties: no p-value.
    assert inference.sign_test(contrast(spark, [-1.0] * 6)).first()["sign_p"] == pytest.approx(2 / 64)
    assert inference.sign_test(contrast(spark, [0.0] * 4)).first()["sign_p"] == 1.0


def test_sign_flip_meets_in_the_middle(spark, monkeypatch):
    monkeypatch.setattr(inference, "HALF_BLOCK", 8)
    draw = np.random.default_rng(8)
    groups = {f"n{n}": np.round(draw.normal(0.2, 1, n), 1) for n in (1, 2, 3, 9, 14)} | {"none": np.zeros(5)}
    rows = [(c, f"d{i:03}", float(x)) for c, v in groups.items() for i, x in enumerate(v)]
    got = {r["contrast_id"]: r for r in inference.sign_flip(spark.createDataFrame(rows, "contrast_id string, domain string, difference double")).collect()}
    for c, v in groups.items():
        signs = np.where((np.arange(1 << len(v))[:, None] >> np.arange(len(v))) & 1, 1.0, -1.0)
        want = np.mean(np.abs((signs * v).mean(axis=1)) >= abs(v.mean()) - 1e-12)
        assert (got[c]["assignments"], got[c]["sign_flip_p"]) == (1 << len(v), want)


def test_sign_flip_of_forty_domains_and_beyond_the_limit(spark):
    # 36 equal differences: only all-equal signs reach the mean; 40: two of them disagree.
    rows = [("equal", f"d{i:03}", 0.25) for i in range(36)]
    rows += [("mixed", f"d{i:03}", -1.0 if i < 2 else 1.0) for i in range(40)]
    rows += [("large", f"d{i:03}", 0.5) for i in range(inference.MAX_SIGN_FLIP + 1)]
    df = spark.createDataFrame(rows, "contrast_id string, domain string, difference double")
    got = {r["contrast_id"]: r["sign_flip_p"] for r in inference.sign_flip(df).collect()}
    assert got["equal"] == 2 / 2**36 and got["large"] is None
    assert got["mixed"] == 2 * sum(math.comb(40, k) for k in range(3)) / 2**40


def test_one_wide_contrast_stops_no_other(spark):
    from railguard.plans.workflows import robustness

    rows = [(c, f"d{i:03}", -0.1 - i / 1000, 5, 50) for c, n in (("few", 6), ("wide", 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "contrast_id string, domain string, difference double, units bigint, records bigint")
    got = {r["contrast_id"]: r for r in robustness(df).collect()}
    assert got["few"]["sign_flip_p"] == 2 / 64 and got["wide"]["sign_flip_p"] is None and got["wide"]["wins"] == 60


def test_bootstrap_interval_is_close_to_theory(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(-0.5, 1.0, 60)
    row = inference.cluster_bootstrap(contrast(spark, values), reps=2000, seed=5).first()
    half = 1.96 * values.std() / math.sqrt(60)
    assert row["point"] == pytest.approx(values.mean())
    assert row["low"] == pytest.approx(values.mean() - half, abs=0.06)
    assert row["high"] == pytest.approx(values.mean() + half, abs=0.06)


def test_hierarchical_means_differ_from_a_flat_mean(spark):
    rows = [("a", "u1", 0.0, 0, 1.0, 0.0)] * 1 + [("a", "u2", float(i), i, 0.2, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "domain string, unit string, order_key double, ordinal bigint, m double, truth double")
    units = metrics.unit_metrics(Trajectories.plan(df), ["m"])
    got = metrics.domain_summary(units).first()
    assert got["unit_macro_mae"] == pytest.approx(0.6) and got["units"] == 2


def test_a_large_contrast_does_not_stop_the_summary(spark):
    large = spark.createDataFrame([("large", f"d{i}", 0.1 * i - 1) for i in range(inference.MAX_SIGN_FLIP + 6)], "contrast_id string, domain string, difference double")
    small = spark.createDataFrame([("small", f"d{i}", 0.5) for i in range(5)], "contrast_id string, domain string, difference double")
    rows = {r["contrast_id"]: r for r in inference.small_sample_summary(large.unionByName(small)).collect()}
    assert rows["small"]["sign_flip_p"] == pytest.approx(2 / 32)
    assert rows["large"]["sign_flip_p"] is None and rows["large"]["sign_p"] is not None


def test_clusters_must_name_a_shared_folder():
    from railguard.session import is_one_process

    assert is_one_process("local") and is_one_process("local[8]")
    assert not any(map(is_one_process, ("local-cluster[2,1,1024]", "yarn", "spark://h:7077")))


def test_signed_rank_beyond_the_sign_flip_limit(spark):
    draw = np.random.default_rng(5)
    groups = {
        "many": np.round(draw.normal(0.3, 1, 60), 1),  # ties and zeros
        "zeros": np.r_[np.zeros(30), draw.normal(0.5, 1, 10)],
        "huge": draw.normal(0, 1, inference.MAX_SIGNED_RANK + 1),
    }
    rows = [(c, f"d{i:03}", float(x)) for c, v in groups.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "contrast_id string, domain string, difference double")
    got = {r["contrast_id"]: r for r in inference.small_sample_summary(df).collect()}
    for c in ("many", "zeros"):
        v = groups[c][groups[c] != 0]
        size = np.abs(v)
        ranks = [int((size < x).sum() * 2 + (size == x).sum() + 1) for x in size]
        ways = {0: 1}
        for r in ranks:
            more = dict(ways)
            for k, n in ways.items():
                more[k + r] = more.get(k + r, 0) + n
            ways = more
        seen = abs(sum(r if x > 0 else -r for r, x in zip(ranks, v)))
        want = sum(n for k, n in ways.items() if abs(2 * k - sum(ranks)) >= seen) / 2 ** len(v)
        assert got[c]["wilcoxon_p"] == pytest.approx(want, rel=1e-9)
    # Zero differences do not move a total: the ten others decide among 2^40 assignments.
    v = groups["zeros"][30:]
    signs = np.where((np.arange(1 << 10)[:, None] >> np.arange(10)) & 1, 1.0, -1.0)
    want = np.mean(np.abs((signs * v).sum(axis=1)) >= abs(v.sum()) - 1e-9)
    assert got["zeros"]["sign_flip_p"] == want and got["many"]["sign_flip_p"] is None
    assert got["huge"]["wilcoxon_p"] is None and got["huge"]["sign_p"] is not None


def test_a_sealed_table_opens_only_unchanged(spark, tmp_path):
    from railguard.operators.contracts import ContractViolation
    from railguard.sources import sinks

    rows = [(i, [0.1 * i, None], None if i % 3 else f"r{i}") for i in range(50)] + [(7, [0.7, None], "twin")] * 2
    df = spark.createDataFrame(rows, "id bigint, values array<double>, name string")
    path = str(tmp_path / "a")
    assert sinks.seal(df, path) == 52 and sinks.open_sealed(spark, path).count() == 52
    # Neither order nor files matter; one value, one more copy or one lost row does.
    same = sinks.fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert same == sinks.fingerprint(df).first()
    for i, other in enumerate((
        df.withColumn("name", F.when(F.col("id") == 3, "x").otherwise(F.col("name"))),
        df.unionByName(df.limit(1)),
        df.dropDuplicates(["id", "name"]),
        df.withColumn("id", F.col("id").cast("int")),
        df.withColumn("name", F.coalesce("name", F.lit(""))),
    )):
        changed = str(tmp_path / f"b{i}")
        sinks.seal(df, changed)
        other.write.parquet(f"{changed}/table", mode="overwrite")
        with pytest.raises(ContractViolation):
            sinks.open_sealed(spark, changed)
    assert sinks.seal(df.limit(0), str(tmp_path / "empty")) == 0
    assert sinks.open_sealed(spark, str(tmp_path / "empty")).count() == 0


def test_overlapping_draws_are_worked_out_once(monkeypatch):
    m, worked, index_at = 4_000, [], draws.index_at
    monkeypatch.setattr(draws, "index_at", lambda places, *a: worked.append(len(places)) or index_at(places, *a))
    values = np.random.default_rng(5).integers(-(1 << 40), 1 << 40, (m, 2))
    # Neighbours, one far away, and one that passes the end of the ring.
    starts = np.array([*range(100, 160), 10**9, draws.MODULUS - 1_500])
    whole = np.zeros((len(starts), 2), np.int64)
    for part in range(3):
        low, high = (draws.MODULUS * (part + k) // 3 for k in (0, 1))
        number, sums = draws.stretch_sums(values, 2, starts, low, high)
        np.add.at(whole, number, sums)
    x = (np.int64(draws.STEPS[2]) * ((starts[:, None] + np.arange(m)) % draws.MODULUS)) % draws.MODULUS
    fifth = (((x * x) % draws.MODULUS) ** 2 % draws.MODULUS) * x % draws.MODULUS
    assert (whole == values[fifth * draws.MULTIPLIER % draws.MODULUS % m].sum(1)).all()
    # The first ones and the end of the last one cover 0 to m + 159.
    assert sum(worked) == (m + 159) + m + 1_500
    starts = draws.first_place(18, 2, np.arange(40), 3)
    number, sums = draws.stretch_sums(values[:9], 2, starts, 0, draws.MODULUS)
    assert (sums[np.argsort(number)] == values[draws.uniform_index_array(9, 18, np.arange(40)[:, None], 3, np.arange(9))].sum(1)).all()


def test_ring_gives_the_replicates_of_single_draws(spark):
    units = spark.range(600).selectExpr(
        "IF(id % 2 = 0, 'a', 'b') AS contrast_id", "CONCAT('d', id % 7 % 3) AS domain", "CONCAT('u', id) AS unit",
        "CAST(id * 37 % 101 AS DOUBLE) / 101 - 0.4 AS difference",
    ).filter("NOT (contrast_id = 'b' AND domain = 'd1' AND unit > 'u3')").cache()
    arrays = inference.unit_arrays(units)
    both = [
        (inference.two_stage_by_ring(inference.ring_rows(units), 300, 5), inference.two_stage_by_arrays(arrays, 300, 5), []),
        (inference.units_by_ring(inference.ring_rows(units), 300, 5), inference.units_by_arrays(arrays, 300, 5), ["domain"]),
    ]
    for ring, single, more in both:
        key = ["contrast_id", *more]
        a, b = (sorted((*[r[k] for k in key], r["replicate"]) for r in df.collect()) for df in (ring, single))
        assert len(a) == len(b) and [x[:-1] for x in a] == [x[:-1] for x in b]
        assert max(abs(x[-1] - y[-1]) for x, y in zip(a, b)) < 1e-14
    assert inference.ring_rows(units, domains=2) is None
    broken = units.withColumn("difference", F.expr("IF(unit = 'u5', double('NaN'), difference)"))
    assert inference.ring_rows(broken) is None
