"""Hand-made cases: rules, policy, coercions, splits, thresholds, drift, calibration, trees, contract."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import (
    ablation, calibration, cleaning, contract, features, fusion, joins, leakage, metrics, monitoring, ordering, policy, prep, reports, schema, scoring, splits, thresholds,
)
from riskloom.plans.online_queries import TREES


def values(df, *cols, order=None):
    rows = df.orderBy(order).collect() if order else df.collect()
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in rows]


# --- rules and policy ------------------------------------------------------------------------

@pytest.mark.parametrize(
    "amount,country,destination,recent,new,flags,score,decision",
    [
        (5000.0, "AR", "acc_456", 0, False, (False, False, False, False), 0, "allowed"),
        (15000.0, "BR", "acc_999", 0, False, (True, True, False, True), 65, "challenged"),
        (15000.0, "BR", "acc_999", 3, False, (True, True, True, True), 100, "blocked"),
        (15000.0, "AR", "acc_999", 0, False, (True, False, False, True), 40, "challenged"),
        (99999.0, "JP", "acc_unknown", 0, True, (False, False, False, False), 0, "allowed"),
    ],
)
def test_rules(spark, amount, country, destination, recent, new, flags, score, decision):
    known = ([], []) if new else (["AR", "UY"], ["acc_456", "acc_789"])
    row = (amount, country, destination, 0.0 if new else 4500.0, 0.0 if new else 1200.0, recent, *known)
    df = spark.createDataFrame(
        [row], "amount double, country string, destination string, avg_amount double, std_dev_amount double, tx_last_10min int, countries array<string>, destinations array<string>"
    )
    out = policy.rule_score(df, policy.unknown_to("country", "countries"), policy.unknown_to("destination", "destinations")).first()
    assert tuple(out[f"flag_{k}"] for k in ("amount", "country", "velocity", "destination")) == flags
    assert (out["rule_score"], out["rule_decision"]) == (score, decision)


def test_policy(spark):
    df = spark.createDataFrame([(0.0, True), (0.1499, True), (0.15, True), (0.5499, True), (0.55, True), (1.0, True), (None, True), (0.9, False)], "s double, ok boolean")
    assert values(df.select(policy.policy_action("s", F.col("ok")).alias("a")), "a") == ["allow", "allow", "review", "review", "block", "block", "review", "review"]
    gap = policy.Policy((policy.ActionRange("low", None, 0.2), policy.ActionRange("high", 0.4, None)))
    with pytest.raises(Exception, match="no action range"):
        df.select(policy.policy_action(F.lit(0.3), True, gap)).collect()
    with pytest.raises(ValueError):
        policy.validate_policy_ranges(policy.Policy((policy.ActionRange("a", None, 0.5), policy.ActionRange("b", 0.4, None))))
    with pytest.raises(ValueError):
        policy.validate_policy_ranges(policy.Policy((policy.ActionRange("a", 0.5, 0.5),)))


def test_decision_labels(spark):
    df = spark.createDataFrame([("allow", 0.125), ("review", 0.995), ("block", 0.5), ("other", 0.0)], "a string, s double")
    d, s = policy.decision_label("a", "s")
    assert values(df.select(d.alias("d"), s.alias("s")), "d", "s") == [("allowed", 13), ("challenged", 100), ("blocked", 50), ("challenged", 0)]


# --- typing ------------------------------------------------------------------------------------

def test_coercions(spark):
    texts = ["1d", "nan", "inf", " 12 ", "3.0", "3.5", "0x10", "1_000", "", None, "1e3", ".5", "-7", "+2."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", C.coerce_numeric("t").alias("n"), C.coerce_integer("t").alias("k"))
    assert values(got, "n", order="i") == [None, None, math.inf, 12.0, 3.0, 3.5, None, None, None, None, 1000.0, 0.5, -7.0, 2.0]
    assert values(got, "k", order="i") == [None, None, None, 12, 3, None, None, None, None, None, 1000, None, -7, 2]
    flags = spark.createDataFrame([(i, t) for i, t in enumerate(["Found", "NOTFOUND", " y ", "0", "2", "", None])], "i int, t string")
    assert values(flags.select("i", C.coerce_boolean("t").alias("b")), "b", order="i") == [True, False, True, False, None, None, None]
    times = spark.createDataFrame([(0, "2024-02-30"), (1, "2024-02-03"), (2, "12:30:00"), (3, "2024-02-03T04:05:06Z"), (4, "x")], "i int, t string")
    assert [v is not None for v in values(times.select("i", C.coerce_timestamp("t").alias("x")), "x", order="i")] == [False, True, False, True, False]


def test_headers_and_groups():
    assert schema.normalize_columns([" TransactionID ", "transaction id", "nameOrig", "###", "HTTPCode", "a--b__c", "A b C"]) == [
        "transaction_id", "transaction_id_2", "name_orig", "column", "http_code", "a_b_c", "a_b_c_2"
    ]
    roles = schema.assign_roles(["transaction_id", "card1", "card4", "card12", "c14", "v258", "id_02", "id_2", "id_12", "m1", "m4", "oldbalance_org", "step", "timestamp", "x"])
    assert roles["number"] == ["card1", "c14", "v258", "id_02", "oldbalance_org"]
    assert roles["flag"] == ["id_12", "m1"] and roles["text"] == ["transaction_id", "card4", "m4"]
    assert roles["balance"] == ["oldbalance_org"] and roles["whole"] == ["step"] and roles["sequence"] == ["timestamp", "step"]
    assert schema.header_words("ABc1De fG-h") == ["a", "bc1", "de", "f", "g", "h"]


def test_feature_columns(spark):
    df = spark.createDataFrame([(1, True, "a", 1.0, 2, 3)], "x int, flag boolean, t string, _hidden double, transaction_order int, is_fraud int")
    assert schema.select_feature_columns(df.schema, ("is_fraud",)) == ["x", "flag"]
    assert schema.select_feature_columns(df.schema, ("is_fraud",), include_positions=True) == ["x", "flag", "transaction_order"]
    with pytest.raises(ValueError):
        schema.choose_column(df, ["a", "b"])
    assert schema.choose_column(df, ["a"], optional=True) is None


def test_dedupe_nulls_and_files(spark):
    rows = [("b", 1, 1, "x", None), ("a", 2, 2, "x", None), ("a", 1, 1, "y", "1"), ("b", 2, 2, "y", "1"), ("b", 3, 3, "y", None)]
    df = spark.createDataFrame(rows, "source_file string, source_row_number bigint, source_file_row_number bigint, p string, q string")
    for sources in (None, ["a", "b"]):
        got = cleaning.dedupe_exact_keep_first(df, sources=sources).collect()
        assert sorted((r.source_file, r.source_row_number, r.p, r.q or "") for r in got) == [("a", 1, "y", "1"), ("a", 2, "x", ""), ("b", 3, "y", "")]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(2, "p"), (1, "q")], "n int, Name string")
    b = spark.createDataFrame([(1, 5)], "n int, Amount int")
    got = cleaning.union_sources({"b": b, "a": a}, ["n"]).orderBy("source_file", "source_row_number").collect()
    assert [(r.source_file, r.source_row_number, r.name, r.amount) for r in got] == [("a", 1, "q", None), ("a", 2, "p", None), ("b", 1, None, 5)]
    with pytest.raises(ValueError):
        cleaning.join_side_table(a, spark.createDataFrame([(1,), (1,)], "n int"), "n")


# --- ordering, splits ----------------------------------------------------------------------------

@pytest.mark.parametrize("n,k", [(7, 0), (7, 1), (7, 7), (7, 8), (7, 2), (100, 33), (1, 1), (1000, 999)])
def test_even_take(spark, n, k):
    got = sorted(values(ordering.even_take(spark.range(n), k, ["id"]), "id"))
    assert got == (list(range(n)) if k >= n else [] if k <= 0 else np.linspace(0, n - 1, num=k, dtype=int).tolist())


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_partition_counts_do_not_matter(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        pdf = pd.DataFrame({"id": range(500), "v": [(i * 37) % 50 / 10 if i % 9 else None for i in range(500)]})
        df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).orderBy(F.rand(3))
        got = [r.id for r in ordering.global_ordinal(df, ["v", "id"]).orderBy("ordinal").collect()]
        assert got == pdf.sort_values(["v", "id"], na_position="last")["id"].tolist()
        q = ordering.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0]).first()
        assert np.allclose([q[f"q{i}"] for i in range(5)], np.quantile(pdf["v"].dropna(), [0.0, 0.25, 0.5, 0.99, 1.0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_running_totals_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)], "g string, v double, n bigint")
    got = {(r.g, r.v): (r.cum_n, r.total_n) for r in ordering.running_totals(df, "v", ["n"], ["g"]).collect()}
    assert got == {(None, 2.0): (3, 5), (None, 1.0): (5, 5), ("a", 1.0): (5, 5)}


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_proportions(spark, n):
    df = ordering.global_ordinal(spark.range(n), ["id"])
    got = dict(values(splits.split_by_proportions(df).groupBy("split").count(), "split", "count"))
    train, valid = int(n * 0.7), int(n * 0.15)
    assert got == {k: v for k, v in (("train", train), ("valid", valid), ("test", n - train - valid)) if v}


def test_cutoffs(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (9,), (10,), (None,)], "t int")
    out = splits.split(df, splits.SplitStrategy("cutoffs", cutoffs={"train_end": 5, "valid_end": 9}), "t")
    assert values(out, "t", "split", order="t") == [(1, "train"), (5, "train"), (6, "valid"), (9, "valid"), (10, "test")]
    for bad in (splits.SplitStrategy("x"), splits.SplitStrategy("proportions", {"train": 1.0}), splits.SplitStrategy("proportions", {"train": 0.5, "valid": 0.1, "test": 0.1}), splits.SplitStrategy("cutoffs", cutoffs={})):
        with pytest.raises(ValueError):
            splits.split(df, bad, "t")


def test_downsampling_edges(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(20)], "id int, is_fraud int")
    assert splits.downsample_majority(df, 2.0, ["id"]).count() == 9
    assert splits.downsample_majority(df, 50.0, ["id"]).count() == 20
    assert splits.downsample_majority(df.where("is_fraud = 0"), 1.0, ["id"]).count() == 17
    with pytest.raises(ValueError):
        splits.downsample_majority(df, 0, ["id"])
    sample = splits.importance_sample(df.withColumn("transaction_id", F.col("id").cast("string")), 10)
    assert sample.count() == 10 and sample.where("is_fraud = 1").count() == 3
    assert splits.importance_sample(df.withColumn("transaction_id", F.col("id").cast("string")), 2).count() == 2


# --- metrics ----------------------------------------------------------------------------------------

def scores(spark, pairs):
    return spark.createDataFrame([(str(i), y, float(s), int(s >= 0.5)) for i, (y, s) in enumerate(pairs)], "transaction_id string, is_fraud int, score double, predicted_label int")


def brute_ap(pairs):
    total, ap, last = sum(y for y, _ in pairs), 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        hit = [y for y, s in pairs if s >= t]
        ap += (sum(hit) / total - last) * sum(hit) / len(hit)
        last = sum(hit) / total
    return ap


def test_rank_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(rng.random() < 0.3), round(float(rng.random()), 1)) for _ in range(200)]
    out = metrics.evaluate(scores(spark, pairs)).first()
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    auc = np.mean([[1.0 if p > q else 0.5 if p == q else 0.0 for q in neg] for p in pos])
    assert out["average_precision"] == pytest.approx(brute_ap(pairs)) and out["roc_auc"] == pytest.approx(auc)


def test_single_class_and_empty(spark):
    one = metrics.evaluate(scores(spark, [(0, 0.2), (0, 0.9)])).first()
    assert one["roc_auc"] is None and one["average_precision"] == 0.0 and one["precision"] == 0.0 and one["f1"] == 0.0
    empty = scores(spark, [(0, 0.1)]).where("score > 1")
    assert metrics.best_f1_threshold(empty).first()["threshold"] == 0.5
    assert thresholds.alert_budget_threshold(empty, [5.0]).first()["threshold"] == 1.0


def test_best_threshold_ties(spark):
    # Thresholds 0.8 (P=1, R=1/2) and 0.2 (P=1/2, R=1) both give F1 = 2/3: higher precision wins.
    got = metrics.best_f1_threshold(scores(spark, [(1, 0.8), (0, 0.5), (0, 0.4), (1, 0.2)])).first()
    assert (got["threshold"], got["precision"]) == (0.8, 1.0)
    assert metrics.resolve_threshold(scores(spark, [(1, 0.8)]), "fixed", 0.3).first()["threshold"] == 0.3
    with pytest.raises(ValueError):
        metrics.resolve_threshold(scores(spark, [(1, 0.8)]), "other")


def test_infeasible_precision(spark):
    df = scores(spark, [(0, 0.9), (1, 0.5), (0, 0.1)])
    got = {r.target: (r.feasible, r.threshold) for r in thresholds.precision_target_threshold(df, [0.3, 0.5, 0.9]).collect()}
    assert got == {0.3: (True, 0.5), 0.5: (True, 0.5), 0.9: (False, None)}
    table = thresholds.operating_table(thresholds.operating_points(df, df, thresholds.BudgetConfig((1000.0,), (0.9,))))
    assert table.where("selection_type = 'precision_target'").first()["valid_f1"] is None


def test_leakage_overlap_raises(spark):
    ids = spark.createDataFrame([("a", "train"), ("a", "test")], "transaction_id string, split string")
    with pytest.raises(ValueError):
        leakage.leakage_checks(ids, ids, ids)


# --- drift, latency, reports -----------------------------------------------------------------------------

def numpy_psi(ref, cur, bins):
    ref, cur = (np.asarray(x, float)[np.isfinite(x)] for x in (ref, cur))
    if not ref.size or not cur.size:
        return 0.0
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    if edges.size < 2:
        return 0.0
    r, c = (np.histogram(x, edges)[0] for x in (ref, cur))
    r, c = (np.maximum(x / max(x.sum(), 1), 1e-9) for x in (r, c))
    return float(np.sum((c - r) * np.log(c / r)))


@pytest.mark.parametrize(
    "ref,cur",
    [
        ([1.0] * 20, [1.0, 2.0]), (list(range(50)), [100.0, -5.0]), ([0.1, 0.2, math.nan, math.inf, 0.9], [0.15, math.nan, 0.95]), ([1.0, 2.0], []),
        ([0.0] * 30 + [1.0] * 3 + [2.0, 3.0], [0.0, 0.5, 1.0, 3.0, 3.0]), (list(np.linspace(0, 1, 101)), list(np.linspace(0.2, 1.3, 77))),
    ],
)
def test_psi(spark, ref, cur):
    frames = [spark.createDataFrame([(float(x),) for x in side], "x double") for side in (ref, cur)]
    assert monitoring.psi(*frames, "x", 10).first()["psi"] == pytest.approx(numpy_psi(ref, cur, 10))


def test_summaries(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    got = reports.distribution_summary(df, ["x"]).first()
    assert (got["count"], got["min"], got["p50"], got["p99"]) == (1, 5.0, 5.0, 5.0)
    none = reports.distribution_summary(df.where("x > 9"), ["x"]).first()
    assert (none["count"], none["mean"], none["p95"]) == (0, 0.0, 0.0)
    assert [reports.clamp_limit(x) for x in (None, "abc", 0, -3, 50, "7", 1000)] == [20, 20, 1, 1, 50, 7, 100]


def test_recent_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 5), ("c", 5), ("d", 9)], "transaction_id string, processed_at int")
    assert values(reports.recent_transactions(df, 3), "transaction_id") == ["d", "c", "b"]


# --- calibration and fusion ------------------------------------------------------------------------------------

def test_isotonic_apply(spark):
    knots = calibration.Knots((0.1, 0.3, 0.3, 0.7), (0.0, 0.2, 0.4, 1.0))
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)], "s double")
    got = values(df.select(calibration.isotonic_apply("s", knots).alias("c")), "c")
    assert got == pytest.approx([0.0, 0.0, 0.1, 0.2, 0.7, 1.0, 1.0])
    assert values(df.select(calibration.isotonic_apply("s", calibration.Knots((), ())).alias("c")), "c") == values(df, "s")
    many = calibration.Knots(tuple(np.linspace(0, 1, 101)), tuple(np.linspace(0, 1, 101) ** 2))
    assert values(df.select(calibration.isotonic_apply("s", many).alias("c")), "c") == pytest.approx(np.interp([0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9], many.xs, many.ys))


def test_isotonic_fit_pools(spark):
    m = calibration.isotonic_fit(scores(spark, [(0, 0.1), (1, 0.2), (0, 0.3), (1, 0.3), (1, 0.9)])).table.orderBy("x").collect()
    assert [r.x for r in m] == pytest.approx([0.1, 0.2, 0.3, 0.9]) and [r.y for r in m] == pytest.approx([0.0, 2 / 3, 2 / 3, 1.0])


def test_platt_is_the_balanced_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.random(400)
    y = (rng.random(400) < x * 0.5).astype(int)
    m = calibration.platt_fit(scores(spark, list(zip(y.tolist(), x.tolist()))))
    # The gradient of the penalised, class-weighted loss vanishes at the solution.
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    p = 1 / (1 + np.exp(-(m.coefficient * x + m.intercept)))
    assert abs(m.coefficient + np.sum(w * (p - y) * x)) < 1e-3 and abs(np.sum(w * (p - y))) < 1e-3


def test_ece_edges(spark):
    # 0.3 lies below the inexact edge 0.30000000000000004.
    df = scores(spark, [(1, 0.3), (0, 0.1 + 0.2), (1, 1.0)])
    edges = np.linspace(0, 1, 11)
    p, y = np.array([0.3, 0.1 + 0.2, 1.0]), np.array([1, 0, 1])
    want = 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        mask = (p >= lo) & ((p <= hi) if hi == 1.0 else (p < hi))
        if mask.any():
            want += mask.mean() * abs(y[mask].mean() - p[mask].mean())
    assert calibration.expected_calibration_error(df).first()[0] == pytest.approx(want)


def test_fusion_errors_and_recipes(spark):
    with pytest.raises(ValueError):
        C.weighted_average(["a"], [-1.0])
    with pytest.raises(ValueError):
        C.weighted_average(["a", "b"], [0.0, 0.0])
    with pytest.raises(ValueError):
        calibration.select_calibrators({"x": scores(spark, [(1, 0.5)])}, calibration.CalibrationConfig(metric="f1"))
    df = spark.createDataFrame([(0.0, 0.5)], "a_score double, b_score double")
    got = df.select(fusion.FusionRecipe("geometric_mean_top_k", ("a", "b")).column().alias("x")).first()["x"]
    assert got == pytest.approx(math.sqrt(1e-9 * 0.5))
    assert fusion.branch_names(df) == ["a", "b"]


def test_pool_and_recommendation(spark):
    ap = spark.createDataFrame([("a", 1e-4), ("b", 5e-4)], "branch string, average_precision double")
    assert values(fusion.branch_pool(ap), "branch") == ["b"]
    rows = [("full", 0.5, 0.6, 0.1, True, True, None), ("no_x", 0.5, 0.6, 0.1, True, True, "x"), ("no_fusion", 0.4, 0.9, 0.0, False, True, None)]
    df = spark.createDataFrame(rows, "variant string, valid_f1 double, valid_average_precision double, valid_brier_score double, uses_fusion boolean, uses_calibration boolean, branch_removed string")
    assert ablation.recommend_variant(df).first()["recommended"] == "full"


# --- trees, contract, requests ---------------------------------------------------------------------------------------

def walk(nodes, x):
    at = 0
    while not nodes[at].get("is_leaf"):
        n = nodes[at]
        v = x[n["feature_idx"]]
        left = n["missing_go_to_left"] if math.isnan(v) else v <= n["threshold"]
        at = n["left"] if left else n["right"]
    return nodes[at]["value"]


def test_trees(spark):
    rows = [(50.0, 2.0, 1.0), (50.1, 5.0, 1.1), (math.nan, math.nan, math.nan), (500.0, 9.0, 0.0), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = values(scoring.score_trees(df, TREES, ["a", "b", "c"]), "score")
    want = []
    for r in rows:
        x = [math.nan if v is None else v for v in r]
        want.append(1 / (1 + math.exp(-(TREES.baseline + sum(walk(t, x) for t in TREES.trees)))))
    assert got == pytest.approx(want)
    spec = scoring.ScoringSpec(("a", "b", "c"), TREES)
    only = spark.createDataFrame([({"a": 42.5, "other": 1.0},)], "features map<string,double>")
    want = 1 / (1 + math.exp(-(TREES.baseline + sum(walk(t, [42.5, math.nan, math.nan]) for t in TREES.trees))))
    assert scoring.score_events(only, spec).first()["raw_fused_score"] == pytest.approx(want)


EVENT = "trace struct<request_id:string,source_system:string>, transaction struct<transaction_id:string>, features map<string,double>"


@pytest.mark.parametrize(
    "row,message",
    [
        ((None, None, None), "request is required"), ((None, ("t",), {"a": 1.0}), "trace is required"), ((("", "s"), ("t",), {"a": 1.0}), "trace.request_id is required"),
        ((("r", ""), ("t",), {"a": 1.0}), "trace.source_system is required"), ((("r", "s"), None, {"a": 1.0}), "transaction is required"),
        ((("r", "s"), ("",), {"a": 1.0}), "transaction.transaction_id is required"), ((("r", "s"), ("t",), {}), "features must not be empty"), ((("r", "s"), ("t",), {"a": 1.0}), None),
    ],
)
def test_request_validation(spark, row, message):
    errors = scoring.validate_request(spark.createDataFrame([row], EVENT)).first()["errors"]
    assert errors == [] if message is None else message in errors


def test_contract(spark):
    c = contract.Contract(("f1", "f2"))
    assert contract.check_layout(["transaction_id", "is_fraud", "f1", "f2"], c) == ([], [])
    assert len(contract.check_layout(["transaction_id", "f1", "x"], c)[0]) == 2
    assert contract.check_layout(["transaction_id", "is_fraud", "f2", "f1"], c)[0] == ["column order differs from the contract"]
    good = spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 0, 3.0, 4.0)], "transaction_id string, is_fraud int, f1 double, f2 double")
    assert contract.validate_contract(good, c).first()["valid"]
    aligned = scoring.align_features(good, c)
    assert (aligned.source_stage, aligned.contract_valid) == ("contract_aligned_input", True)
    assert scoring.align_features(good.drop("is_fraud"), c).source_stage == "contract_aligned_input_without_labels"
    assert scoring.align_features(good.withColumn("is_fraud", F.lit(None).cast("int")), c).source_stage == "contract_aligned_input_without_labels"
    with pytest.raises(ValueError):
        scoring.align_features(good.drop("f1"), c)
    with pytest.raises(ValueError):
        contract.build_contract(good, good.select("transaction_id", "is_fraud", "f2", "f1"), good)


def test_blake2_buckets(spark):
    import hashlib

    df = spark.createDataFrame([(" abc ",), ("",), (None,)], "t string")
    want = int.from_bytes(hashlib.blake2b(b"abc", digest_size=8).digest(), "little") % 4096
    assert values(df.select(prep.hash_bucket("t", method="blake2b").alias("h")), "h") == [want, 0, 0]


def test_scaler_and_selector(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 5.0, 1), (5.0, 5.0, 1)], "a double, b double, is_fraud int")
    stats = {r["column"]: (r["mean"], r["std"]) for r in prep.scale_fit(df, ["a", "b"]).collect()}
    assert stats["a"] == pytest.approx((3.0, math.sqrt(8 / 3))) and stats["b"] == pytest.approx((5.0, 1.0))
    assert prep.variance_filter(df, ["a", "b"]) == ["a"]
    with pytest.raises(ValueError):
        prep.anova_select(df, ["a"], top_k=0)
    one_class = prep.anova_select(df.where("is_fraud = 1"), ["a", "b"], top_k=1)
    assert values(one_class, "column", "selected", order="position") == [("a", True), ("b", False)]


def test_join_branches_checks(spark):
    a = scores(spark, [(1, 0.9), (0, 0.2)])
    flipped = a.withColumn("is_fraud", 1 - F.col("is_fraud"))
    with pytest.raises(ValueError):
        joins.join_branches({"a": a, "b": flipped})
    with pytest.raises(ValueError):
        joins.join_branches({"a": a, "b": a.unionByName(a)})
    with pytest.raises(ValueError):
        joins.join_branches({"a": a, "b": a.limit(1)})
    with pytest.raises(KeyError):
        joins.subset_by_ids(a, spark.createDataFrame([("zz", 1)], "transaction_id string, position int"))
    assert joins.join_branches({"a": a, "b": a}).columns == ["transaction_id", "is_fraud", "a_score", "a_predicted_label", "b_score", "b_predicted_label"]


def test_bounded_keeps_null(spark):
    df = spark.createDataFrame([(None,), (50.0,), (-50.0,), (1.5,)], "x double")
    assert values(df.select(C.bounded("x").alias("b")), "b") == [None, 10.0, -10.0, 1.5]
    out = features.base_features(spark.createDataFrame([(1.0, 0.0)], "amount double, oldbalance_org double"))
    assert out.first()["amount_to_oldbalance_ratio"] is None and "balance_delta_org" not in out.columns


def test_first_rows_past_any_packing_bound(spark):
    """Row numbers of any size stay with their source."""
    big = 2**62
    rows = [("a", big, big, "x"), ("a", big + 5, big + 5, "y"), ("b", 3, 3, "x"), ("b", big + 1, big + 1, "z")]
    df = spark.createDataFrame(rows, "source_file string, source_row_number bigint, source_file_row_number bigint, p string")
    got = {r.p: (r.source_file, r.source_row_number) for r in cleaning.dedupe_exact_keep_first(df, sources=["a", "b"]).collect()}
    assert got == {"x": ("a", big), "y": ("a", big + 5), "z": ("b", big + 1)}


def test_sources_are_numbered_by_one_sort(spark):
    """The number of jobs does not grow with the sources."""
    one = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "at int, note string")

    def jobs(n):
        group = f"sources-{n}"
        spark.sparkContext.setJobGroup(group, group)
        rows = cleaning.union_sources({f"s{i:03d}": one for i in range(n)}, ["at"]).orderBy("source_file", "source_row_number").collect()
        spark.sparkContext.setJobGroup("other", "other")
        assert [(r.source_file, r.source_row_number, r.note) for r in rows] == [(f"s{i:03d}", k + 1, c) for i in range(n) for k, c in enumerate("abc")]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(40) <= jobs(2) + 2


@pytest.mark.parametrize("knots", [2, 40])
def test_repeated_knots_and_missing_scores(spark, knots):
    xs = (0.25, 0.25, *[0.5 + 0.01 * i for i in range(knots)])
    ys = (0.1, 0.2, *[0.3 + 0.001 * i for i in range(knots)])
    df = spark.createDataFrame([(0, 0.25), (1, None), (2, float("nan")), (3, 0.1), (4, 5.0), (5, 0.375)], "i int, s double")
    got = [r.y for r in df.select("i", calibration.isotonic_apply("s", calibration.Knots(xs, ys)).alias("y")).orderBy("i").collect()]
    assert got[:5] == [0.1, None, None, 0.1, ys[-1]] and abs(got[5] - 0.25) < 1e-12


def test_as_many_rows_as_classes(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0)], "transaction_id string, is_fraud int, x double")
    assert prep.anova_scores(df, ["x"]).first()["f"] == float("inf")


def test_variance_within_classes_does_not_cancel(spark):
    rows = [(str(i), i % 2, 1e9 + (i % 2) + 0.001 * (i // 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "transaction_id string, is_fraud int, x double")
    x = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    groups = [x[y == k] - 1e9 for k in (0, 1)]
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 38
    between = sum(len(g) * (g.mean() - (x - 1e9).mean()) ** 2 for g in groups)
    assert abs(prep.anova_scores(df, ["x"]).first()["f"] / (between / within) - 1) < 0.01
