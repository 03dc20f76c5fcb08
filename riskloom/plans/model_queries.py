"""Queries over model inputs, contract, fusion, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import ablation, calibration, contract, fusion, history, leakage, metrics, prep, thresholds
from riskloom.operators.ordering import quantile_grid
from riskloom.plans import adapters as A
from riskloom.plans.registry import as_text, query, rounded, with_ctes

NAMES = ("branch_a", "branch_b", "branch_c")
SCORES = [f"{n}_score" for n in NAMES]
HALF = "CAST(0.5 AS DOUBLE)"


# --- model inputs -----------------------------------------------------------------------

_BUCKET = "CASE WHEN coalesce(trim({0}), '') = '' THEN 0 ELSE CAST(CAST(concat('0x', substr(md5(trim({0})), 1, 15)) AS BIGINT) % 4096 AS DOUBLE) END"


@query("h1_string_features", with_ctes(A.TXN) + f"""
SELECT transaction_id, {_BUCKET.format('name_dest')} AS name_dest__hash_bucket, CASE WHEN coalesce(trim(name_dest), '') = '' THEN 1.0::DOUBLE ELSE 0.0 END AS name_dest__missing,
       {_BUCKET.format('type')} AS type__hash_bucket, 0.0::DOUBLE AS type__missing FROM txn""")
def h1(spark, d):
    return A.txn(spark, d).select("transaction_id", *prep.string_features(["name_dest", "type"]))


@query("h2_timestamp_features", with_ctes(A.CLICKS) + """
SELECT transaction_id, coalesce(floor(epoch_us(event_time) / 1000000.0), 0)::DOUBLE AS event_time__unix_seconds, CASE WHEN event_time IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS event_time__missing FROM clicks""")
def h2(spark, d):
    return A.clicks(spark, d).select("transaction_id", *prep.timestamp_features(["event_time"]))


_ENG = f"""engineered AS (SELECT transaction_id, is_fraud, floor(epoch_us(transaction_timestamp) / 1000000.0)::DOUBLE AS transaction_timestamp__unix_seconds, 0.0::DOUBLE AS transaction_timestamp__missing,
  {_BUCKET.format('type')} AS type__hash_bucket, 0.0::DOUBLE AS type__missing, {_BUCKET.format('name_orig')} AS name_orig__hash_bucket, 0.0::DOUBLE AS name_orig__missing,
  {_BUCKET.format('name_dest')} AS name_dest__hash_bucket, CASE WHEN coalesce(trim(name_dest), '') = '' THEN 1.0::DOUBLE ELSE 0.0 END AS name_dest__missing, coalesce(amount, 0) AS amount FROM txn)"""
_ENG_COLS = ("transaction_timestamp__unix_seconds", "transaction_timestamp__missing", "type__hash_bucket", "type__missing", "name_orig__hash_bucket", "name_orig__missing", "name_dest__hash_bucket", "name_dest__missing", "amount")


@query("h3_engineer_features", with_ctes(A.TXN, _ENG) + "SELECT * FROM engineered")
def h3(spark, d):
    return prep.engineer_features(A.txn(spark, d))


def _long(select: str, source: str, cols=_ENG_COLS) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c)} FROM {source}" for c in cols)


@query("h4_scale_fit", with_ctes(A.TXN, _ENG) + _long("round(avg({0}), 4) AS mean, round(CASE WHEN stddev_pop({0}) > 0 THEN stddev_pop({0}) ELSE 1 END, 4) AS std", "engineered"))
def h4(spark, d):
    stats = prep.scale_fit(prep.engineer_features(A.txn(spark, d)), list(_ENG_COLS))
    return rounded(stats.select("column", "mean", "std"), "mean", "std", digits=4)


@query("h4_scale_apply", with_ctes(A.TXN, _ENG) + """, s AS (SELECT avg(amount) AS am, stddev_pop(amount) AS asd, avg(name_dest__hash_bucket) AS bm, stddev_pop(name_dest__hash_bucket) AS bsd FROM engineered)
SELECT transaction_id, round((amount - am) / asd, 6) AS amount, round((name_dest__hash_bucket - bm) / bsd, 6) AS name_dest__hash_bucket, 0.0::DOUBLE AS type__missing FROM engineered CROSS JOIN s""")
def h4_apply(spark, d):
    df = prep.engineer_features(A.txn(spark, d)).select("transaction_id", "amount", "name_dest__hash_bucket", "type__missing")
    cols = ["amount", "name_dest__hash_bucket", "type__missing"]
    return rounded(prep.scale_apply(df, prep.scale_fit(df, cols)), *cols)


@query("h5_variance_filter", with_ctes(A.TXN, _ENG) + 'SELECT "column" FROM (' + _long("min({0}) < max({0}) AS varies", "engineered") + ") WHERE varies")
def h5(spark, d):
    names = prep.variance_filter(prep.engineer_features(A.txn(spark, d)), list(_ENG_COLS))
    return spark.createDataFrame([(n,) for n in names], "`column` string")


_ANOVA_COLS = ("amount", "type__hash_bucket", "name_orig__hash_bucket", "name_dest__hash_bucket", "type__missing")


def _anova_sql() -> str:
    parts = []
    for i, c in enumerate(_ANOVA_COLS):
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, min({c}) < max({c}) AS varies,
  (sum(CASE WHEN is_fraud = 1 THEN {c} END) ^ 2 / count(*) FILTER (WHERE is_fraud = 1) + sum(CASE WHEN is_fraud = 0 THEN {c} END) ^ 2 / count(*) FILTER (WHERE is_fraud = 0) - sum({c}) ^ 2 / count(*)) AS ssb,
  sum({c} * {c}) - (sum(CASE WHEN is_fraud = 1 THEN {c} END) ^ 2 / count(*) FILTER (WHERE is_fraud = 1) + sum(CASE WHEN is_fraud = 0 THEN {c} END) ^ 2 / count(*) FILTER (WHERE is_fraud = 0)) AS ssw,
  count(*) AS n FROM engineered""")
    return "anova AS (SELECT \"column\", position, varies, CASE WHEN varies THEN ssb / (ssw / (n - 2)) END AS f FROM (" + " UNION ALL ".join(parts) + "))"


@query("h6_anova_select", with_ctes(A.TXN, _ENG, _anova_sql()) + """
SELECT "column", round(f, 4) AS f, varies AND row_number() OVER (ORDER BY varies DESC, f DESC NULLS LAST, position DESC) <= 2 AS selected FROM anova""")
def h6(spark, d):
    df = prep.engineer_features(A.txn(spark, d))
    return rounded(prep.anova_select(df, list(_ANOVA_COLS), top_k=2).select("column", "f", "selected"), "f", digits=4)


def _tabular(spark, d, top_k=12):
    t = A.txn(spark, d)
    from riskloom.plans.data_queries import _split_txn

    ids = _split_txn(spark, d).select("transaction_id", "split")
    return prep.prepare_tabular(history.behavioral_features(t), ids, ratio=2.0, top_k=top_k)


@query("h7_prepare_tabular")
def h7(spark, d):
    """Every row of the three tables with its scaled values, in the order of the selected features."""
    t = _tabular(spark, d)
    parts = [df.select(F.lit(k).alias("split"), "transaction_id", "is_fraud", F.array(*[F.round(F.col(f).cast("double"), 6) for f in t.features]).alias("scaled")) for k, df in (("train", t.train), ("valid", t.valid), ("test", t.test))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("h7_tabular_report")
def h7_report(spark, d):
    return _tabular(spark, d).report


@query("h8_model_matrix", with_ctes(A.TXN) + "SELECT transaction_id, is_fraud, round(CAST(CAST(coalesce(amount, 0) AS FLOAT) AS DOUBLE), 2) AS amount FROM txn")
def h8(spark, d):
    out = prep.model_matrix(A.txn(spark, d), ["amount"])
    return out.withColumn("amount", F.round(F.col("amount").cast("double"), 2))


@query("i1_build_contract")
def i1(spark, d):
    t = _tabular(spark, d)
    return contract.build_contract(t.train, t.valid, t.test)


_BAD = """bad AS (SELECT CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS transaction_id,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'click' THEN 2 ELSE 1 END AS is_fraud, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS f1,
  CASE WHEN event_id % 19 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS f2, value AS f3 FROM events)"""


def _bad(spark, d):
    e = A.table(spark, d, "events")
    return e.select(
        F.when((F.col("event_type") == "view") & A.every(3), F.lit(None)).when(A.every(5), "").otherwise(F.col("user_id").cast("string")).alias("transaction_id"),
        F.when(A.every(7), F.lit(None)).when(F.col("event_type") == "click", 2).otherwise(1).alias("is_fraud"),
        F.when(~A.every(17), F.col("value")).alias("f1"), F.when(A.every(19), float("inf")).otherwise(F.col("value")).alias("f2"), F.col("value").alias("f3"),
    )


_ID_ERRORS = """SELECT 'transaction_id contains null values' AS error FROM bad WHERE transaction_id IS NULL GROUP BY 1 UNION ALL
SELECT 'transaction_id contains empty string values' FROM bad WHERE transaction_id = '' GROUP BY 1 UNION ALL
SELECT 'transaction_id contains duplicate values' FROM (SELECT transaction_id FROM bad GROUP BY 1 HAVING count(*) > 1) GROUP BY 1"""
_LABEL_ERRORS = """SELECT 'is_fraud contains null values' AS error FROM bad WHERE is_fraud IS NULL GROUP BY 1 UNION ALL
SELECT 'is_fraud is not boolean or 0/1 integer-like' FROM bad WHERE is_fraud IS NULL OR is_fraud NOT IN (0, 1) GROUP BY 1"""
_FEATURE_ERRORS = """SELECT 'f1 contains null or non-numeric values' AS error FROM bad WHERE f1 IS NULL GROUP BY 1 UNION ALL
SELECT 'f2 contains non-finite values' FROM bad WHERE isinf(f2) GROUP BY 1"""


@query("i3_check_ids", with_ctes(_BAD) + _ID_ERRORS)
def i3(spark, d):
    return contract.check_ids(_bad(spark, d))


@query("i4_check_labels", with_ctes(_BAD) + _LABEL_ERRORS)
def i4(spark, d):
    return contract.check_labels(_bad(spark, d))


@query("i5_check_features", with_ctes(_BAD) + _FEATURE_ERRORS)
def i5(spark, d):
    return contract.check_features(_bad(spark, d), ["f1", "f2", "f3"])


@query("i6_validate_contract", with_ctes(_BAD) + f"""
SELECT false AS valid, (SELECT count(*) FROM bad) AS checked_rows, 5 AS checked_columns, (SELECT string_agg(error, ',' ORDER BY error) FROM ({_ID_ERRORS} UNION ALL {_LABEL_ERRORS} UNION ALL {_FEATURE_ERRORS})) AS errors, '' AS warnings""")
def i6(spark, d):
    return as_text(contract.validate_contract(_bad(spark, d), contract.Contract(("f1", "f2", "f3"))), "errors", "warnings")


_RECORDS = """records AS (SELECT user_id AS request_id, CASE WHEN event_id % 50 = 0 THEN ['amount'] WHEN event_id % 70 = 0 THEN ['step'] ELSE ['amount', 'step', 'extra'] END AS keys FROM events)"""


@query("i7_contract_check_batch", with_ctes(_RECORDS) + """
, gone AS (SELECT DISTINCT request_id, name FROM (SELECT request_id, keys, unnest(['amount', 'step']) AS name FROM records) WHERE NOT list_contains(keys, name))
SELECT r.request_id, count(name) = 0 AS valid, coalesce(string_agg('missing required feature: ' || name, ',' ORDER BY name), '') AS errors
FROM (SELECT DISTINCT request_id FROM records) r LEFT JOIN gone g ON r.request_id = g.request_id GROUP BY r.request_id""")
def i7(spark, d):
    e = A.table(spark, d, "events")
    v = F.col("value")
    a, s, x = (F.lit(k) for k in ("amount", "step", "extra"))
    bag = F.when(A.every(50), F.create_map(a, v)).when(A.every(70), F.create_map(s, v)).otherwise(F.create_map(a, v, s, v, x, v))
    records = e.select(F.col("user_id").alias("request_id"), bag.alias("features"))
    return as_text(contract.contract_check_batch(records, ["amount", "step"]), "errors")


# --- score curve in SQL ------------------------------------------------------------------

def curve_cte(source: str, by: str = "", name: str = "curve") -> str:
    """Distinct scores with running totals; ``source`` has score, is_fraud and the grouping columns."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name} AS (SELECT {keys}score, n, pos, sum(n) OVER ({part}ORDER BY score DESC) AS cum_n, sum(pos) OVER ({part}ORDER BY score DESC) AS cum_pos,
  sum(n) OVER ({part.strip()}) AS total_n, sum(pos) OVER ({part.strip()}) AS total_pos
  FROM (SELECT {keys}score, count(*) AS n, sum(is_fraud) AS pos FROM {source} GROUP BY {keys}score))"""


AP = "coalesce(sum(pos * (cum_pos / cum_n::DOUBLE)) / nullif(max(total_pos), 0), 0)"
AUC = "sum((n - pos) * (cum_pos - pos / 2.0::DOUBLE)) / (max(total_pos)::DOUBLE * max(total_n - total_pos))"
POINTS = """points AS (SELECT *, cum_pos / cum_n::DOUBLE AS p, cum_pos / total_pos::DOUBLE AS r, CASE WHEN cum_pos > 0 THEN 2 * (cum_pos / cum_n::DOUBLE) * (cum_pos / total_pos::DOUBLE) / (cum_pos / cum_n::DOUBLE + cum_pos / total_pos::DOUBLE) ELSE 0 END AS f1 FROM curve)"""
LONG = """long AS (SELECT transaction_id, is_fraud, split, 'branch_a' AS branch, branch_a_score AS score FROM branches UNION ALL SELECT transaction_id, is_fraud, split, 'branch_b', branch_b_score FROM branches
  UNION ALL SELECT transaction_id, is_fraud, split, 'branch_c', branch_c_score FROM branches)"""
VALID_LONG = "vlong AS (SELECT * FROM long WHERE split = 'valid')"
AP_CTE = f"ap AS (SELECT branch, {AP} AS ap FROM curve GROUP BY branch)"
_BR_AP = with_ctes(A.BRANCHES, LONG, VALID_LONG, curve_cte("vlong", "branch"), AP_CTE)


def _valid(spark, d):
    return A.branches(spark, d).where(F.col("split") == "valid")


def _test(spark, d):
    return A.branches(spark, d).where(F.col("split") == "test")


# --- fusion ---------------------------------------------------------------------------------

@query("j1_branch_ap", _BR_AP + "SELECT branch, round(ap, 6) AS average_precision FROM ap")
def j1(spark, d):
    return rounded(fusion.branch_ap(_valid(spark, d), NAMES), "average_precision")


@query("j2_rank_branches", _BR_AP + "SELECT branch, round(ap, 6) AS average_precision, row_number() OVER (ORDER BY ap DESC, branch DESC) AS rank FROM ap")
def j2(spark, d):
    return rounded(fusion.rank_branches(fusion.branch_ap(_valid(spark, d), NAMES)), "average_precision")


@query("j3_branch_pool", _BR_AP + "SELECT branch, round(ap, 6) AS average_precision, rank FROM (SELECT branch, ap, row_number() OVER (ORDER BY ap DESC, branch DESC) AS rank FROM ap) WHERE rank <= 2")
def j3(spark, d):
    return rounded(fusion.branch_pool(fusion.branch_ap(_valid(spark, d), NAMES), max_branches=2), "average_precision")


_CLIP = "greatest(1e-9::DOUBLE, least(1::DOUBLE, {0}))"
_GEO = f"exp((ln({_CLIP.format('branch_a_score')}) + ln({_CLIP.format('branch_b_score')}) + ln({_CLIP.format('branch_c_score')})) / 3)"
_MEAN = "(branch_a_score + branch_b_score + branch_c_score) / 3"


@query("j4_weighted_average", with_ctes(A.BRANCHES) + f"SELECT transaction_id, round((2 * branch_a_score + branch_b_score) / 3, 6) AS weighted, round({_MEAN}, 6) AS equal FROM branches")
def j4(spark, d):
    df = A.branches(spark, d).select("transaction_id", C.weighted_average(SCORES, [2, 1, 0]).alias("weighted"), C.weighted_average(SCORES).alias("equal"))
    return rounded(df, "weighted", "equal")


@query("j5_mean_top_k", with_ctes(A.BRANCHES) + f"SELECT transaction_id, round({_MEAN}, 6) AS fused FROM branches")
def j5(spark, d):
    return rounded(A.branches(spark, d).select("transaction_id", C.mean_top_k(SCORES).alias("fused")), "fused")


@query("j6_geometric_mean", with_ctes(A.BRANCHES) + f"SELECT transaction_id, round({_GEO}, 6) AS fused FROM branches")
def j6(spark, d):
    return rounded(A.branches(spark, d).select("transaction_id", C.geometric_mean(SCORES).alias("fused")), "fused")


@query("j7_logistic_meta")
def j7(spark, d):
    recipe = fusion.logistic_meta(_valid(spark, d), NAMES)
    rows = [*zip(NAMES, recipe.weights), ("intercept", recipe.intercept)]
    return spark.createDataFrame(rows, "term string, value double")


def _p(c: str) -> str:
    return f"greatest(1e-9::DOUBLE, least(1 - 1e-9::DOUBLE, {c}))"


def _h(c: str) -> str:
    return f"(-({_p(c)} * ln({_p(c)}) + (1 - {_p(c)}) * ln(1 - {_p(c)})))"


@query("j8_binary_entropy", with_ctes(A.BRANCHES) + f"SELECT transaction_id, round({_h('branch_b_score')}, 6) AS entropy FROM branches")
def j8(spark, d):
    return rounded(A.branches(spark, d).select("transaction_id", C.binary_entropy("branch_b_score").alias("entropy")), "entropy")


_REL = f"""rel AS (SELECT branch, 1.0::DOUBLE + sum(hit) AS alpha, 1.0::DOUBLE + count(*) - sum(hit) AS beta, avg(h) AS average_entropy
  FROM (SELECT branch, CASE WHEN (CASE WHEN {_p('score')} >= {HALF} THEN 1 ELSE 0 END) = is_fraud THEN 1 ELSE 0 END AS hit, {_h('score')} AS h FROM vlong) GROUP BY branch)"""
_REL_ALL = with_ctes(A.BRANCHES, LONG, VALID_LONG, _REL)


@query("j9_branch_reliability", _REL_ALL + """SELECT branch, alpha, beta, round(alpha / (alpha + beta), 6) AS posterior_mean, round(average_entropy, 6) AS average_entropy,
       round(alpha / (alpha + beta) / average_entropy, 6) AS reliability_weight FROM rel""")
def j9(spark, d):
    return rounded(fusion.branch_reliability(_valid(spark, d), NAMES), "posterior_mean", "average_entropy", "reliability_weight")


_W = {n: f"(SELECT alpha / (alpha + beta) / average_entropy FROM rel WHERE branch = '{n}')" for n in NAMES}
_TOP = " + ".join(f"{_W[n]} / {_h(n + '_score')} * {_p(n + '_score')}" for n in NAMES)
_BOT = " + ".join(f"{_W[n]} / {_h(n + '_score')}" for n in NAMES)


@query("j10_reliability_weighted", _REL_ALL + f"SELECT transaction_id, round(({_TOP}) / ({_BOT}), 6) AS fused FROM branches")
def j10(spark, d):
    recipe = fusion.reliability_recipe(_valid(spark, d), NAMES, fusion.FusionConfig())
    return rounded(fusion.apply_fusion(A.branches(spark, d), recipe, "fused").select("transaction_id", "fused"), "fused")


_CAND = f"""cands AS (SELECT 'best_branch' AS candidate, 1 AS k, is_fraud, branch_a_score AS score FROM branches WHERE split = 'valid'
  UNION ALL SELECT 'mean_top_k', 3, is_fraud, (branch_a_score * 1 + branch_b_score + branch_c_score) / 3 FROM branches WHERE split = 'valid'
  UNION ALL SELECT 'geometric_mean_top_k', 3, is_fraud, {_GEO} FROM branches WHERE split = 'valid'
  UNION ALL SELECT 'ap_weighted_average', 3, is_fraud, branch_a_score * (wa / (wa + wb + wc)) + branch_b_score * (wb / (wa + wb + wc)) + branch_c_score * (wc / (wa + wb + wc)) FROM branches
     CROSS JOIN (SELECT max(ap) FILTER (branch = 'branch_a') AS wa, max(ap) FILTER (branch = 'branch_b') AS wb, max(ap) FILTER (branch = 'branch_c') AS wc FROM ap) WHERE split = 'valid'
  UNION ALL SELECT 'bayesian_reliability', 3, is_fraud, ({_TOP}) / ({_BOT}) FROM branches WHERE split = 'valid')"""


@query("j11_auto_select", with_ctes(A.BRANCHES, LONG, VALID_LONG, curve_cte("vlong", "branch"), AP_CTE, _REL, _CAND, curve_cte("cands", "candidate, k", "ccurve")) + f"""
SELECT candidate, k AS branch_count, round({AP}, 4) AS validation_metric, round({AP} - 0.00025 * (k - 1), 4) AS selection_score FROM ccurve GROUP BY candidate, k""")
def j11(spark, d):
    cfg = fusion.FusionConfig(candidates=tuple(c for c in fusion.CANDIDATES if c != "logistic_meta"))
    board = fusion.auto_select(_valid(spark, d), _test(spark, d), cfg)[1]
    # Equal scores of one candidate may differ in the last bit between engines and so tie or not: four digits.
    return rounded(board.select("candidate", "branch_count", "validation_metric", "selection_score"), "validation_metric", "selection_score", digits=4)


@query("j11_auto_select_all")
def j11_all(spark, d):
    """All six candidates, the trained one too, with the fused score of each test row under the winner."""
    fused, board, recipe = fusion.auto_select(_valid(spark, d), _test(spark, d))
    rows = fused.select(F.lit("row").alias("kind"), F.col("transaction_id").alias("name"), F.lit(recipe.candidate).alias("candidate"), F.round("raw_fused_score", 6).alias("value"))
    ranked = board.select(F.lit("candidate").alias("kind"), F.col("branches").alias("name"), "candidate", F.round("selection_score", 4).alias("value"))
    return ranked.unionByName(rows)


@query("j12_fuse")
def j12(spark, d):
    """The fused score of each row, fitted on validation."""
    out, recipe = fusion.fuse(_valid(spark, d), _test(spark, d))
    return rounded(out.select("transaction_id", F.lit(recipe.candidate).alias("candidate"), "raw_fused_score"), "raw_fused_score")


@query("j12_fuse_reliability", with_ctes(A.BRANCHES, LONG, VALID_LONG, _REL) + f"""
SELECT transaction_id, 'bayesian_reliability' AS candidate, round(({_TOP}) / ({_BOT}), 6) AS raw_fused_score FROM branches WHERE split = 'test'""")
def j12_reliability(spark, d):
    out, recipe = fusion.fuse(_valid(spark, d), _test(spark, d), fusion.FusionConfig(mode="bayesian_reliability"))
    return rounded(out.select("transaction_id", F.lit(recipe.candidate).alias("candidate"), "raw_fused_score"), "raw_fused_score")


@query("j12_fuse_weighted", with_ctes(A.BRANCHES) + """
SELECT transaction_id, 'weighted_average' AS candidate, round(0.75 * branch_a_score + 0.25 * branch_c_score, 6) AS raw_fused_score FROM branches WHERE split = 'test'""")
def j12_weighted(spark, d):
    cfg = fusion.FusionConfig(mode="weighted_average", weights={"branch_a": 3.0, "branch_c": 1.0})
    out, recipe = fusion.fuse(_valid(spark, d), _test(spark, d), cfg)
    return rounded(out.select("transaction_id", F.lit(recipe.candidate).alias("candidate"), "raw_fused_score"), "raw_fused_score")


@query("j13_apply_fusion", with_ctes(A.BRANCHES) + f"""
SELECT transaction_id, round({_GEO}, 6) AS geometric, round(1 / (1 + exp(-(2 * branch_a_score - 1.5 * branch_b_score + 0.25))), 6) AS logistic, round((0.75 * branch_a_score + 0.25 * branch_c_score), 6) AS averaged FROM branches""")
def j13(spark, d):
    df = A.branches(spark, d)
    recipes = {
        "geometric": fusion.FusionRecipe("geometric_mean_top_k", NAMES),
        "logistic": fusion.FusionRecipe("logistic_meta", NAMES[:2], (2.0, -1.5), 0.25),
        "averaged": fusion.FusionRecipe("ap_weighted_average", ("branch_a", "branch_c"), (3.0, 1.0)),
    }
    for name, recipe in recipes.items():
        df = fusion.apply_fusion(df, recipe, name)
    return rounded(df.select("transaction_id", *recipes), *recipes)


@query("j14_predictions", with_ctes(A.BRANCHES) + "SELECT transaction_id, is_fraud, round(least(1, greatest(0, branch_a_score * 1.2 - 0.1)), 6) AS score, CASE WHEN least(1, greatest(0, branch_a_score * 1.2 - 0.1)) >= 0.4 THEN 1 ELSE 0 END AS predicted_label FROM (SELECT transaction_id, is_fraud, branch_a_score FROM branches)")
def j14(spark, d):
    df = A.branches(spark, d).withColumn("s", F.col("branch_a_score") * 1.2 - 0.1)
    return rounded(fusion.predictions(df, "s", 0.4, clip=True), "score")


# --- calibration ------------------------------------------------------------------------------

def _pred(spark, d, split=None):
    df = A.scored(spark, d)
    return df if split is None else df.where(F.col("split") == split)


@query("k1_platt_fit")
def k1(spark, d):
    m = calibration.platt_fit(_pred(spark, d, "valid"))
    return spark.createDataFrame([(m.coefficient, m.intercept)], "coefficient double, intercept double")


# The max-min formula: at each score the largest over all starts before it of the least mean of a run that goes on past it.
_MAXMIN = """pts AS (SELECT score AS x, sum(is_fraud)::DOUBLE AS s, count(*)::DOUBLE AS w FROM scored WHERE split = 'valid' GROUP BY 1),
cum AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM pts),
runs AS (SELECT a.i AS a, b.i AS b, (b.cs - coalesce(p.cs, 0)) / (b.cw - coalesce(p.cw, 0)) AS m FROM cum a JOIN cum b ON b.i >= a.i LEFT JOIN cum p ON p.i = a.i - 1),
least AS (SELECT b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM runs),
fit AS (SELECT i, max(m) AS y FROM least GROUP BY i),
knots AS (SELECT unnest(list_distinct([min(x), max(x)])) AS x, y FROM fit JOIN cum USING (i) GROUP BY y)"""


@query("k2_isotonic_fit", with_ctes(A.SCORED, _MAXMIN) + "SELECT x, round(y, 9) AS y FROM knots")
def k2(spark, d):
    return rounded(calibration.isotonic_fit(_pred(spark, d, "valid")).table.select("x", "y"), "y", digits=9)


@query("k2_isotonic_fit_and_apply", with_ctes(A.SCORED, _MAXMIN) + """
SELECT transaction_id, round(greatest(0, least(1, CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR lo.x = hi.x THEN lo.y ELSE lo.y + (score - lo.x) / (hi.x - lo.x) * (hi.y - lo.y) END)), 6) AS calibrated
FROM (SELECT s.*, (SELECT max(x) FROM knots WHERE x <= score) AS below, (SELECT min(x) FROM knots WHERE x >= score) AS above FROM scored s) q
LEFT JOIN knots lo ON lo.x = q.below LEFT JOIN knots hi ON hi.x = q.above""")
def k2_apply(spark, d):
    """Fitted on validation, merged with the scores of all rows."""
    knots = calibration.isotonic_fit(_pred(spark, d, "valid"))
    return rounded(calibration.apply_calibrator(_pred(spark, d), knots, out="calibrated").select("transaction_id", "calibrated"), "calibrated")


_KNOTS = calibration.Knots((0.1, 0.25, 0.25, 0.6, 0.9), (0.02, 0.1, 0.2, 0.5, 0.95))


@query("k3_isotonic_apply", with_ctes(A.SCORED) + """
SELECT transaction_id, round(CASE WHEN score <= 0.1::DOUBLE THEN 0.02::DOUBLE WHEN score >= 0.9::DOUBLE THEN 0.95::DOUBLE WHEN score <= 0.25::DOUBLE THEN 0.02 + (score - 0.1) / 0.15 * 0.08
  WHEN score <= 0.6::DOUBLE THEN 0.2 + (score - 0.25) / 0.35 * 0.3 ELSE 0.5 + (score - 0.6) / 0.3 * 0.45 END, 6) AS calibrated FROM scored""")
def k3(spark, d):
    return rounded(_pred(spark, d).select("transaction_id", calibration.isotonic_apply("score", _KNOTS).alias("calibrated")), "calibrated")


# 65 knots and one repeated: the first of them decides on the knot, the second above it.
_LONG_KNOTS = calibration.Knots(
    (*[i / 64 for i in range(17)], 0.25, *[i / 64 for i in range(17, 65)]), (*[i / 64 for i in range(17)], 0.3, *[0.05 + 0.95 * i / 64 for i in range(17, 65)])
)


@query("k3_isotonic_apply_long", with_ctes(A.SCORED) + """
SELECT transaction_id, round(CASE WHEN s <= 0.25::DOUBLE THEN greatest(s, 0) WHEN s >= 1 THEN 1 WHEN s <= 0.265625::DOUBLE THEN 0.3 + (s - 0.25) * 64 * 0.00234375 ELSE 0.05 + 0.95 * s END, 6) AS calibrated
FROM (SELECT transaction_id, CASE WHEN score >= 0.5::DOUBLE AND score < 0.51::DOUBLE THEN 0.25::DOUBLE ELSE score END AS s FROM scored)""")
def k3_long(spark, d):
    """Some scores are put on the repeated knot."""
    score = F.when((F.col("score") >= 0.5) & (F.col("score") < 0.51), 0.25).otherwise(F.col("score"))
    return rounded(_pred(spark, d).select("transaction_id", calibration.isotonic_apply(score, _LONG_KNOTS).alias("calibrated")), "calibrated")


_ECE_BIN = " + ".join(f"CASE WHEN p >= {i / 10 if i != 3 and i != 6 and i != 7 else repr(i * 0.1)}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))


def ece_sql(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}sum(n * abs(o - q)) / sum(n) AS ece FROM (SELECT {keys}bin, count(*) AS n, avg(p) AS q, avg(is_fraud::DOUBLE) AS o
  FROM (SELECT *, {_ECE_BIN} AS bin FROM (SELECT *, greatest(0, least(1, score)) AS p FROM {source})) GROUP BY {keys}bin){group}"""


@query("k4_expected_calibration_error", with_ctes(A.SCORED) + "SELECT split, round(ece, 6) AS expected_calibration_error FROM (" + ece_sql("scored", "split") + ")")
def k4(spark, d):
    return rounded(calibration.expected_calibration_error(_pred(spark, d), by=["split"]), "expected_calibration_error")


FLAT = """count(*) AS n, count(*) FILTER (WHERE is_fraud = 0 AND predicted_label = 0) AS tn, count(*) FILTER (WHERE is_fraud = 0 AND predicted_label = 1) AS fp,
  count(*) FILTER (WHERE is_fraud = 1 AND predicted_label = 0) AS fn, count(*) FILTER (WHERE is_fraud = 1 AND predicted_label = 1) AS tp, avg(is_fraud::DOUBLE) AS positive_rate,
  avg(CASE WHEN (score >= 0.5::DOUBLE) = (is_fraud = 1) THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy,
  avg(-CASE WHEN is_fraud = 1 THEN ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score))) ELSE ln(1 - greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score))) END) AS log_loss,
  avg((score - is_fraud) * (score - is_fraud)) AS brier_score"""
PRF = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1"
METRICS = ("positive_rate", "accuracy", "log_loss", "brier_score", "precision", "recall", "f1", "average_precision", "roc_auc")


def evaluate_sql(source: str, by: str) -> str:
    """CTEs ``flat``, ``curve``, ``ranks``, ``evaluated`` for a scored source grouped by ``by``."""
    return f"""flat AS (SELECT *, {PRF} FROM (SELECT {by}, {FLAT} FROM {source} GROUP BY {by})), {curve_cte(source, by)},
ranks AS (SELECT {by}, {AP} AS average_precision, {AUC} AS roc_auc FROM curve GROUP BY {by}),
evaluated AS (SELECT * FROM flat JOIN ranks USING ({by}))"""


_ROUND_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
_CAL = "clipped AS (SELECT transaction_id, is_fraud, split, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score)) AS score, predicted_label FROM scored)"


@query("k5_calibration_metrics", with_ctes(A.SCORED, _CAL, evaluate_sql("clipped", "split")) + f"""
SELECT split, n, tn, fp, fn, tp, {_ROUND_METRICS}, round(ece, 6) AS expected_calibration_error FROM evaluated JOIN ({ece_sql('clipped', 'split')}) USING (split)""")
def k5(spark, d):
    return rounded(calibration.calibration_metrics(_pred(spark, d), ["split"]), *METRICS, "expected_calibration_error")


@query("k6_select_calibrator")
def k6(spark, d):
    return calibration.select_calibrator(_pred(spark, d, "valid"))[2]


@query("k7_calibrate")
def k7(spark, d):
    out = calibration.calibrate(_pred(spark, d, "valid"), _pred(spark, d, "test"))
    return out.metrics.withColumns({"method": F.lit(out.method), "threshold": F.lit(out.threshold)})


@query("k8_train_fusion")
def k8(spark, d):
    out = fusion.train_fusion(_valid(spark, d), _test(spark, d))
    return out.metrics.withColumns({"candidate": F.lit(out.recipe.candidate), "threshold": F.lit(out.threshold)})


# --- evaluation -----------------------------------------------------------------------------------

@query("l1_confusion", with_ctes(A.SCORED) + f"""
SELECT split, tn, fp, fn, tp, round(positive_rate, 6) AS positive_rate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM (SELECT *, {PRF} FROM (SELECT split, {FLAT} FROM scored GROUP BY split))""")
def l1(spark, d):
    return rounded(metrics.confusion(_pred(spark, d), ["split"]), "positive_rate", "precision", "recall", "f1")


@query("l2_accuracy_log_loss", with_ctes(A.SCORED) + f"SELECT split, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss FROM (SELECT split, {FLAT} FROM scored GROUP BY split)")
def l2(spark, d):
    return rounded(metrics.accuracy_log_loss(_pred(spark, d), ["split"]), "accuracy", "log_loss")


@query("l3_average_precision", with_ctes(A.SCORED, curve_cte("scored", "split")) + f"SELECT split, round({AP}, 6) AS average_precision FROM curve GROUP BY split")
def l3(spark, d):
    return rounded(metrics.average_precision(_pred(spark, d), ["split"]), "average_precision")


@query("l4_roc_auc", with_ctes(A.BRANCHES, LONG, curve_cte("long", "branch")) + f"SELECT branch, round({AUC}, 6) AS roc_auc FROM curve GROUP BY branch")
def l4(spark, d):
    return rounded(metrics.roc_auc(metrics.stack_scores(A.branches(spark, d), NAMES), ["branch"]), "roc_auc")


@query("l5_brier", with_ctes(A.SCORED) + "SELECT split, round(avg((score - is_fraud) * (score - is_fraud)), 6) AS brier_score FROM scored GROUP BY split")
def l5(spark, d):
    return rounded(metrics.brier(_pred(spark, d), ["split"]), "brier_score")


_INNER = ", ".join(f"{p!r}::DOUBLE" for p in quantile_grid(10)[1:-1])
_EDGES = f"edges AS (SELECT quantile_cont(score, [{_INNER}]) AS e FROM scored)"


@query("l6_quantile_calibration_bins", with_ctes(A.SCORED, _EDGES) + """
SELECT bin, round(avg(score), 6) AS mean_predicted_probability, round(avg(is_fraud::DOUBLE), 6) AS observed_positive_rate, count(*) AS n
FROM (SELECT score, is_fraud, len(list_filter(e, lambda x: x < score)) AS bin FROM scored CROSS JOIN edges) GROUP BY bin""")
def l6(spark, d):
    return rounded(metrics.quantile_calibration_bins(_pred(spark, d)), "mean_predicted_probability", "observed_positive_rate")


_BEST = "SELECT {keys}round(score, 6) AS threshold, round(f1, 6) AS f1, round(p, 6) AS precision, round(r, 6) AS recall FROM (SELECT *, row_number() OVER ({part}ORDER BY p DESC, score DESC) AS rn FROM (SELECT *, max(f1) OVER ({part}) AS best FROM points) WHERE f1 >= best - 1e-12) WHERE rn = 1"


@query("l7_best_f1_threshold", with_ctes(A.BRANCHES, LONG, curve_cte("long", "branch"), POINTS) + _BEST.format(keys="branch, ", part="PARTITION BY branch "))
def l7(spark, d):
    out = metrics.best_f1_threshold(metrics.stack_scores(A.branches(spark, d), NAMES), ["branch"])
    return rounded(out, "threshold", "f1", "precision", "recall")


@query("l8_resolve_threshold", with_ctes(A.SCORED, "v AS (SELECT * FROM scored WHERE split = 'valid')", curve_cte("v"), POINTS) + "SELECT 'validation_f1' AS strategy, threshold, f1, precision, recall FROM (" + _BEST.format(keys="", part="") + ")")
def l8(spark, d):
    return rounded(metrics.resolve_threshold(_pred(spark, d, "valid")), "threshold", "f1", "precision", "recall")


_BUDGETS = (1.0, 2.0, 5.0, 10.0, 20.0)
_TARGETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.999)


def _budget_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {b}::DOUBLE AS target, score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM {source}) WHERE rn = greatest(1, least(n, CAST(ceil({b / 1000}::DOUBLE * n) AS BIGINT)))"
        for b in _BUDGETS
    )


@query("l9_alert_budget_threshold", with_ctes(A.SCORED) + f"SELECT target, round(threshold, 6) AS threshold FROM ({_budget_sql('scored')})")
def l9(spark, d):
    return rounded(thresholds.alert_budget_threshold(_pred(spark, d), _BUDGETS), "threshold")


_LIMITS = (0.05, 0.25, 0.5, 0.75, 0.95)
_OP = """count(*) AS rows, sum(is_fraud)::BIGINT AS positives, count(*) FILTER (WHERE score >= {t}) AS alerts, count(*) FILTER (WHERE score >= {t} AND is_fraud = 1) AS tp"""
_OPM = "rows, positives, alerts, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(alerts_per_1k, 6) AS alerts_per_1k, round(alert_rate, 6) AS alert_rate"
_OPX = f"SELECT *, {PRF}, 1000 * alerts / rows::DOUBLE AS alerts_per_1k, alerts / rows::DOUBLE AS alert_rate FROM (SELECT *, alerts - tp AS fp, positives - tp AS fn FROM ({{src}}))"


@query("l10_metrics_at_thresholds", with_ctes(A.SCORED) + f"SELECT split, threshold, {_OPM} FROM (" + _OPX.format(src=" UNION ALL ".join(f"SELECT split, {t}::DOUBLE AS threshold, {_OP.format(t=f'{t}::DOUBLE')} FROM scored GROUP BY split" for t in _LIMITS)) + ")")
def l10(spark, d):
    return rounded(thresholds.metrics_at_thresholds(_pred(spark, d), _LIMITS, ["split"]), "precision", "recall", "f1", "alerts_per_1k", "alert_rate")


def _target_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS target, count(*) > 0 AS feasible, arg_max(score, struct_pack(r := r, s := score)) AS threshold FROM points WHERE p + 1e-12 >= {t}::DOUBLE" for t in _TARGETS
    )


@query("l11_precision_target_threshold", with_ctes(A.BRANCHES, "b AS (SELECT is_fraud, branch_b_score AS score FROM branches)", curve_cte("b"), POINTS) + f"SELECT target, feasible, round(threshold, 6) AS threshold FROM ({_target_sql()})")
def l11(spark, d):
    df = A.branches(spark, d).select("is_fraud", F.col("branch_b_score").alias("score"))
    return rounded(thresholds.precision_target_threshold(df, _TARGETS), "threshold")


_T5 = (0.1, 0.2, 0.3, 0.4, 0.5)
_OPS_CTES = with_ctes(
    A.SCORED, "v AS (SELECT * FROM scored WHERE split = 'valid')", "t AS (SELECT * FROM scored WHERE split = 'test')", curve_cte("v"), POINTS,
    f"picks AS (SELECT 'alert_budget' AS selection_type, target AS selection_value, true AS feasible, threshold FROM ({_budget_sql('v')}) UNION ALL SELECT 'precision_target', target, feasible, threshold FROM ("
    + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS target, count(*) > 0 AS feasible, arg_max(score, struct_pack(r := r, s := score)) AS threshold FROM points WHERE p + 1e-12 >= {t}::DOUBLE" for t in _T5) + "))",
    *[
        f"m{s} AS (" + _OPX.format(src=f"SELECT threshold, count(*) AS rows, sum(is_fraud)::BIGINT AS positives, count(*) FILTER (WHERE score >= threshold) AS alerts, count(*) FILTER (WHERE score >= threshold AND is_fraud = 1) AS tp FROM {s} CROSS JOIN (SELECT DISTINCT threshold FROM picks WHERE threshold IS NOT NULL) GROUP BY threshold") + ")"
        for s in ("v", "t")
    ],
    """joined AS (SELECT p.*, v.precision AS valid_precision, v.recall AS valid_recall, v.f1 AS valid_f1, t.precision AS test_precision, t.recall AS test_recall, t.f1 AS test_f1, t.alerts_per_1k AS test_alerts_per_1k
      FROM picks p LEFT JOIN mv v ON p.threshold = v.threshold LEFT JOIN mt t ON p.threshold = t.threshold)""",
)
_OPS_COLS = ("threshold", "valid_precision", "valid_recall", "valid_f1", "test_precision", "test_recall", "test_f1", "test_alerts_per_1k")
_OPS_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _OPS_COLS)


def _points(spark, d):
    return thresholds.operating_points(_pred(spark, d, "valid"), _pred(spark, d, "test"))


@query("l12_operating_points", _OPS_CTES + f"""
SELECT selection_type, selection_value, feasible, {_OPS_ROUND},
  CASE WHEN selection_type = 'alert_budget' THEN row_number() OVER (PARTITION BY selection_type ORDER BY valid_f1 DESC, valid_precision DESC, selection_value) = 1
       ELSE feasible AND row_number() OVER (PARTITION BY selection_type ORDER BY feasible DESC, valid_recall DESC, selection_value DESC) = 1 END AS recommended FROM joined""")
def l12(spark, d):
    return rounded(_points(spark, d).select("selection_type", "selection_value", "feasible", *_OPS_COLS, "recommended"), *_OPS_COLS)


@query("l13_operating_table", _OPS_CTES + f"SELECT selection_type, selection_value, {_OPS_ROUND} FROM joined")
def l13(spark, d):
    return rounded(thresholds.operating_table(_points(spark, d)), *_OPS_COLS)


_LEAK = """leak AS (SELECT transaction_id, is_fraud, branch_a_score, is_fraud * 10.0::DOUBLE + branch_c_score / 10 AS leaky, 1 - is_fraud AS inverse, 3 AS constant FROM branches)"""


def _leaky(spark, d):
    return A.branches(spark, d).select(
        "transaction_id", "is_fraud", "branch_a_score", (F.col("is_fraud") * 10.0 + F.col("branch_c_score") / 10).alias("leaky"),
        (1 - F.col("is_fraud")).alias("inverse"), F.lit(3).alias("constant"),
    )


_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, is_fraud)) AS absolute_correlation FROM leak" for c in ("branch_a_score", "leaky", "inverse"))


@query("l14_leakage_correlations", with_ctes(A.BRANCHES, _LEAK) + f"SELECT feature, round(absolute_correlation, 6) AS absolute_correlation FROM ({_CORR}) WHERE absolute_correlation >= 0.98")
def l14(spark, d):
    return rounded(leakage.leakage_correlations(_leaky(spark, d)), "absolute_correlation")


_PERFECT = """perfect AS (SELECT is_fraud, split, CASE WHEN split = 'valid' THEN is_fraud::DOUBLE ELSE branch_c_score END AS score, CASE WHEN split = 'valid' THEN is_fraud ELSE CASE WHEN branch_c_score >= 0.5::DOUBLE THEN 1 ELSE 0 END END AS predicted_label FROM branches)"""


def _perfect(spark, d):
    b = A.branches(spark, d)
    score = F.when(F.col("split") == "valid", F.col("is_fraud").cast("double")).otherwise(F.col("branch_c_score"))
    return b.select("is_fraud", "split", score.alias("score"), (score >= 0.5).cast("int").alias("predicted_label"))


_IMPL = """SELECT 'implausibly_high_performance' AS type, split FROM evaluated WHERE f1 >= 0.995 OR average_precision >= 0.999 UNION ALL SELECT 'perfect_confusion_matrix', split FROM evaluated WHERE fp = 0 AND fn = 0"""


@query("l15_implausible_performance", with_ctes(A.BRANCHES, _PERFECT, evaluate_sql("perfect", "split")) + _IMPL)
def l15(spark, d):
    return leakage.implausible_performance(metrics.evaluate(_perfect(spark, d), ["split"]))


@query("l16_leakage_checks", with_ctes(A.BRANCHES, _LEAK, _PERFECT, evaluate_sql("perfect", "split")) + f"""
SELECT 'suspicious_feature_target_correlation' AS type, feature AS subject FROM ({_CORR}) WHERE absolute_correlation >= 0.98 UNION ALL SELECT type, split FROM ({_IMPL})""")
def l16(spark, d):
    ids = A.branches(spark, d).select("transaction_id", "split")
    return leakage.leakage_checks(ids, _leaky(spark, d), metrics.evaluate(_perfect(spark, d), ["split"]))


@query("l17_branch_report", with_ctes(
    A.SCORED, "v AS (SELECT * FROM scored WHERE split = 'valid')", curve_cte("v", name="curve"), POINTS,
    "chosen AS (SELECT score AS threshold FROM (SELECT *, row_number() OVER (ORDER BY p DESC, score DESC) AS rn FROM (SELECT *, max(f1) OVER () AS best FROM points) WHERE f1 >= best - 1e-12) WHERE rn = 1)",
    "both_modes AS (SELECT transaction_id, is_fraud, score, split, mode, threshold, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS predicted_label FROM (SELECT * EXCLUDE (predicted_label) FROM scored) CROSS JOIN (SELECT 'selected' AS mode, threshold FROM chosen UNION ALL SELECT 'baseline', 0.5::DOUBLE))",
    evaluate_sql("both_modes", "split, mode, threshold").replace("curve AS", "curve2 AS", 1).replace("FROM curve GROUP", "FROM curve2 GROUP"),
) + f"SELECT split, mode, round(threshold, 6) AS threshold, n, tn, fp, fn, tp, {_ROUND_METRICS} FROM evaluated")
def l17(spark, d):
    return rounded(metrics.branch_report(_pred(spark, d)), "threshold", *METRICS)


@query("l17_usefulness", with_ctes(A.SCORED, evaluate_sql("scored", "split")) + """
SELECT valid_f1, valid_average_precision, test_f1, test_average_precision, test_average_precision >= 0.1 AND test_f1 >= 0.05 AS useful FROM (
  SELECT round(max(f1) FILTER (split = 'valid'), 6) AS valid_f1, round(max(average_precision) FILTER (split = 'valid'), 6) AS valid_average_precision,
         round(max(f1) FILTER (split = 'test'), 6) AS test_f1, round(max(average_precision) FILTER (split = 'test'), 6) AS test_average_precision FROM evaluated)""")
def l17_useful(spark, d):
    out = metrics.usefulness_report(metrics.evaluate(_pred(spark, d), ["split"]))
    return rounded(out, "valid_f1", "valid_average_precision", "test_f1", "test_average_precision")


ABLATION = ablation.AblationConfig(leave_out={f"no_{n}": n for n in NAMES})


@query("l18_ablations")
def l18(spark, d):
    return ablation.ablations(_valid(spark, d), _test(spark, d), ABLATION)


@query("l19_ablation_summary")
def l19(spark, d):
    return ablation.ablation_summary(l18(spark, d))


@query("l20_recommend_variant")
def l20(spark, d):
    return ablation.recommend_variant(l18(spark, d))


@query("l21_score_summary", with_ctes(A.SCORED) + """
SELECT count(*) AS rows_scored, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, sum(predicted_label)::BIGINT AS positive_predictions, true AS labels_available FROM scored""")
def l21(spark, d):
    return rounded(metrics.score_summary(_pred(spark, d)), "min_score", "max_score", "mean_score")


@query("d13_top_errors", with_ctes(A.SCORED) + """
SELECT * EXCLUDE (score), round(score, 6) AS score FROM (
  SELECT 'false_positive' AS kind, row_number() OVER (ORDER BY score DESC, transaction_id) AS rank, transaction_id, is_fraud, score, predicted_label FROM scored WHERE is_fraud = 0 AND predicted_label = 1
  UNION ALL SELECT 'false_negative', row_number() OVER (ORDER BY score, transaction_id), transaction_id, is_fraud, score, predicted_label FROM scored WHERE is_fraud = 1 AND predicted_label = 0) WHERE rank <= 50""")
def d13(spark, d):
    return rounded(metrics.top_errors(_pred(spark, d)), "score")
