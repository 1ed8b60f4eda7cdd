"""Feature queries per user, card and profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline import dims
from perkline.operators import features as fe
from perkline.operators import modeling, ordered
from perkline.plans.registry import query
from perkline.sources import sinks

R = lambda c, n=9: F.round(c, n).alias(c)


@query(
    "spending_by_category",
    "AGG1",
    """SELECT user_id, category, round(sum(amount), 4) AS total_spent, count(amount) AS transaction_count, round(avg(amount), 9) AS avg_transaction,
     max(amount) AS max_transaction, min(amount) AS min_transaction, round(stddev_samp(amount), 7) AS std_transaction FROM transactions GROUP BY 1, 2""",
    "transactions",
)
def spending_by_category(t):
    d = fe.spending_by_category(t("transactions"))
    return d.select(
        "user_id", "category", R("total_spent", 4), "transaction_count", R("avg_transaction"), "max_transaction", "min_transaction", R("std_transaction", 7)
    )


CATS = fe.FEATURE_CATEGORIES
PIV = ", ".join(
    f"round(coalesce(sum(amount) FILTER (category = '{c}'), 0), 4) AS {c}_total_spent, count(amount) FILTER (category = '{c}') AS {c}_txn_count" for c in CATS
)
ENT_SUM = " + ".join(f"greatest({c}_total_spent, 0)" for c in CATS)
ENT = " + ".join(
    f"CASE WHEN {c}_total_spent > 0 THEN -({c}_total_spent / s) * log2({c}_total_spent / s + 1e-10) ELSE 0 END" for c in CATS
)


@query(
    "user_spending_pivot",
    "RSH1 AGG8 MAT2 AGG2 AGG7",
    f"""WITH p AS (SELECT user_id, {PIV}, round(sum(amount), 4) AS total_spending, count(amount) AS total_transactions,
      round(avg(CASE WHEN isodow(txn_date) >= 6 THEN 1 ELSE 0 END), 9) AS weekend_spending_ratio, round(avg(amount), 9) AS avg_transaction_amount,
      round(stddev_samp(amount), 5) AS transaction_amount_std, sum(suspicious)::BIGINT AS num_suspicious, round(avg(suspicious), 9) AS suspicious_rate FROM transactions GROUP BY 1),
    q AS (SELECT *, {ENT_SUM} AS s FROM p)
    SELECT * EXCLUDE (s), round(CASE WHEN s > 0 THEN {ENT} ELSE 0 END, 5) + 0 AS spending_diversity FROM q""",
    "transactions",
)
def user_spending_pivot(t):
    d = fe.base_block(t("transactions"), CATS)
    keep = []
    for c in d.columns:
        if c.endswith("_total_spent") or c == "total_spending":
            keep.append(R(c, 4))
        elif c in ("weekend_spending_ratio", "avg_transaction_amount", "suspicious_rate"):
            keep.append(R(c))
        elif c in ("transaction_amount_std", "spending_diversity"):
            keep.append(R(c, 5))
        elif c not in ("__n", "peak_spending_month", "peak_spending_day"):
            keep.append(F.col(c))
    return d.select(*keep)


@query(
    "user_frequencies",
    "AGG3 AGG4 AGG5 AGG6 DAT1 JON3",
    """WITH t AS (SELECT *, month(txn_date) AS mo, isodow(txn_date) - 1 AS dw FROM transactions),
   m1 AS (SELECT user_id, mo, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, mo) AS k FROM t GROUP BY 1, 2),
   m2 AS (SELECT user_id, dw, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, dw) AS k FROM t GROUP BY 1, 2),
   m3 AS (SELECT user_id, card_used, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, card_used) AS k FROM t GROUP BY 1, 2),
   m4 AS (SELECT user_id, mcc_code, avg(amount) AS am, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, mcc_code) AS k FROM t GROUP BY 1, 2),
   m5 AS (SELECT user_id, merchant, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, merchant) AS k FROM t GROUP BY 1, 2)
   SELECT a.user_id, m1.mo::INT AS peak_spending_month, m2.dw::INT AS peak_spending_day, a.nc AS num_cards_used, m3.card_used AS primary_card, a.nm AS num_unique_mccs,
     m4.mcc_code AS primary_mcc, round((SELECT avg(am) FROM m4 x WHERE x.user_id = a.user_id), 8) AS avg_spending_per_mcc, a.nme AS num_unique_merchants, m5.merchant AS favorite_merchant
   FROM (SELECT user_id, count(DISTINCT card_used) AS nc, count(DISTINCT mcc_code) AS nm, count(DISTINCT merchant) AS nme FROM t GROUP BY 1) a
   JOIN m1 ON m1.user_id = a.user_id AND m1.k = 1 JOIN m2 ON m2.user_id = a.user_id AND m2.k = 1 JOIN m3 ON m3.user_id = a.user_id AND m3.k = 1
   JOIN m4 ON m4.user_id = a.user_id AND m4.k = 1 JOIN m5 ON m5.user_id = a.user_id AND m5.k = 1""",
    "transactions",
)
def user_frequencies(t):
    """Both blocks read the purchases, which are put together from their tables once."""
    txns = t("transactions").select("user_id", "txn_date", "amount", "card_used", "mcc_code", "merchant")
    txns = modeling.written(txns, sinks.work_folder(t.spark, "frequencies"))
    peaks = fe.base_block(txns, []).select("user_id", "peak_spending_month", "peak_spending_day")
    d = peaks.join(fe.frequency_block(txns), "user_id")
    return d.withColumn("avg_spending_per_mcc", F.round("avg_spending_per_mcc", 8))


@query(
    "user_features",
    "RWD21 JON2 WIN1 AGG2 AGG6",
    """WITH l AS (SELECT *, lag(card_used) OVER (PARTITION BY user_id ORDER BY txn_date, transaction_id, tie_break) AS p FROM transactions)
   SELECT user_id, round(sum(amount), 4) AS total_spending, count(*) AS total_transactions, round(median(amount), 9) AS median_transaction_amount,
     round(CASE WHEN count(*) > 1 THEN sum(CASE WHEN p IS NOT NULL AND p <> card_used THEN 1 ELSE 0 END) / (count(*) - 1) ELSE 0 END, 9) AS card_switch_rate,
     round((count(*) - count(DISTINCT merchant)) / count(*), 9) AS repeat_merchant_ratio, count(DISTINCT card_used) AS num_cards_used,
     round(coalesce(sum(amount) FILTER (category = 'dining'), 0), 4) AS dining_total_spent FROM l GROUP BY 1""",
    "transactions",
)
def user_features(t):
    """Purchases are put together from their tables once; every block of features reads the written table."""
    txns = modeling.written(t("transactions"), sinks.work_folder(t.spark, "purchases"))
    d = fe.user_features(txns, order=("txn_date", "transaction_id", "tie_break"))
    return d.select(
        "user_id", R("total_spending", 4), "total_transactions", R("median_transaction_amount"), R("card_switch_rate"), R("repeat_merchant_ratio"),
        "num_cards_used", R("dining_total_spent", 4),
    )


CENTS = "CASE cur " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.CENTS_PER_UNIT.items()) + " ELSE 1.0 END::DOUBLE"
CARD_FEATURES = f"""a AS (SELECT *, p_size_.*, coalesce(currency, 'POINTS') AS cur, coalesce(try_cast(annual_fee AS DOUBLE), 0) AS fee FROM cards),
 j AS (SELECT *, CASE WHEN reward_rates IS NULL THEN NULL ELSE reward_rates::JSON END AS rj, CASE WHEN offers IS NULL THEN NULL ELSE offers::JSON END AS oj, credits::JSON AS cj FROM
    (SELECT *, coalesce(currency, 'POINTS') AS cur, coalesce(try_cast(annual_fee AS DOUBLE), 0) AS fee FROM cards)),
 b AS (SELECT *, coalesce(
     coalesce(try_cast(rj->>'$.universal_base_rate' AS DOUBLE), try_cast(rj->>'$.universal_cashback_percent' AS DOUBLE), try_cast(rj->>'$.base' AS DOUBLE)),
     greatest(try_cast(rj->>'$.rates[0].rate' AS DOUBLE), try_cast(rj->>'$.rates[1].value' AS DOUBLE)),
     CASE WHEN json_type(rj) = 'ARRAY' THEN greatest(try_cast(rj->>'$[0]' AS DOUBLE), try_cast(rj->>'$[1]' AS DOUBLE)) END, 0) AS base_reward_rate,
   coalesce(try_cast(oj->>'$[0].spend' AS DOUBLE), 0) AS spend, coalesce(try_cast(oj->>'$[0].amount[0].amount' AS DOUBLE), 0) AS amt, coalesce(try_cast(oj->>'$[0].days' AS INT), 90) AS days,
   CASE WHEN json_array_length(cj) > 0 THEN try_cast(cj->>'$[0].value' AS DOUBLE) + 12.5 ELSE 0 END AS cred, CASE WHEN json_array_length(cj) > 0 THEN 3 ELSE 0 END AS ncred FROM j),
 c AS (SELECT *, amt * {CENTS} / 100 AS usd, fee - cred AS eff, 25000 * (base_reward_rate / 100) AS expct FROM b)"""
CARD_FEATURES = CARD_FEATURES[CARD_FEATURES.index(" j AS") :].lstrip()


@query(
    "card_features",
    "RWD18 RWD19 RWD20 RWD21 JSN1 ARR1 ARR3 RSH5 CLN7 MAP1 STR9",
    f"""WITH {CARD_FEATURES}
   SELECT card_id, CASE WHEN coalesce(discontinued, false) THEN 0 ELSE 1 END AS is_active, round(base_reward_rate, 9) AS base_reward_rate, spend AS welcome_bonus_spend_req,
     amt AS welcome_bonus_amount, days AS welcome_bonus_days, round(usd, 9) AS welcome_bonus_value_usd, round(CASE WHEN spend > 0 THEN usd / spend ELSE 0 END, 9) AS welcome_bonus_roi,
     CASE WHEN spend = 0 THEN 'none' WHEN spend < 2000 AND days >= 90 THEN 'easy' WHEN spend > 5000 OR days < 60 THEN 'hard' ELSE 'medium' END AS bonus_difficulty,
     cred AS annual_credits_value, ncred AS num_credits, round(eff, 9) AS effective_annual_fee, round(CASE WHEN coalesce(is_annual_fee_waived, false) THEN 0 - cred ELSE eff END, 9) AS effective_fee_year1,
     round(expct - eff, 9) AS net_value_annual, round(expct - CASE WHEN coalesce(is_annual_fee_waived, false) THEN 0 - cred ELSE eff END + usd, 9) AS net_value_year1,
     round((expct - eff) / 25000, 8) AS value_per_dollar, CASE WHEN fee >= 450 THEN 1 ELSE 0 END AS is_premium, CASE WHEN fee >= 95 AND fee < 450 THEN 1 ELSE 0 END AS is_mid_tier,
     CASE WHEN fee = 0 THEN 1 ELSE 0 END AS is_no_annual_fee, CASE WHEN coalesce(is_business, false) THEN 1 ELSE 0 END AS is_business,
     CASE WHEN network = 'visa' THEN 1 ELSE 0 END AS network_visa, CASE WHEN issuer = 'boa' THEN 1 ELSE 0 END AS issuer_boa, CASE WHEN cur = 'POINTS' THEN 1 ELSE 0 END AS "currency_POINTS" FROM c""",
    "cards",
)
def card_features(t):
    d = fe.card_features(t("cards"), 25000.0, ["boa"], ["visa"], ["POINTS"])
    return d.select(
        "card_id", "is_active", R("base_reward_rate"), "welcome_bonus_spend_req", "welcome_bonus_amount", "welcome_bonus_days", R("welcome_bonus_value_usd"),
        R("welcome_bonus_roi"), "bonus_difficulty", "annual_credits_value", "num_credits", R("effective_annual_fee"), R("effective_fee_year1"),
        R("net_value_annual"), R("net_value_year1"), R("value_per_dollar", 8), "is_premium", "is_mid_tier", "is_no_annual_fee", "is_business",
        "network_visa", "issuer_boa", "currency_POINTS",
    )


def _oh(col: str, values: list[str], prefix: str) -> str:
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}_{v}\"" for v in values)


@query(
    "profile_features",
    "RSH4 WIN6 MAT1 MAP1 ARR4 RWD21",
    f"""WITH e AS (SELECT quantile_cont(monthly_budget, 0.25) AS q1, quantile_cont(monthly_budget, 0.5) AS q2, quantile_cont(monthly_budget, 0.75) AS q3 FROM users),
   b AS (SELECT u.*, CASE WHEN monthly_budget <= q1 THEN 'Q1_low' WHEN monthly_budget <= q2 THEN 'Q2_medium_low' WHEN monthly_budget <= q3 THEN 'Q3_medium_high' ELSE 'Q4_high' END AS budget_quartile FROM users u CROSS JOIN e)
   SELECT user_id, round(monthly_budget * 12, 4) AS annual_budget, round(CASE WHEN monthly_budget > -1 THEN ln(1 + monthly_budget) END, 9) AS monthly_budget_log, budget_quartile,
     {_oh('archetype', dims.ARCHETYPES, 'archetype')}, {_oh('age_group', dims.AGE_GROUPS, 'age')}, {_oh('location_type', dims.LOCATIONS, 'location')},
     {_oh('budget_quartile', fe.QUARTER_LABELS, 'budget')}, {_oh('redemption_preference', dims.REDEMPTIONS, 'redemption')} FROM b""",
    "users",
)
def profile_features(t):
    d = fe.profile_features(t("users"))
    hot = [c for c in d.columns if c.split("_")[0] in ("archetype", "age", "location", "budget", "redemption")]
    hot = [c for c in hot if c not in ("archetype", "age_group", "age_group_ordinal", "location_type", "budget_quartile", "redemption_preference")]
    return d.select("user_id", R("annual_budget", 4), R("monthly_budget_log"), "budget_quartile", *hot)


@query(
    "user_cards_exploded",
    "RSH2",
    """SELECT user_id, trim(c) AS card_id, redemption_preference FROM (SELECT user_id, redemption_preference, unnest(string_split(regexp_replace(cards, '[\\[\\]''"]', '', 'g'), ',')) AS c FROM users) WHERE trim(c) <> ''""",
    "users",
)
def user_cards_exploded(t):
    return fe.user_cards(t("users"))


@query(
    "running_spend",
    "WIN4",
    """SELECT user_id, category, round(sum(before), 2) AS sum_before, round(max(before), 2) AS max_before FROM (SELECT *, coalesce(sum(round(greatest(amount, 0) * 100)::BIGINT) OVER
     (PARTITION BY user_id, category ORDER BY txn_date, transaction_id, tie_break ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100 AS before FROM transactions) GROUP BY 1, 2""",
    "transactions",
)
def running_spend(t):
    from perkline.operators import scoring as sc

    txns = t("transactions").select("user_id", "category", "txn_date", "transaction_id", "tie_break", "amount")
    txns = modeling.written(txns, sinks.work_folder(t.spark, "spend"))
    d = sc.spend_before(txns, ["user_id", "category"], ["txn_date", "transaction_id", "tie_break"], F.col("txn_date"), many=True)
    return d.groupBy("user_id", "category").agg(
        F.round(F.sum("spent_before"), 2).alias("sum_before"), F.round(F.max("spent_before"), 2).alias("max_before")
    )


@query(
    "exact_quantiles",
    "AGG10 ANM2",
    """SELECT category, count(*) AS n_values, round(quantile_cont(amount, 0.1), 9) AS p10, round(quantile_cont(amount, 0.5), 9) AS p50, round(quantile_cont(amount, 0.95), 9) AS p95 FROM transactions GROUP BY 1""",
    "transactions",
)
def exact_quantiles(t):
    d = ordered.quantiles(t("transactions"), ["category"], "amount", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return d.select("category", "n_values", R("p10"), R("p50"), R("p95"))


@query(
    "chronological_index",
    "TOP9",
    """SELECT txn_date, min(i)::BIGINT AS first_index, max(i)::BIGINT AS last_index FROM (SELECT *, row_number() OVER (ORDER BY txn_date, user_id, transaction_id, tie_break) AS i FROM transactions) GROUP BY 1""",
    "transactions",
)
def chronological_index(t):
    order = [F.col(c) for c in ("txn_date", "user_id", "transaction_id", "tie_break")]
    d = ordered.row_index(t("transactions"), [], F.col("txn_date"), order, "i", within="user_id")
    return d.groupBy("txn_date").agg(F.min("i").alias("first_index"), F.max("i").alias("last_index"))
