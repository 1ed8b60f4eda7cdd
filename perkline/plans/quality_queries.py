"""Quality, anomaly, profile and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline import dims
from perkline.operators import drift, features, profiling, quality
from perkline.operators.ordered import average_ranks
from perkline.plans.cleaning_queries import AS_OF
from perkline.plans.feature_queries import CARD_FEATURES
from perkline.plans.registry import query

R = lambda c, n=8: F.round(c, n).alias(c)
IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _rule_sql(table: str, r: quality.Rule, data: str) -> str:
    c = r.column
    head = f"SELECT '{data}' AS dataset, '{r.kind}' AS rule, '{c or '*'}' AS \"column\", "
    if r.kind == "columns":
        return f"SELECT '{data}' AS dataset, 'columns' AS rule, '*' AS \"column\", 1 AS evaluated, {{cols_broken}} AS broken, {{cols_ok}} AS passed"
    if r.kind == "unique":
        return head + (
            f"count({c}) AS evaluated, coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE n > 1), 0)::BIGINT AS broken, "
            f"count({c}) = count(DISTINCT {c}) AS passed FROM {table}"
        )
    ok = {
        "not_null": f"{c} IS NOT NULL",
        "between": " AND ".join(
            ([f"{c} {'>' if r.strict else '>='} {r.low}"] if r.low is not None else []) + ([f"{c} {'<' if r.strict else '<='} {r.high}"] if r.high is not None else [])
        ),
        "matches": f"regexp_matches({c}, '{r.pattern}')",
        "in_set": f"{c} IN ({IN(r.values)})" if r.values else "true",
    }[r.kind]
    n = "count(*)" if r.kind == "not_null" else f"count({c})"
    bad = f"count(*) FILTER (NOT ({ok}))"
    return head + f"{n} AS evaluated, {bad} AS broken, CASE WHEN {n} > 0 THEN 1 - {bad} / {n} >= {r.mostly} ELSE true END AS passed FROM {table}"


def _suite_sql(table: str, data: str, cols_ok: bool) -> str:
    text = "\nUNION ALL ".join(_rule_sql(table, r, data) for r in quality.SUITES[data])
    return text.replace("{cols_broken}", "0" if cols_ok else "1").replace("{cols_ok}", "true" if cols_ok else "false")


SUITE_SQL = (
    "WITH tt AS (SELECT transaction_id, user_id, date_text, category, merchant, mcc_code, amount, card_used FROM raw_transactions), "
    "cc AS (SELECT card_id, card_name, issuer, try_cast(annual_fee AS DOUBLE) AS annual_fee, reward_rates FROM cards) "
    + " UNION ALL ".join([_suite_sql("tt", "transactions", True), _suite_sql("users", "users", True), _suite_sql("cc", "cards", False)])
)


def _suites(t):
    q = quality
    tx = t("raw_transactions").withColumnRenamed("date_text", "date").drop("tie_break")
    cards = t("cards").select("card_id", "card_name", "issuer", F.col("annual_fee").try_cast("double").alias("annual_fee"), "reward_rates")
    return (
        q.run_suite(tx, q.SUITES["transactions"], "transactions")
        .unionByName(q.run_suite(t("users").drop("ord"), q.SUITES["users"], "users"))
        .unionByName(q.run_suite(cards, q.SUITES["cards"], "cards"))
    )


@query("quality_suites", "DQ1 DQ2 DQ3 DQ4 DQ5 DQ6 DQ7 DQ8", SUITE_SQL, "raw_transactions users cards")
def quality_suites(t):
    return _suites(t)


@query(
    "quality_summary",
    "DQ8 DQ10",
    f"SELECT dataset, count(*) AS evaluated_rules, count(*) FILTER (passed) AS successful_rules, count(*) FILTER (NOT passed) AS failed_rules, bool_and(passed) AS passed FROM ({SUITE_SQL}) GROUP BY 1".replace("FROM (WITH", "FROM (WITH"),
    "raw_transactions users cards",
)
def quality_summary(t):
    handed = quality.require_columns(_suites(t), ["dataset", "passed"], "suite results")
    return quality.suite_summary(handed)


@query(
    "row_contracts",
    "DQ9",
    f"""WITH t AS (SELECT list_filter([CASE WHEN coalesce(NOT regexp_matches(user_id, '^user_[0-9]+$'), true) THEN 'user_id' END, CASE WHEN coalesce(NOT starts_with(transaction_id, 'txn_'), true) THEN 'transaction_id' END,
      CASE WHEN coalesce(category NOT IN ({IN(dims.TXN_CATEGORIES)}), true) THEN 'category' END, CASE WHEN coalesce(NOT mcc_code BETWEEN 1000 AND 9999, true) THEN 'mcc_code' END,
      CASE WHEN coalesce(NOT amount > 0, true) THEN 'amount' END], lambda x: x IS NOT NULL) AS r FROM raw_transactions),
    u AS (SELECT list_filter([CASE WHEN archetype NOT IN ({IN(dims.ARCHETYPES)}) THEN 'archetype' END, CASE WHEN coalesce(NOT monthly_budget > 0, true) THEN 'monthly_budget' END,
      CASE WHEN coalesce(location_type NOT IN ({IN(dims.LOCATIONS)}), true) THEN 'location_type' END], lambda x: x IS NOT NULL) AS r FROM users)
    SELECT 'transactions' AS dataset, array_to_string(r, ',') AS reasons, count(*) AS n FROM t GROUP BY 1, 2 UNION ALL SELECT 'users', array_to_string(r, ','), count(*) FROM u GROUP BY 1, 2""",
    "raw_transactions users",
)
def row_contracts(t):
    def one(df, reasons, name):
        good, bad = quality.split_rows(df, reasons)
        a = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), F.lit("").alias("reasons"), "n")
        b = bad.groupBy(F.concat_ws(",", "reject_reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))
        return a.where("n > 0").unionByName(b.select(F.lit(name).alias("dataset"), "reasons", "n"))

    return one(t("raw_transactions"), quality.transaction_reasons(), "transactions").unionByName(one(t("users"), quality.user_reasons(), "users"))


@query(
    "table_checks",
    "DQ11",
    """SELECT 'duplicates' AS "check", count(*) - count(DISTINCT transaction_id) AS n FROM transactions UNION ALL SELECT 'negative', count(*) FILTER (amount < 0) FROM transactions
     UNION ALL SELECT 'out_of_range', count(*) FILTER (amount < 0 OR amount > 900) FROM transactions UNION ALL SELECT 'future_dates', count(*) FILTER (txn_date > DATE '2001-06-01') FROM transactions""",
    "transactions",
)
def table_checks(t):
    return quality.table_checks(t("transactions"), "transaction_id", "amount", "txn_date", AS_OF, 0, 900)


NULLED = ["card_name", "issuer", "network", "annual_fee", "currency", "reward_rates", "offers", "credits", "welcome_bonus", "discontinued", "is_annual_fee_waived", "is_business"]


@query(
    "null_shares",
    "TOP4",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 9) AS null_share FROM cards" for c in NULLED) + ") ORDER BY null_share DESC, \"column\" LIMIT 10",
    "cards",
)
def null_shares(t):
    return quality.null_shares(t("cards").select(*NULLED), 10).select("column", R("null_share", 9))


@query(
    "missing_values",
    "ANM1",
    "SELECT 'cards' AS dataset, 'missing_values' AS check_name, * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN r >= 0.2 THEN 'CRITICAL' WHEN r >= 0.05 THEN 'WARNING' END AS severity, k::DOUBLE AS observed, round(r, 9) AS ratio FROM (SELECT count(*) FILTER ({c} IS NULL) AS k, count(*) FILTER ({c} IS NULL) / count(*) AS r FROM cards)"
        for c in NULLED
    ) + ") WHERE severity IS NOT NULL",
    "cards",
)
def missing_values(t):
    return quality.missing_values(t("cards").select(*NULLED), "cards").withColumn("ratio", F.round("ratio", 9))


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
SKEWED = {**{c: c for c in NUMS}, "cubed": "l_quantity * l_quantity * l_quantity", "rare": "CASE WHEN l_quantity > 42 THEN l_quantity * 100 WHEN l_quantity > 40 THEN 0 ELSE l_quantity END", "spike": "CASE WHEN l_linenumber = 7 AND l_quantity > 32 THEN 1000000 ELSE 0 END"}
WIDE = "w AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in SKEWED.items()) + " FROM lineitem), lg AS (UNPIVOT w ON COLUMNS(*) INTO NAME \"column\" VALUE value)"


def _skewed(t):
    return t("lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in SKEWED.items()])


@query(
    "outliers_iqr",
    "ANM2",
    f"""WITH {WIDE}, q AS (SELECT "column", count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg GROUP BY 1),
  h AS (SELECT lg."column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS k, count(*) AS n FROM lg JOIN q ON q."column" = lg."column" WHERE q.n >= 4 AND q3 <> q1 GROUP BY 1)
  SELECT 'lineitem' AS dataset, 'outlier_iqr' AS check_name, "column", CASE WHEN k / n >= 0.15 THEN 'CRITICAL' WHEN k / n >= 0.05 THEN 'WARNING' END AS severity, k::DOUBLE AS observed, round(k / n, 9) AS ratio FROM h WHERE k / n >= 0.05""",
)
def outliers_iqr(t):
    return quality.outliers_iqr(_skewed(t), "lineitem").withColumn("ratio", F.round("ratio", 9))


@query(
    "outliers_zscore",
    "ANM3",
    f"""WITH {WIDE}, q AS (SELECT "column", avg(value) AS m, stddev_samp(value) AS s FROM lg GROUP BY 1),
  h AS (SELECT lg."column", count(*) FILTER (abs((value - m) / s) > 2.0) AS k, count(*) AS n FROM lg JOIN q ON q."column" = lg."column" WHERE s > 0 GROUP BY 1)
  SELECT 'lineitem' AS dataset, 'outlier_zscore' AS check_name, "column", CASE WHEN k / n >= 0.05 THEN 'CRITICAL' WHEN k / n >= 0.02 THEN 'WARNING' END AS severity, k::DOUBLE AS observed, round(k / n, 9) AS ratio FROM h WHERE k / n >= 0.02""",
)
def outliers_zscore(t):
    return quality.outliers_zscore(_skewed(t), "lineitem", limit=2.0, warning=0.02, critical=0.05).withColumn("ratio", F.round("ratio", 9))


@query(
    "schema_violations",
    "ANM4",
    """SELECT 'events' AS dataset, 'missing_column' AS check_name, 'amount' AS "column", 'CRITICAL' AS severity, count(*)::DOUBLE AS observed, 1.0::DOUBLE AS ratio FROM events
     UNION ALL SELECT 'events', 'dtype_mismatch', 'props', 'WARNING', count(*), 1.0 FROM events""",
)
def schema_violations(t):
    return quality.schema_violations(t("events"), "events", ["event_id", "amount"], {"props": "numeric", "value": "numeric", "ts": "datetime"})


CARD_RULES_SQL = f"""SELECT dataset, check_name, "column", severity, observed::DOUBLE AS observed, round(ratio, 9)::DOUBLE AS ratio FROM (
   WITH {CARD_FEATURES}, s AS (SELECT count(*) AS n, count(*) FILTER (base_reward_rate > 10) AS rate, count(*) FILTER (fee > 5000) AS fee, count(*) FILTER (CASE WHEN spend > 0 THEN usd / spend ELSE 0 END > 1) AS roi, count(*) FILTER (discontinued) AS gone, count(*) - count(DISTINCT coalesce(card_name, '~')) AS dup FROM c)
   SELECT 'cards' AS dataset, 'domain_reward_rate_too_high' AS check_name, 'base_reward_rate' AS "column", CASE WHEN rate > 0 THEN 'CRITICAL' END AS severity, rate AS observed, rate / n AS ratio FROM s
   UNION ALL SELECT 'cards', 'domain_annual_fee_extreme', 'annual_fee', CASE WHEN fee > 0 THEN 'WARNING' END, fee, fee / n FROM s
   UNION ALL SELECT 'cards', 'domain_welcome_bonus_roi_extreme', 'welcome_bonus_roi', CASE WHEN roi > 0 THEN 'WARNING' END, roi, roi / n FROM s
   UNION ALL SELECT 'cards', 'domain_high_discontinued_ratio', 'discontinued', CASE WHEN gone / n > 0.2 THEN 'WARNING' END, gone, gone / n FROM s
   UNION ALL SELECT 'cards', 'domain_duplicate_card_names', 'card_name', CASE WHEN dup > 0 THEN 'WARNING' END, dup, 0 FROM s) WHERE severity IS NOT NULL"""
TXN_RULES_SQL = """SELECT dataset, check_name, "column", severity, observed::DOUBLE AS observed, round(ratio, 9)::DOUBLE AS ratio FROM (
   WITH s AS (SELECT count(*) AS n, count(*) FILTER (amount > 10000) AS high, count(*) FILTER (txn_date > DATE '2001-06-01') AS fut, count(*) - count(DISTINCT transaction_id) AS dup FROM transactions),
   u AS (SELECT user_id, count(*) AS k FROM transactions GROUP BY 1), us AS (SELECT avg(k) AS m, stddev_samp(k) AS sd, count(*) AS n FROM u),
   cat AS (SELECT max(k) AS k, sum(k) AS n FROM (SELECT count(*) AS k FROM transactions GROUP BY category))
   SELECT 'transactions' AS dataset, 'domain_high_value_concentration' AS check_name, 'amount' AS "column", CASE WHEN high / n > 0.01 THEN 'WARNING' END AS severity, high AS observed, high / n AS ratio FROM s
   UNION ALL SELECT 'transactions', 'domain_future_dates_present', 'txn_date', CASE WHEN fut > 0 THEN 'CRITICAL' END, fut, fut / n FROM s
   UNION ALL SELECT 'transactions', 'domain_category_imbalance', 'category', CASE WHEN k / n > 0.5 THEN 'WARNING' END, k, k / n FROM cat
   UNION ALL SELECT 'transactions', 'domain_user_transaction_outliers', 'user_id', CASE WHEN b > 0 THEN 'INFO' END, b, b / n FROM (SELECT (SELECT count(*) FROM u WHERE k > m + 3 * sd) AS b, n FROM us)
   UNION ALL SELECT 'transactions', 'domain_duplicate_transaction_ids', 'transaction_id', CASE WHEN dup > 0 THEN 'CRITICAL' END, dup, 0 FROM s) WHERE severity IS NOT NULL"""
ODD = " OR ".join(f"(archetype = '{a}' AND NOT monthly_budget BETWEEN {lo} AND {hi})" for a, (lo, hi) in dims.ARCHETYPE_BUDGET.items())
USER_RULES_SQL = f"""SELECT dataset, check_name, "column", severity, observed::DOUBLE AS observed, round(ratio, 9)::DOUBLE AS ratio FROM (
   WITH s AS (SELECT count(*) AS n, count(*) FILTER ({ODD}) AS odd, count(*) FILTER (archetype NOT IN ({IN(dims.ARCHETYPES)})) AS unk, count(*) - count(DISTINCT user_id) AS dup FROM users)
   SELECT 'users' AS dataset, 'domain_budget_archetype_mismatch' AS check_name, 'monthly_budget' AS "column", CASE WHEN odd / n > 0.1 THEN 'CRITICAL' WHEN odd > 0 THEN 'WARNING' END AS severity, odd AS observed, odd / n AS ratio FROM s
   UNION ALL SELECT 'users', 'domain_invalid_archetype', 'archetype', CASE WHEN unk > 0 THEN 'WARNING' END, unk, unk / n FROM s
   UNION ALL SELECT 'users', 'domain_duplicate_user_ids', 'user_id', CASE WHEN dup > 0 THEN 'CRITICAL' END, dup, 0 FROM s) WHERE severity IS NOT NULL"""


def _anomalies(t):
    return (
        quality.card_rules(features.card_features(t("cards")))
        .unionByName(quality.transaction_rules(t("transactions"), AS_OF))
        .unionByName(quality.user_rules(t("users")))
    )


ALL_RULES = f"({CARD_RULES_SQL}) UNION ALL ({TXN_RULES_SQL}) UNION ALL ({USER_RULES_SQL})"


@query("domain_rules", "ANM7 ANM8 ANM9", ALL_RULES, "cards transactions users")
def domain_rules(t):
    return _anomalies(t).withColumn("ratio", F.round("ratio", 9))


@query(
    "card_rule_details",
    "ANM7",
    f"""WITH {CARD_FEATURES}, x AS (SELECT ord, card_name, base_reward_rate * 3 AS base_reward_rate, fee * 6 AS fee, CASE WHEN spend > 0 THEN usd / spend ELSE 0 END AS roi FROM c),
   d AS (SELECT 'domain_reward_rate_too_high' AS check_name, count(*) FILTER (base_reward_rate > 10) AS "count", round(max(base_reward_rate), 2) AS max_value,
       (SELECT string_agg(card_name, '|' ORDER BY ord) FROM (SELECT card_name, ord FROM x WHERE base_reward_rate > 10 ORDER BY ord LIMIT 5)) AS card_names FROM x
     UNION ALL SELECT 'domain_annual_fee_extreme', count(*) FILTER (fee > 5000), round(max(fee), 2), '' FROM x
     UNION ALL SELECT 'domain_welcome_bonus_roi_extreme', count(*) FILTER (roi > 1), round(max(roi), 4), '' FROM x)
   SELECT check_name, "count", max_value::DOUBLE AS max_value, card_names FROM d WHERE "count" > 0""",
    "cards",
)
def card_rule_details(t):
    """What the card rules found: how many, the largest value, the first five names; rates and fees are raised so that some break them."""
    f = features.card_features(t("cards")).withColumns({"base_reward_rate": F.col("base_reward_rate") * 3, "annual_fee": F.col("annual_fee").try_cast("double") * 6})
    return quality.card_rule_details(f, "ord").withColumn("card_names", F.concat_ws("|", "card_names"))


@query(
    "unknown_archetypes",
    "ANM9",
    f"""WITH o AS (SELECT CASE WHEN ord % 9 = 0 THEN 'kind_' || (ord % 40) ELSE archetype END AS a FROM users), x AS (SELECT a FROM o WHERE a NOT IN ({IN(dims.ARCHETYPES)}))
     SELECT 'users' AS dataset, (SELECT count(*) FROM x) AS rows, (SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT DISTINCT a FROM x ORDER BY a LIMIT 10)) AS examples""",
    "users",
)
def unknown_archetypes(t):
    odd = F.when(F.col("ord") % 9 == 0, F.concat(F.lit("kind_"), (F.col("ord") % 40).cast("string"))).otherwise(F.col("archetype"))
    return quality.unknown_archetypes(t("users").withColumn("archetype", odd))


@query(
    "anomaly_report",
    "ANM6 ANM10",
    f"""SELECT dataset, count(*) AS anomalies, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info,
     max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END)::INT AS max_level, bool_or(severity = 'CRITICAL') AS has_critical FROM ({ALL_RULES}) GROUP BY 1""",
    "cards transactions users",
)
def anomaly_report(t):
    return quality.anomaly_summary(_anomalies(t))


@query(
    "anomaly_gate",
    "ANM10",
    f"SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'CRITICAL') = 0 AS passed FROM ({ALL_RULES})",
    "cards transactions users",
)
def anomaly_gate(t):
    return quality.critical_gate(_anomalies(t))


@query(
    "anomaly_alerts",
    "ANM11",
    f"""WITH r AS ({ALL_RULES}), w AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, check_name, "column") AS i,
      count(*) OVER (PARTITION BY dataset) AS m, printf('  [%s] %s on %s: %.4f', severity, check_name, "column", ratio) AS line FROM r WHERE severity <> 'INFO'),
    l AS (SELECT dataset, string_agg(line, chr(10) ORDER BY i) FILTER (i <= 2) AS lines, max(m) AS m FROM w GROUP BY 1),
    s AS (SELECT dataset, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'WARNING') AS wn, count(*) FILTER (severity = 'INFO') AS i FROM r GROUP BY 1)
    SELECT s.dataset, 'Dataset: ' || s.dataset || chr(10) || 'Anomalies found: ' || n || chr(10) || '  CRITICAL: ' || c || chr(10) || '  WARNING:  ' || wn || chr(10) || '  INFO:     ' || i
      || CASE WHEN lines IS NOT NULL THEN chr(10) || 'Top issues:' || chr(10) || lines ELSE '' END || CASE WHEN m > 2 THEN chr(10) || '  ... and ' || (m - 2) || ' more' ELSE '' END AS message
    FROM s LEFT JOIN l ON l.dataset = s.dataset""",
    "cards transactions users",
)
def anomaly_alerts(t):
    return quality.alert_text(_anomalies(t).withColumn("ratio", F.round("ratio", 9)), top=2)


# ----------------------------------------------------------------------------- profile


def _stat(name: str, expr: str, item: str = "''") -> str:
    return f"SELECT '{name}' AS statistic, {item} AS item, round(({expr})::DOUBLE, 6) AS value"


def _dist(name: str, col: str, table: str) -> str:
    return f"SELECT '{name}' AS statistic, {col} AS item, count(*)::DOUBLE AS value FROM {table} WHERE {col} IS NOT NULL GROUP BY {col}"


CARD_STATS = f"WITH {CARD_FEATURES}, d AS (SELECT * REPLACE (cur AS currency, try_cast(annual_fee AS DOUBLE) AS annual_fee), coalesce(is_business, false) AS biz FROM c) " + " UNION ALL ".join(
    _stat(n, e) + " FROM d"
    for n, e in {
        "total_cards": "count(*)", "fee_mean": "avg(annual_fee)", "fee_min": "min(annual_fee)", "fee_max": "max(annual_fee)", "fee_std": "stddev_samp(annual_fee)",
        "fee_median": "median(annual_fee)", "no_fee_count": "count(*) FILTER (annual_fee = 0)", "no_fee_pct": "count(*) FILTER (annual_fee = 0) / count(*) * 100",
        "premium_count": "count(*) FILTER (annual_fee >= 450)", "premium_pct": "count(*) FILTER (annual_fee >= 450) / count(*) * 100", "rate_mean": "avg(base_reward_rate)",
        "rate_min": "min(base_reward_rate)", "rate_max": "max(base_reward_rate)", "rate_median": "median(base_reward_rate)", "business_count": "count(*) FILTER (biz)",
        "business_pct": "count(*) FILTER (biz) / count(*) * 100", "discontinued_count": "count(*) FILTER (discontinued)", "discontinued_pct": "count(*) FILTER (discontinued) / count(*) * 100",
        "unique_issuers": "count(DISTINCT issuer)", "unique_networks": "count(DISTINCT network)",
    }.items()
) + " UNION ALL " + _dist("currency_distribution", "currency", "d")


@query("card_statistics", "AGG9", CARD_STATS, "cards")
def card_statistics(t):
    return profiling.card_statistics(features.card_features(t("cards"))).select("statistic", "item", R("value", 6))


TXN_STATS = " UNION ALL ".join(
    _stat(n, e) + " FROM transactions"
    for n, e in {
        "total_transactions": "count(*)", "amount_total": "sum(amount)", "amount_mean": "avg(amount)", "amount_min": "min(amount)", "amount_max": "max(amount)", "amount_std": "stddev_samp(amount)",
        "days_covered": "max(txn_date) - min(txn_date)", "suspicious_count": "sum(suspicious)", "suspicious_pct": "avg(suspicious) * 100", "amount_q25": "quantile_cont(amount, 0.25)",
        "amount_median": "median(amount)", "amount_q75": "quantile_cont(amount, 0.75)", "unique_users": "count(DISTINCT user_id)", "unique_merchants": "count(DISTINCT merchant)",
    }.items()
) + " UNION ALL " + _stat("avg_merchants_per_user", "avg(k)") + " FROM (SELECT count(DISTINCT merchant) AS k FROM transactions GROUP BY user_id) UNION ALL " + _dist(
    "category_distribution", "category", "transactions"
) + " UNION ALL SELECT 'category_spending', category, round(sum(amount), 6) FROM transactions GROUP BY 2"


@query("transaction_statistics", "AGG10", TXN_STATS, "transactions")
def transaction_statistics(t):
    return profiling.transaction_statistics(t("transactions")).select("statistic", "item", R("value", 6))


USER_STATS = "WITH d AS (SELECT *, CASE ord % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 3 END AS k FROM users) " + " UNION ALL ".join(
    _stat(n, e) + " FROM d"
    for n, e in {
        "total_users": "count(*)", "budget_mean": "avg(monthly_budget)", "budget_min": "min(monthly_budget)", "budget_max": "max(monthly_budget)", "budget_std": "stddev_samp(monthly_budget)",
        "total_annual_budget": "sum(monthly_budget) * 12", "budget_median": "median(monthly_budget)", "cards_mean": "avg(k)", "cards_min": "min(k)", "cards_max": "max(k)", "cards_median": "median(k)",
    }.items()
) + "".join(" UNION ALL " + _dist(n, c, "d") for n, c in [("archetype_distribution", "archetype"), ("age_distribution", "age_group"), ("location_distribution", "location_type"), ("redemption_distribution", "redemption_preference")])


@query("user_statistics", "AGG11", USER_STATS, "users")
def user_statistics(t):
    from perkline.functions import nested

    return profiling.user_statistics(t("users").withColumn("num_cards", F.size(nested.card_list(F.col("cards"))))).select("statistic", "item", R("value", 6))


@query(
    "describe_numeric",
    "AGG12",
    """WITH w AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_linenumber::DOUBLE END AS line FROM lineitem),
   lg AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR "column" IN (l_quantity, l_extendedprice, l_discount, l_tax, line)))
   SELECT "column", count(value) AS "count", count(*) - count(value) AS missing, round(avg(value), 8) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
     round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM lg GROUP BY 1""",
)
def describe_numeric(t):
    d = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_partkey") % 10 != 0, F.col("l_linenumber").cast("double")).alias("line"))
    p = profiling.describe(d)
    return p.select("column", "count", "missing", R("mean"), R("std", 6), "min", "max", R("q25", 6), R("q50", 6), R("q75", 6))


@query(
    "describe_text",
    "AGG12",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", (SELECT {c} FROM cards WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
        (SELECT count(*) FROM cards WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq FROM cards"""
        for c in ["card_name", "issuer", "network", "currency", "welcome_bonus"]
    ),
    "cards",
)
def describe_text(t):
    return profiling.describe_text(t("cards"), ["card_name", "issuer", "network", "currency", "welcome_bonus"])


@query(
    "table_shape",
    "AGG12",
    """SELECT count(*) AS rows, 2 AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates FROM lineitem""",
)
def table_shape(t):
    return profiling.shape(t("lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "correlations",
    "AGG13",
    " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]),
)
def correlations(t):
    return drift.correlation_matrix(t("lineitem"), NUMS).select("x", "y", R("r"))


@query(
    "amount_histogram",
    "AGG14",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
   SELECT b::INT AS bin, round(lo + b * w, 6) AS bin_start, count(*) AS n FROM (SELECT lo, w, least(floor((l_extendedprice - lo) / w), 29) AS b FROM lineitem CROSS JOIN e) GROUP BY b, lo, w""",
)
def amount_histogram(t):
    return profiling.histogram(t("lineitem"), "l_extendedprice", 30).select("bin", R("bin_start", 6), "n")


@query(
    "category_and_day_totals",
    "AGG15 AGG16",
    """SELECT 'category' AS kind, category AS item, round(sum(amount), 4) AS total, count(*) AS n FROM transactions GROUP BY 2
    UNION ALL SELECT 'day', CAST(txn_date AS VARCHAR), round(sum(amount), 4), count(*) FROM transactions GROUP BY 2""",
    "transactions",
)
def category_and_day_totals(t):
    tx = t("transactions")
    c = profiling.by_category(tx, F.col("category"), F.col("amount")).select(F.lit("category").alias("kind"), F.col("category").alias("item"), R("total", 4), "n")
    d = profiling.daily_trend(tx, "txn_date", "amount").select(F.lit("day").alias("kind"), F.col("day").cast("string").alias("item"), F.round("spend", 4).alias("total"), "n")
    return c.unionByName(d)


# ------------------------------------------------------------------------------- drift

KS_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KS_SQL = """WITH r AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_returnflag <> 'R'), c AS (SELECT l_quantity * 1.02 + 0.3 AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_returnflag = 'R'),
  lg AS (SELECT 1 AS ref, * FROM (UNPIVOT r ON COLUMNS(*) INTO NAME "column" VALUE value) UNION ALL SELECT 0, * FROM (UNPIVOT c ON COLUMNS(*) INTO NAME "column" VALUE value)),
  v AS (SELECT "column", value, sum(ref) AS a, sum(1 - ref) AS b FROM lg GROUP BY 1, 2),
  cu AS (SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY "column") AS na, sum(b) OVER (PARTITION BY "column") AS nb FROM v WINDOW w AS (PARTITION BY "column" ORDER BY value)),
  k AS (SELECT "column", max(abs(ca / na - cb / nb)) AS d, max(na) AS na, max(nb) AS nb FROM cu GROUP BY 1),
  z AS (SELECT *, sqrt(na * nb / (na + nb)) * d AS z FROM k),
  p AS (SELECT *, CASE WHEN z < 0.2 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * z * z))), 0), 1) END AS p FROM z)
"""


def _two_sides(t):
    li = t("lineitem")
    ref = li.where("l_returnflag <> 'R'").select(*KS_COLS)
    cur = li.where("l_returnflag = 'R'").select((F.col("l_quantity") * 1.02 + 0.3).alias("l_quantity"), *KS_COLS[1:])
    return ref, cur


@query(
    "ks_drift",
    "STA1 ANM5 JON14",
    KS_SQL + """SELECT p."column", round(d, 9) AS ks_statistic, round(p, 6) AS p_value, na::BIGINT AS ref_count, nb::BIGINT AS cur_count, round(m.mr, 6) AS ref_mean, round(m.sc, 6) AS cur_std FROM p
     JOIN (SELECT "column", avg(value) FILTER (ref = 1) AS mr, stddev_pop(value) FILTER (ref = 0) AS sc FROM lg GROUP BY 1) m ON m."column" = p."column" """,
)
def ks_drift(t):
    ref, cur = _two_sides(t)
    d = drift.ks_test(ref, cur, drift.common_columns(ref, cur))
    return d.select("column", R("ks_statistic", 9), R("p_value", 6), "ref_count", "cur_count", R("ref_mean", 6), R("cur_std", 6))


@query(
    "drift_anomalies",
    "ANM5",
    KS_SQL + "SELECT 'lineitem' AS dataset, 'distribution_drift' AS check_name, \"column\", CASE WHEN p <= 0.001 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, round(d, 9) AS observed, round(p, 6) AS ratio FROM p WHERE p <= 0.05",
)
def drift_anomalies(t):
    ref, cur = _two_sides(t)
    return quality.distribution_drift(ref, cur, "lineitem", KS_COLS).withColumns({"observed": F.round("observed", 9), "ratio": F.round("ratio", 6)})


@query(
    "chi_square_drift",
    "STA2",
    """WITH lg AS (SELECT 'status' AS "column", l_linestatus AS v, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS ref FROM lineitem UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END FROM lineitem),
    c AS (SELECT "column", v, sum(ref) AS r, sum(1 - ref) AS c FROM lg GROUP BY 1, 2), t AS (SELECT "column", sum(r) AS nr, sum(c) AS nc FROM c GROUP BY 1)
    SELECT c."column", round(sum(pow(r - (r + c) * nr / (nr + nc), 2) / ((r + c) * nr / (nr + nc)) + pow(c - (r + c) * nc / (nr + nc), 2) / ((r + c) * nc / (nr + nc))), 8) AS chi2, count(*) - 1 AS dof FROM c JOIN t ON t."column" = c."column" GROUP BY 1""",
)
def chi_square_drift(t):
    d = t("lineitem").select("l_partkey", F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"))
    return drift.chi_square(d.where("l_partkey % 2 = 0"), d.where("l_partkey % 2 <> 0"), ["status", "line"]).select("column", R("chi2"), "dof")


@query(
    "dataset_drift",
    "STA2",
    KS_SQL + "SELECT count(*) FILTER (p < 0.05) AS drifted_columns, count(*) AS columns, avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) > 0.2 AS dataset_drift FROM p",
)
def dataset_drift(t):
    ref, cur = _two_sides(t)
    return drift.dataset_drift(ref, cur, KS_COLS, [], share=0.2)[1]


def _ks_side(column: str) -> str:
    """KS statistic and p-value of the limiting series between the two sides of ``d``."""
    return f"""SELECT '{column}' AS "column", 'ks' AS test, stat AS statistic, least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: power(-1, k - 1) * exp(-2 * k * k * lam * lam))))) AS p_value FROM (
      SELECT stat, stat * sqrt(nr * nc / (nr + nc)) AS lam FROM (
        SELECT max(abs(cr / nr - cc / nc)) AS stat, max(nr) AS nr, max(nc) AS nc FROM (
          SELECT v, sum(r) OVER (ORDER BY v)::DOUBLE AS cr, sum(c) OVER (ORDER BY v)::DOUBLE AS cc, sum(r) OVER ()::DOUBLE AS nr, sum(c) OVER ()::DOUBLE AS nc
          FROM (SELECT {column} AS v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM d GROUP BY 1))))"""


def _chi_side(column: str) -> str:
    """Chi-square test; the upper tail is exp(-h) * sum of h^i / i! where the degrees of freedom are even."""
    return f"""SELECT '{column}', 'chi_square', chi2, exp(-chi2 / 2) * list_sum(list_transform(range(0, (dof // 2)::BIGINT), lambda i: power(chi2 / 2, i) / factorial(i::INT))) FROM (
      SELECT sum((r - (r + c) * nr / (nr + nc)) ** 2 / ((r + c) * nr / (nr + nc)) + (c - (r + c) * nc / (nr + nc)) ** 2 / ((r + c) * nc / (nr + nc))) AS chi2, count(*) - 1 AS dof
      FROM (SELECT r, c, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM (SELECT {column} AS v, (count(*) FILTER (ref))::DOUBLE AS r, (count(*) FILTER (NOT ref))::DOUBLE AS c FROM d GROUP BY 1)))"""


@query(
    "drift_per_column",
    "STA2",
    f"""WITH d AS (SELECT l_partkey % 2 = 0 AS ref, l_quantity, l_tax, l_returnflag, l_linenumber::VARCHAR AS line, l_orderkey % 5 + l_partkey % 2 * (l_orderkey % 3) AS shifted FROM lineitem),
    t AS ({" UNION ALL ".join([_ks_side("l_quantity"), _ks_side("l_tax"), _chi_side("l_returnflag"), _chi_side("line"), _chi_side("shifted")])})
    SELECT "column", test, round(statistic, 8) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS drifted FROM t""",
)
def drift_per_column(t):
    """Numeric and categorical tests side by side, on columns with an odd number of values."""
    shifted = F.col("l_orderkey") % 5 + F.col("l_partkey") % 2 * (F.col("l_orderkey") % 3)
    d = t("lineitem").select("l_partkey", "l_quantity", "l_tax", "l_returnflag", F.col("l_linenumber").cast("string").alias("line"), shifted.cast("string").alias("shifted"))
    per, _ = drift.dataset_drift(d.where("l_partkey % 2 = 0"), d.where("l_partkey % 2 <> 0"), ["l_quantity", "l_tax"], ["l_returnflag", "line", "shifted"])
    return per.select("column", "test", R("statistic"), R("p_value", 6), "drifted")


@query(
    "binned_divergence",
    "STA3",
    """WITH s AS (SELECT range AS bin FROM range(0, 22)), b AS (SELECT l_returnflag = 'R' AS cur, CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 21 ELSE floor(l_extendedprice / 5000) + 1 END AS bin FROM lineitem),
    c AS (SELECT bin, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM b GROUP BY 1), j AS (SELECT s.bin, coalesce(r, 0) + 0.5::DOUBLE AS r, coalesce(c, 0) + 0.5::DOUBLE AS c FROM s LEFT JOIN c ON c.bin = s.bin)
    SELECT round(sum((c / sc) * ln((c / sc) / (r / sr))), 9) AS kl FROM j CROSS JOIN (SELECT sum(r) AS sr, sum(c) AS sc FROM j)""",
)
def binned_divergence(t):
    li = t("lineitem")
    return drift.binned_kl(li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'"), "l_extendedprice", 0.0, 100000.0, 20).select(R("kl", 9))


PARAMS = ["max_depth", "learning_rate", "n_estimators", "subsample"]


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(
    "parameter_importance",
    "STA5 WIN11",
    "WITH r AS (SELECT " + ", ".join(f"{_rank(c)} AS r_{c}" for c in [*PARAMS, "metric"]) + " FROM trials) " + " UNION ALL ".join(
        f"SELECT '{c}' AS parameter, round(corr(r_{c}, r_metric), 8) AS correlation, round(abs(corr(r_{c}, r_metric)), 8) AS importance FROM r" for c in PARAMS
    ),
    "trials",
)
def parameter_importance(t):
    return drift.spearman(t("trials"), PARAMS, "metric").select("parameter", R("correlation"), R("importance"))


@query(
    "average_ranks",
    "WIN11",
    "SELECT DISTINCT max_depth AS value, rank() OVER (ORDER BY max_depth) + (count(*) OVER (PARTITION BY max_depth) - 1) / 2 AS avg_rank FROM trials",
    "trials",
)
def average_ranks_query(t):
    return average_ranks(t("trials"), "max_depth", "avg_rank").select(F.col("max_depth").alias("value"), "avg_rank")


PP = [(a, b) for i, a in enumerate(PARAMS) for b in PARAMS[i + 1 :]]


@query(
    "parameter_interactions",
    "STA7",
    "WITH p AS (SELECT *, " + ", ".join(f"{a} * {b} AS x_{i}" for i, (a, b) in enumerate(PP)) + " FROM trials), r AS (SELECT "
    + ", ".join(f"{_rank(c)} AS r_{c}" for c in [*PARAMS, "metric"]) + ", " + ", ".join(f"{_rank(f'x_{i}')} AS rx_{i}" for i in range(len(PP))) + " FROM p) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(greatest(abs(corr(rx_{i}, r_metric)) - greatest(abs(corr(r_{a}, r_metric)), abs(corr(r_{b}, r_metric))), 0), 8) AS interaction, round(abs(corr(rx_{i}, r_metric)), 8) AS joint_correlation FROM r"
        for i, (a, b) in enumerate(PP)
    ),
    "trials",
)
def parameter_interactions(t):
    return drift.interactions(t("trials"), PARAMS, "metric").select("a", "b", R("interaction"), R("joint_correlation"))


@query(
    "safe_parameter_ranges",
    "STA6",
    "WITH b AS (SELECT * FROM trials WHERE metric <= (SELECT quantile_cont(metric, 0.25) FROM trials)), o AS (SELECT * FROM trials ORDER BY metric, trial LIMIT 1) "
    + " UNION ALL ".join(f"SELECT '{c}' AS parameter, round((SELECT quantile_cont({c}, 0.1) FROM b), 8) AS low, round((SELECT quantile_cont({c}, 0.9) FROM b), 8) AS high, (SELECT {c} FROM o) AS best_value" for c in PARAMS),
    "trials",
)
def safe_parameter_ranges(t):
    return drift.safe_ranges(t("trials"), PARAMS, "metric", "trial").select("parameter", R("low"), R("high"), "best_value")


@query(
    "importance_agreement",
    "STA8 JON13",
    """WITH a AS (SELECT p_brand AS feature, avg(p_size) AS v FROM part GROUP BY 1), b AS (SELECT p_brand AS feature, avg(p_retailprice * p_size) AS v FROM part GROUP BY 1),
   j AS (SELECT a.feature, rank() OVER (ORDER BY a.v) AS ra, rank() OVER (ORDER BY b.v) AS rb FROM a JOIN b ON b.feature = a.feature)
   SELECT round((SELECT corr(ra, rb) FROM j), 8) AS spearman, (SELECT count(*) FROM (SELECT feature FROM a ORDER BY v DESC, feature LIMIT 5) x WHERE feature IN (SELECT feature FROM b ORDER BY v DESC, feature LIMIT 5)) / 5 * 100 AS overlap_pct""",
)
def importance_agreement(t):
    a = t("part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance"))
    b = t("part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg(F.col("p_retailprice") * F.col("p_size")).alias("importance"))
    return drift.rank_agreement(a, b).select(R("spearman"), "overlap_pct")


@query(
    "retrain_decision",
    "STA9",
    """WITH r AS (SELECT max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 AS active, max(CASE WHEN o_orderdate >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 24 HOUR THEN 1 ELSE 0 END) = 1 AS recent FROM orders),
   s AS (SELECT avg(value) > 10 AS d, count(*) FILTER (value > 300) AS a FROM events)
   SELECT concat_ws(', ', CASE WHEN d THEN 'drift' END, CASE WHEN a > 0 THEN 'alerts' END) AS reasons, (d OR a > 0) AND NOT active AND NOT recent AS retrain, active AS run_active, recent AS run_recent FROM s CROSS JOIN r""",
)
def retrain_decision(t):
    signals = t("events").agg((F.avg("value") > 10).alias("dataset_drift"), F.count(F.when(F.col("value") > 300, 1)).alias("alerts"))
    runs = t("orders").select(
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at")
    )
    return drift.retrain_decision(signals, runs, F.lit("2001-08-02").cast("timestamp"))
