"""Domain tables derived from the benchmark tables.

Every table is one SELECT whose text both Spark SQL and ANSI engines accept, so the
Spark job and its oracle start from the same rows.  ``SQL`` maps a table name to that
text, ``DEPENDS`` lists which other domain tables it reads, and ``load`` builds the
Spark side.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _case(expr: str, values: list, quote: bool = True) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + str(v).replace("'", "''") + "'" if quote else str(v)

    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE {lit(values[-1])} END"


def _txt(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str, width: int) -> str:
    """Zero-padded number; longer numbers keep all their digits."""
    return f"lpad({_txt(expr)}, CAST(greatest({width}, length({_txt(expr)})) AS INT), '0')"


MCC_SAMPLE = [5812, 5411, 5541, 4511, 5942, 4899, 5912, 7832, 4900, 5999, 7011, 5462, 4121, 6300]
CATEGORY_SAMPLE = [
    "dining", "groceries", "gas", "travel", "online_shopping", "streaming", "drugstore",
    "entertainment", "utilities", "other", "travel", "dining", "transit", "insurance",
]
ISSUER_SAMPLE = ["amex", "Chase_Bank", " capital  one ", "boa", "Wells_Fargo", "US BANK", "discover", None]
BONUS_SAMPLE = [
    "60,000 points after $4,000 spend in 3 months",
    "$750 bonus",
    "60000 miles",
    "Earn 20,000 points spending $500 within 6 weeks",
    "Up to $200 back after $1,000 in 90 days",
    None,
    "no bonus",
]
REDEMPTION_SAMPLE = ["cash_back", "travel_transfer", "statement_credit", "gift_cards", "merchandise", "travel_portal"]
ARCHETYPE_SAMPLE = [
    "young_professional", "suburban_family", "frequent_traveler", "budget_conscious",
    "high_roller", "minimal_user", "category_specialist", "mystery_shopper",
]
CARD_SAMPLE = [
    "citi_double_cash", "amex_gold", "chase_sapphire_preferred", "blue_cash_preferred",
    "capital_one_savor", "wells_fargo_autograph", "closed_card",
]

SQL: dict[str, str] = {}

# One row per line item; amounts end at a whole cent by construction.
SQL["transactions"] = f"""
SELECT 'txn_' || {_pad('l_orderkey', 9)} || {_pad('l_partkey', 7)} || {_pad('l_suppkey', 5)} || {_txt('l_linenumber')} AS transaction_id,
       'user_' || {_pad('o_custkey', 6)} AS user_id,
       CAST(o_orderdate AS DATE) AS txn_date,
       {_case("l_partkey % 14", CATEGORY_SAMPLE)} AS category,
       'Supplier ' || {_txt('l_suppkey')} AS merchant,
       CAST({_case("l_partkey % 14", MCC_SAMPLE, False)} AS INT) AS mcc_code,
       floor(l_extendedprice * (1 - l_discount)) / 100 AS amount,
       'card_' || {_txt('(l_suppkey + o_orderkey) % 5')} AS card_used,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_foreign,
       CASE WHEN floor(l_extendedprice * (1 - l_discount)) / 100 > 900 THEN 1 ELSE 0 END AS suspicious,
       l_extendedprice AS tie_break
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# The same rows before cleaning: text dates, gaps, odd codes, negative amounts.
SQL["raw_transactions"] = f"""
SELECT 'txn_' || {_pad('l_orderkey', 9)} || {_pad('l_partkey', 7)} || {_pad('l_suppkey', 5)} || {_txt('l_linenumber')} AS transaction_id,
       'user_' || {_pad('o_custkey', 6)} AS user_id,
       CASE WHEN l_partkey % 31 = 0 THEN 'not-a-date' WHEN l_partkey % 37 = 0 THEN '2031-01-01'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
       CASE l_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  DINING ' ELSE
            {_case("l_partkey % 14", CATEGORY_SAMPLE)} END AS category,
       'Supplier ' || {_txt('l_suppkey')} AS merchant,
       CAST(CASE WHEN l_partkey % 19 = 0 THEN 1234 ELSE {_case("l_partkey % 14", MCC_SAMPLE, False)} END AS INT) AS mcc_code,
       CASE WHEN l_partkey % 23 = 0 THEN -l_extendedprice WHEN l_suppkey % 29 = 0 THEN NULL
            WHEN l_partkey % 41 = 0 THEN floor(l_extendedprice / 1000) * 100
            ELSE floor(l_extendedprice * (1 - l_discount)) / 10 END AS amount,
       'card_' || {_txt('l_suppkey % 5')} AS card_used,
       l_extendedprice AS tie_break
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SQL["users"] = f"""
SELECT 'user_' || {_pad('c_custkey', 6)} AS user_id,
       {_case("c_custkey % 8", ARCHETYPE_SAMPLE)} AS archetype,
       c_acctbal AS monthly_budget,
       CASE c_custkey % 4 WHEN 0 THEN '[''card_1'', ''card_2'']' WHEN 1 THEN '[''card_3'']'
            WHEN 2 THEN '[]' ELSE 'card_1, card_4,  card_5' END AS cards,
       {_case("c_custkey % 6", REDEMPTION_SAMPLE)} AS redemption_preference,
       {_case("c_custkey % 5", ["18-25", "26-35", "36-50", "51-65", "65+"])} AS age_group,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_case("n_regionkey % 3", ["urban", "suburban", "rural"])} END AS location_type,
       c_custkey AS ord
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# Profiles as delivered: some users come twice and some budgets are missing.
SQL["raw_users"] = f"""
SELECT user_id, archetype, CASE WHEN ord % 13 = 0 THEN NULL ELSE CAST(monthly_budget AS STRING) END AS monthly_budget,
       cards, redemption_preference, age_group, location_type, ord * 2 AS ord
FROM users
UNION ALL
SELECT user_id, 'late_copy' AS archetype, '1.0' AS monthly_budget,
       cards, redemption_preference, age_group, location_type, ord * 2 + 1 AS ord
FROM users WHERE ord % 9 = 0
"""

SQL["cards"] = f"""
SELECT 'card_' || {_pad('p_partkey', 7)} AS card_id,
       CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || '®   Credit Card ' WHEN 1 THEN 'AMEX ' || p_name || '™'
            WHEN 2 THEN upper(p_name) || ' chili''s  card' WHEN 3 THEN NULL WHEN 4 THEN 'usb aaa ' || p_name ELSE p_name END AS card_name,
       {_case("p_partkey % 8", ISSUER_SAMPLE)} AS issuer,
       {_case("p_partkey % 3", ["visa", "mastercard", None])} AS network,
       CASE WHEN p_partkey % 43 = 0 THEN 'n/a' WHEN p_partkey % 47 = 0 THEN '-50' ELSE CAST(p_size * 22 AS STRING) END AS annual_fee,
       {_case("p_partkey % 7", ["CASHBACK", "POINTS", "MILES", "DELTA", "points", None, "HYATT"])} AS currency,
       CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '{{"universal_base_rate":' || CAST(p_size % 5 + 1 AS STRING) || '}}'
            WHEN 2 THEN '{{"rates":[{{"rate":' || CAST(p_size % 4 + 1 AS STRING) || '}},{{"value":' || CAST(p_size % 7 AS STRING) || '}}]}}'
            WHEN 3 THEN '[' || CAST(p_size % 3 AS STRING) || ',' || CAST(p_size % 6 AS STRING) || ']'
            ELSE '{{"base":"' || CAST(p_size % 5 AS STRING) || '.5","flat":9}}' END AS reward_rates,
       CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]'
            ELSE '[{{"spend":' || CAST(p_size * 100 AS STRING) || ',"amount":[{{"amount":' || CAST(p_size * 1000 AS STRING)
                 || '}}],"days":' || CAST(30 + p_size % 4 * 30 AS STRING) || '}},{{"spend":' || CAST(p_size * 50 AS STRING)
                 || ',"amount":[{{"amount":' || CAST(p_size * 900 AS STRING) || '}}],"days":180}}]' END AS offers,
       CASE p_partkey % 3 WHEN 0 THEN '[]'
            ELSE '[{{"description":"a","value":' || CAST(p_size AS STRING) || ',"weight":1}},{{"description":"b","value":null,"weight":1}},{{"description":"c","value":12.5,"weight":0.5}}]' END AS credits,
       {_case("p_partkey % 7", BONUS_SAMPLE)} AS welcome_bonus,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 7 = 0 END AS discontinued,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 4 = 0 END AS is_annual_fee_waived,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS is_business,
       p_partkey AS ord
FROM part
"""

# Card feeds of three sources with overlaps, for merge and catalogue work.
SQL["card_feed"] = """
SELECT {source} AS source, p_partkey AS ord,
       CASE p_partkey % 12 WHEN 0 THEN 'Best for: ' || p_name WHEN 1 THEN '' WHEN 2 THEN 'Gold Card'
            WHEN 3 THEN 'Our pick for: ' || p_name WHEN 4 THEN 'Capital One  Savor' ELSE p_name || ' ' || CAST(p_size % 9 AS STRING) END AS name,
       CASE p_partkey % 6 WHEN 0 THEN 'AMERICAN_EXPRESS' WHEN 1 THEN 'Capital One' WHEN 2 THEN 'American Express' WHEN 3 THEN NULL ELSE p_brand END AS issuer,
       CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '1.5%' WHEN 2 THEN '2x' WHEN 3 THEN '25' WHEN 4 THEN 'none' ELSE CAST(p_size % 6 AS STRING) END AS base_reward_rate,
       CAST(p_size * 15 - 60 AS DOUBLE) AS annual_fee
FROM part
"""
_feed = SQL.pop("card_feed").strip()
SQL["card_feed"] = "\nUNION ALL\n".join(
    _feed.format(source=f"'{s}'") + f" WHERE p_partkey % 3 {op}"
    for s, op in [("creditcardbonuses_api", "<> 0"), ("issuers", "<> 1"), ("nerdwallet", "<> 2")]
)
def _per_slot(template: str, slots: int) -> str:
    """The same SELECT once per slot number, in place of a join with a number list."""
    return "\nUNION ALL\n".join(template.strip().replace("@k", str(k)) for k in range(1, slots + 1))


SQL["user_cards"] = _per_slot(
    f"""
SELECT 'user_' || {_pad('c_custkey', 6)} AS user_id, CAST(@k AS INT) AS saved_order,
       {_case("(c_custkey * 3 + @k * 5) % 7", CARD_SAMPLE)} AS card_id
FROM customer WHERE c_custkey % 4 >= @k
""",
    3,
)

SQL["user_personas"] = _per_slot(
    f"""
SELECT 'user_' || {_pad('c_custkey', 6)} AS user_id,
       CASE @k WHEN 1 THEN CASE c_custkey % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'traveler' ELSE 'gamer' END
                ELSE CASE c_custkey % 2 WHEN 0 THEN 'family' ELSE 'cashback-focused' END END AS persona
FROM customer WHERE c_custkey % 3 >= @k
""",
    2,
)

# Monthly spend per user and category, the shape of a scoring request.
SQL["spend_profile"] = _per_slot(
    f"""
SELECT 'user_' || {_pad('c_custkey', 6)} AS user_id,
       {_case("(c_custkey + @k * 2) % 7", [" Dining", "GROCERIES", "travel", "gas", "pets", "streaming", "drugstores"])} AS raw_category,
       floor(c_acctbal * @k / 7) / 2 AS raw_amount
FROM customer
""",
    4,
)

SQL["requests"] = f"""
SELECT event_id AS request_id, ts AS request_ts, 'user_' || {_pad('user_id', 6)} AS user_id,
       CAST(ts AS DATE) AS day,
       CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN NULL ELSE 'success' END AS request_status,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS recommendation_flow,
       CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE value END AS total_ms,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE floor(value * 10) / 100 END AS normalize_ms,
       floor(value * 20) / 100 AS deterministic_ms,
       floor(value * 30) / 100 AS personalization_ms,
       floor(value * 5) / 100 AS rank_ms,
       CASE WHEN event_id % 2 = 0 THEN floor(value * 35) / 100 ELSE 0.0 END AS llm_explanation_ms,
       CASE WHEN event_id % 2 = 0 THEN floor(value * 7) / 10 ELSE NULL END AS explanation_latency_ms,
       CASE WHEN event_id % 13 = 0 THEN 'none' WHEN event_id % 17 = 0 THEN '' ELSE 'card_' || {_txt('user_id % 12')} END AS top_card,
       CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS is_personalized,
       CASE WHEN event_id % 2 = 0 THEN event_id % 4 ELSE NULL END AS llm_calls,
       CASE WHEN event_id % 2 = 0 THEN event_id % 3 ELSE NULL END AS llm_successes,
       CASE WHEN event_id % 2 = 0 THEN event_id % 4 - event_id % 3 ELSE NULL END AS llm_fallbacks,
       CASE WHEN event_id % 2 = 0 THEN (event_id * 7) % 900 ELSE NULL END AS llm_tokens,
       CASE WHEN event_id % 2 = 0 THEN 'model-' || {_txt('event_id % 6')} ELSE NULL END AS llm_model,
       CASE WHEN event_id % 2 = 0 THEN 'v' || {_txt('event_id % 4')} ELSE NULL END AS llm_prompt_version,
       'm' || {_txt('event_id % 3')} AS model_version,
       floor(value * 3) / 4 AS blended_score
FROM events
"""

SQL["ledger"] = f"""
SELECT 'led_' || {_pad('l_orderkey', 9)} || {_pad('l_partkey', 7)} || {_pad('l_suppkey', 5)} || {_txt('l_linenumber')} AS id,
       'user_' || {_pad('o_custkey', 6)} AS user_id,
       'Supplier ' || {_txt('l_suppkey')} AS merchant,
       floor(l_extendedprice * (1 - l_discount)) / 100 AS amount,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE {_case("l_partkey % 14", CATEGORY_SAMPLE)} END AS category,
       {_case("l_suppkey % 8", CARD_SAMPLE + [None])} AS chosen_card_id,
       CASE WHEN l_suppkey % 8 = 7 THEN NULL WHEN l_suppkey % 8 = 6 THEN NULL ELSE 'Card no ' || {_txt('l_suppkey % 8')} END AS chosen_card_name,
       floor(l_extendedprice * l_tax) / 100 AS reward_earned,
       floor(l_extendedprice * l_discount) / 100 AS estimated_savings,
       {_case("l_linenumber % 3", ["portfolio", "transaction", "quick_transaction"])} AS source_flow,
       o_orderdate AS ts, l_extendedprice AS tie_break
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SQL["task_timings"] = """
SELECT event_type AS task, CAST(ts AS DATE) AS run, user_id % 4 AS part_no, event_id, ts AS started_at,
       floor(value * 10) / 10 AS duration_sec
FROM events
"""

SQL["trials"] = """
SELECT o_orderkey AS trial, floor(o_totalprice / 100) / 10 AS metric,
       CAST(o_custkey % 12 AS DOUBLE) AS max_depth,
       CAST(o_orderkey % 97 AS DOUBLE) / 100 AS learning_rate,
       CAST((o_orderkey * 7 + o_custkey) % 50 AS DOUBLE) AS n_estimators,
       CAST(floor(o_totalprice / 3000) AS DOUBLE) AS subsample
FROM orders
"""

SQL["predictions"] = """
SELECT d.doc_id AS item_id, d.lang AS segment, d.source AS source, l.quality AS y_true,
       CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS y_pred,
       CAST(d.n_chars AS DOUBLE) / 20000 AS score,
       CAST(d.n_chars AS DOUBLE) / 20000 + (l.quality * 2 - 1) * 0.05 AS target,
       l.toxic AS toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

SQL["explanations"] = """
SELECT doc_id, lang AS segment, text FROM documents
"""

SQL["recommendations"] = """
SELECT l_orderkey AS order_id, o_orderpriority AS segment, p_brand AS issuer,
       CASE p_size % 6 WHEN 0 THEN 'Premium' WHEN 1 THEN 'RESERVE' WHEN 2 THEN NULL ELSE 'standard' END AS card_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

_TABLE_NAMES = list(SQL)
_BASE_REF = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(BASE) + r")\b(\s+[dl]\b)?")


def _reads(text: str, name: str) -> bool:
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
    return name in words


@lru_cache(maxsize=None)
def depends(name: str) -> tuple[str, ...]:
    """Domain tables the SELECT of ``name`` reads."""
    clause = SQL[name].split("FROM", 1)[1]
    return tuple(n for n in _TABLE_NAMES if n != name and _reads(clause, n) and n not in BASE)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table or a domain table as a lazy DataFrame."""
    folder = sf_dir.rstrip("/")
    if name in BASE:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def source(m: re.Match) -> str:
        alias = m.group(3) or f" AS {m.group(2)}"
        return f"{m.group(1)} parquet.`{folder}/{m.group(2)}.parquet`{alias}"

    text = with_tables(f"SELECT * FROM {name}", name)
    return spark.sql(_BASE_REF.sub(source, text))


def with_tables(body: str, *names: str) -> str:
    """Oracle text: the named domain tables as CTEs in front of ``body``."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in depends(n):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
