"""Text, cleaning and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline import dims
from perkline.functions import nested, text
from perkline.operators import catalog, cleaning, ordered
from perkline.operators import scoring as sc
from perkline.plans.registry import query
from perkline.plans.scoring_queries import CARD_CTES, _values

AS_OF = "2001-06-01"


def name_sql(c: str) -> str:
    s = f"regexp_replace({c}, '[®™℠©]', '', 'g')"
    s = f"regexp_replace({s}, '\\s*credit\\s*card\\s*$', '', 'i')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    s = f"array_to_string(list_transform(regexp_extract_all({s}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: upper(x[1]) || lower(x[2:])), '')"
    for w, r in dims.ACRONYMS.items():
        s = f"replace({s}, '{w}', '{r}')"
    return f"coalesce({s}, '')"


def issuer_sql(c: str) -> str:
    s = f"regexp_replace(trim(replace(upper({c}), '_', ' ')), '\\s+', ' ', 'g')"
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.ISSUER_ALIASES.items())
    return f"coalesce(CASE {s} {arms} END, CASE replace({s}, ' ', '') {arms} END, {s}, 'UNKNOWN')"


CARD_STD = f"""std AS (SELECT *, {name_sql('card_name')} AS cname, {issuer_sql('issuer')} AS ciss FROM cards),
 keyed AS (SELECT *, regexp_replace(lower(cname), '[^a-z0-9]', '', 'g') AS nkey FROM std),
 dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nkey, ciss ORDER BY ord) AS k FROM keyed) WHERE k = 1)"""


@query(
    "card_names_and_issuers",
    "STR1 STR2 STR4 CLN1 CLN2 UDF5",
    f"WITH {CARD_STD} SELECT card_id, cname AS card_name, card_name AS card_name_original, ciss AS issuer, nkey AS dedup_key FROM keyed",
    "cards",
)
def card_names_and_issuers(t):
    d = cleaning.standardize_cards(t("cards"))
    return d.select("card_id", "card_name", "card_name_original", "issuer", text.dedup_key(F.col("card_name")).alias("dedup_key"))


def _ext(p: str, g: int = 1, c: str = "lower(welcome_bonus)") -> str:
    return f"nullif(regexp_extract({c}, '{p}', {g}), '')"


def _num(s: str) -> str:
    return f"try_cast(replace({s}, ',', '') AS BIGINT)"


_CASH0 = _num(_ext(r"^\s*\$\s*([\d,]+)"))
_UNITP = r"([\d,]+)\s*(points?|miles?|dollars?)"
_CNT = _num(_ext(_UNITP))
_CASH1 = _num(_ext(r"\$\s*([\d,]+)"))


@query(
    "welcome_bonus_text",
    "STR3 CLN6",
    f"""SELECT card_id, coalesce({_CASH0}, {_CNT}, {_CASH1}) AS amount,
   CASE WHEN {_CASH0} IS NOT NULL THEN 'dollars' WHEN {_CNT} IS NOT NULL THEN CASE WHEN contains({_ext(_UNITP, 2)}, 'mile') THEN 'miles' WHEN contains({_ext(_UNITP, 2)}, 'dollar') THEN 'dollars' ELSE 'points' END
        WHEN {_CASH1} IS NOT NULL THEN 'dollars' ELSE 'points' END AS unit,
   {_num(_ext('(?:after|spend|spending)' + chr(92) + 's*' + chr(92) + '$?' + chr(92) + 's*([' + chr(92) + 'd,]+)'))} AS spend_requirement,
   try_cast({_ext('([0-9]+)' + chr(92) + 's*(month|day|week)')} AS BIGINT) * CASE {_ext('([0-9]+)' + chr(92) + 's*(month|day|week)', 2)} WHEN 'month' THEN 30 WHEN 'week' THEN 7 ELSE 1 END AS time_days,
   welcome_bonus AS raw_text FROM cards""",
    "cards",
)
def welcome_bonus_text(t):
    return t("cards").select("card_id", text.parse_welcome_bonus(F.col("welcome_bonus")).alias("b")).select("card_id", "b.*")


@query(
    "cards_cleaned",
    "CLN3 CLN4 CLN5 CLN7",
    f"""WITH {CARD_STD} SELECT card_id, cname AS card_name, ciss AS issuer, try_cast(annual_fee AS DOUBLE) AS annual_fee,
   coalesce(reward_rates, '{{"universal_base_rate":1.0}}') AS reward_rates, CASE WHEN coalesce(discontinued, false) THEN 0 ELSE 1 END AS is_active
   FROM dd WHERE try_cast(annual_fee AS DOUBLE) >= 0 AND try_cast(annual_fee AS DOUBLE) < 1000""",
    "cards",
)
def cards_cleaned(t):
    d = cleaning.clean_cards(t("cards"), F.col("ord"), by_id=False)
    return d.select("card_id", "card_name", "issuer", "annual_fee", "reward_rates", "is_active")


TXN_OK = f"NOT coalesce(amount < 0, false) AND coalesce(try_cast(date_text AS TIMESTAMP) <= TIMESTAMP '{AS_OF}', false)"
MCCS = ", ".join(str(m) for m in dims.VALID_MCC)


@query(
    "transactions_cleaned",
    "CLN8 CLN9 CLN10 CLN11 CLN12 CLN13",
    f"""WITH k AS (SELECT *, try_cast(date_text AS DATE) AS d FROM raw_transactions WHERE {TXN_OK}),
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, amount, merchant ORDER BY transaction_id, tie_break) AS rn FROM k)
  SELECT trim(lower(coalesce(nullif(category, ''), 'unknown'))) AS category, coalesce(mcc_code IN ({MCCS}), false) AS mcc_valid,
    CASE WHEN d < DATE '{AS_OF}' - INTERVAL 3650 DAY THEN 1 ELSE 0 END AS is_old_transaction,
    CASE WHEN amount > 10000 THEN 1 ELSE 0 END AS suspicious, CASE WHEN amount % 100 = 0 THEN 1 ELSE 0 END AS is_round_amount,
    CASE WHEN rn > 1 THEN 1 ELSE 0 END AS is_potential_duplicate, count(*) AS n, round(sum(amount), 4) AS amount FROM f GROUP BY 1, 2, 3, 4, 5, 6""",
    "raw_transactions",
)
def transactions_cleaned(t):
    d = cleaning.clean_transactions(t("raw_transactions"), AS_OF, order=("transaction_id", "tie_break"))
    keys = ["category", "mcc_valid", "is_old_transaction", "suspicious", "is_round_amount", "is_potential_duplicate"]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"))


USERS_DD = "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS k FROM raw_users) WHERE k = 1)"


@query(
    "users_cleaned",
    "CLN14 CLN15 CLN16",
    f"""WITH {USERS_DD}, n AS (SELECT *, try_cast(monthly_budget AS DOUBLE) AS b FROM dd)
   SELECT user_id, archetype, round(coalesce(b, (SELECT median(b) FROM n)), 6) AS monthly_budget FROM n""",
    "raw_users",
)
def users_cleaned(t):
    d = cleaning.clean_users(t("raw_users"), F.col("ord"))
    return d.select("user_id", "archetype", F.round("monthly_budget", 6).alias("monthly_budget"))


@query(
    "cleaning_report",
    "CLN17 CLN16 CLN2 CLN4",
    f"""WITH {CARD_STD.replace(' dd AS', ' cdd AS')}, {USERS_DD},
  x AS (SELECT *, coalesce(amount < 0, false) AS neg, try_cast(date_text AS TIMESTAMP) AS ts FROM raw_transactions),
  y AS (SELECT *, ts IS NULL AS bad, coalesce(ts > TIMESTAMP '{AS_OF}', false) AS fut FROM x),
  z AS (SELECT *, NOT neg AND NOT bad AND NOT fut AS kept FROM y),
  u AS (SELECT try_cast(annual_fee AS DOUBLE) AS fee, * FROM cdd)
  SELECT 'transactions' AS dataset, 'initial_count' AS rule, count(*) AS n FROM z
  UNION ALL SELECT 'transactions', 'negative_amounts', count(*) FILTER (neg) FROM z
  UNION ALL SELECT 'transactions', 'invalid_dates', count(*) FILTER (NOT neg AND bad) FROM z
  UNION ALL SELECT 'transactions', 'future_dates', count(*) FILTER (NOT neg AND fut) FROM z
  UNION ALL SELECT 'transactions', 'missing_categories', count(*) FILTER (kept AND coalesce(category = '', true)) FROM z
  UNION ALL SELECT 'transactions', 'invalid_mcc_codes', count(*) FILTER (kept AND NOT mcc_code IN ({MCCS})) FROM z
  UNION ALL SELECT 'transactions', 'suspicious_high_amounts', count(*) FILTER (kept AND amount > 10000) FROM z
  UNION ALL SELECT 'transactions', 'final_count', count(*) FILTER (kept) FROM z
  UNION ALL SELECT 'cards', 'initial_count', count(*) FROM keyed
  UNION ALL SELECT 'cards', 'unique_issuers', count(DISTINCT ciss) FROM keyed
  UNION ALL SELECT 'cards', 'after_dedup', count(*) FROM u
  UNION ALL SELECT 'cards', 'missing_reward_rates', count(*) FILTER (reward_rates IS NULL) FROM u
  UNION ALL SELECT 'cards', 'empty_reward_rates', count(*) FILTER (reward_rates IS NULL) FROM u
  UNION ALL SELECT 'cards', 'annual_fee_removed', count(*) FILTER (NOT coalesce(fee >= 0 AND fee < 1000, false)) FROM u
  UNION ALL SELECT 'cards', 'discontinued', count(*) FILTER (fee >= 0 AND fee < 1000 AND discontinued) FROM u
  UNION ALL SELECT 'cards', 'final_count', count(*) FILTER (fee >= 0 AND fee < 1000) FROM u
  UNION ALL SELECT 'users', 'initial_count', count(*) FROM raw_users
  UNION ALL SELECT 'users', 'final_count', count(*) FROM dd
  UNION ALL SELECT 'users', 'missing_budgets', count(*) FILTER (try_cast(monthly_budget AS DOUBLE) IS NULL) FROM dd
  UNION ALL SELECT 'users', 'invalid_archetypes', count(*) FILTER (archetype NOT IN ({', '.join(f"'{a}'" for a in dims.ARCHETYPES)})) FROM dd""",
    "cards raw_users raw_transactions",
)
def cleaning_report(t):
    return (
        cleaning.transaction_report(t("raw_transactions"), AS_OF)
        .unionByName(cleaning.card_report(t("cards"), F.col("ord"), by_id=False))
        .unionByName(cleaning.user_report(t("raw_users"), F.col("ord")))
    )


def _mk(c: str) -> str:
    return f"regexp_replace(trim(lower({c})), '\\s+', ' ', 'g')"


JUNK = " OR ".join("starts_with(nkey, '" + p.replace("'", "''") + "')" for p in dims.MERGE_JUNK_PREFIXES)
MERGED = f"""f AS (SELECT *, {_mk("coalesce(name, '')")} AS nkey, {_mk("coalesce(nullif(issuer, ''), source)")} AS ikey,
   CASE source WHEN 'creditcardbonuses_api' THEN 0 WHEN 'issuers' THEN 1 ELSE 2 END AS prio FROM card_feed),
 merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nkey, ikey ORDER BY prio, ord) AS k FROM f
   WHERE nkey <> '' AND NOT ({JUNK}) AND base_reward_rate IS NOT NULL) WHERE k = 1)"""


@query(
    "feeds_merged",
    "SET1 SRC3 CLN18 STR5",
    f"WITH {MERGED} SELECT source, ord, name, issuer, base_reward_rate FROM merged",
    "card_feed",
)
def feeds_merged(t):
    return catalog.merge_feeds(t("card_feed")).select("source", "ord", "name", "issuer", "base_reward_rate")


CJUNK = " OR ".join(f"starts_with(lower(trim(name)), '{p}')" for p in dims.CATALOG_JUNK_PREFIXES)
LOADED = f"""r AS (SELECT *, try_cast(nullif(regexp_extract(regexp_replace(lower(trim(base_reward_rate)), '[%x]', '', 'g'), '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS rate,
    trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM merged WHERE trim(name) <> '' AND NOT ({CJUNK})),
  loaded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY rate DESC, ord) AS kk FROM r WHERE rate BETWEEN 0 AND 10) WHERE kk = 1)"""


@query(
    "catalog_loaded",
    "CLN19 AGG17 STR6 STR7",
    f"WITH {MERGED}, {LOADED} SELECT slug AS card_id, trim(name) AS card_name, coalesce(issuer, '') AS issuer, greatest(annual_fee, 0) AS annual_fee, rate AS base_rate FROM loaded",
    "card_feed",
)
def catalog_loaded(t):
    return catalog.loadable_cards(catalog.merge_feeds(t("card_feed"))).drop("ord")


def _dk(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


@query(
    "catalog_overlay",
    "SET2 JON11 SET4",
    f"""WITH {CARD_CTES}, {MERGED}, {LOADED},
  a AS (SELECT slug AS card_id, trim(name) AS card_name, coalesce(issuer, '') AS issuer, greatest(annual_fee, 0)::DOUBLE AS annual_fee, rate AS base_rate FROM loaded),
  kept AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM cat_cards c WHERE {_dk('a.issuer')} <> '' AND {_dk('a.issuer')} = {_dk('c.issuer')} AND {_dk('a.card_name')} <> ''
      AND ({_dk('a.card_name')} = {_dk('c.card_name')} OR (contains({_dk('c.card_name')}, {_dk('a.card_name')}) AND length({_dk('a.card_name')}) / length({_dk('c.card_name')}) < 0.85)))
    AND card_id NOT IN (SELECT card_id FROM cat_cards))
  SELECT * FROM kept UNION ALL SELECT card_id, card_name, issuer, annual_fee, base_rate FROM cat_cards""",
    "card_feed",
)
def catalog_overlay(t):
    spark = t("part").sparkSession
    curated = sc.card_frame(spark, sc.curated_portfolio()).drop("bonuses")
    out = catalog.overlay(catalog.loadable_cards(catalog.merge_feeds(t("card_feed"))), curated)
    return out.select("card_id", "card_name", "issuer", "annual_fee", "base_rate")


@query(
    "rates_sanitized",
    "CLN21",
    f"""SELECT p_partkey AS card, CASE WHEN p_size % 13 - 1 > 0 AND p_size % 13 - 1 <= 10 THEN (p_size % 13 - 1)::DOUBLE END AS base_rate,
    CASE WHEN p_size - 5 > 0 AND p_size - 5 <= 20 THEN (p_size - 5)::DOUBLE END AS dining, CASE WHEN p_size % 4 > 0 THEN (p_size % 4)::DOUBLE END AS gas, 0 AS unknown_kept FROM part""",
)
def rates_sanitized(t):
    bonuses = F.create_map(
        F.lit("dining"), (F.col("p_size") - 5).cast("double"),
        F.lit("gas"), (F.col("p_size") % 4).cast("double"),
        F.lit("pets"), F.lit(3.0),
    )
    base, kept = catalog.sanitize_rates((F.col("p_size") % 13 - 1).cast("double"), bonuses)
    d = t("part").select(F.col("p_partkey").alias("card"), base.alias("base_rate"), kept.alias("k"))
    return d.select(
        "card", "base_rate", F.try_element_at("k", F.lit("dining")).alias("dining"), F.try_element_at("k", F.lit("gas")).alias("gas"),
        F.map_contains_key("k", "pets").cast("int").alias("unknown_kept"),
    )


@query(
    "offers_normalized",
    "CLN22 ARR2 STR14 ARR5",
    """WITH o AS (SELECT p_partkey AS ord, p_name, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS issuer, p_size * 15 AS fee, p_size % 4 AS ucb,
      CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 100 END AS s1, p_size * 1000 AS a1, 90 AS d1, (p_size % 7) * 200 AS s2, p_size * 800 AS a2, 60 AS d2 FROM part),
   k AS (SELECT *, CASE WHEN s1 > 0 THEN a1 / s1 ELSE 0 END AS r1, CASE WHEN s2 > 0 THEN a2 / s2 ELSE 0 END AS r2 FROM o WHERE issuer IS NOT NULL),
   b AS (SELECT *, (r2, a2, -d2) > (r1, a1, -d1) AS second FROM k),
   c AS (SELECT *, CASE WHEN second THEN a2 ELSE a1 END AS a, CASE WHEN second THEN s2 ELSE s1 END AS s, CASE WHEN second THEN d2 ELSE d1 END AS d FROM b)
   SELECT printf('%d', ord) AS card_id, p_name AS card_name, issuer, fee::DOUBLE AS annual_fee, CASE WHEN ucb > 0 THEN ucb::DOUBLE END AS base_rate,
     concat_ws(' ', CASE WHEN a > 0 THEN format('{:,}', a) || ' bonus' END, CASE WHEN s > 0 THEN 'after $' || format('{:,}', s) || ' spend' END, CASE WHEN d > 0 THEN 'in ' || d || ' days' END) AS welcome_bonus, 2 AS n_offers FROM c""",
)
def offers_normalized(t):
    size = F.col("p_size").cast("double")

    def offer(spend, amount, days):
        return F.struct(spend.alias("spend"), F.array(F.struct(amount.alias("amount"))).alias("amount"), F.lit(days).alias("days"))

    offers = F.array(
        offer(F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(size * 100), size * 1000, 90),
        offer((F.col("p_size") % 7 * 200).cast("double"), size * 800, 60),
    )
    raw = t("part").select(
        F.col("p_partkey").cast("string").alias("cardId"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("issuer"),
        (F.col("p_size") * 15).alias("annualFee"),
        (F.col("p_size") % 4).alias("universalCashbackPercent"),
        F.when(F.col("p_partkey") % 2 == 0, offers).alias("offers"),
        offers.alias("historicalOffers"),
    ).withColumn("offers", F.coalesce("offers", "historicalOffers"))
    n = cleaning.normalize_offers(raw)
    return n.select(
        "card_id", "card_name", "issuer", "annual_fee", F.try_element_at("reward_rates", F.lit("universal_base_rate")).alias("base_rate"),
        "welcome_bonus", F.size("offers").alias("n_offers"),
    )


PHRASE = dims.RATE_PHRASES[0][0].replace("'", "''")


@query(
    "reward_phrases",
    "STR11",
    """WITH s AS (SELECT p_partkey, p_name || ' earns ' || p_size % 9 || '% cash back on ' || p_type || '. Also ' || (p_size % 5 + 1) || 'x points on dining and gas, 2X on ' || p_brand || ', then 7% back on dining and gas.' AS txt,
     p_type, p_size, p_brand FROM part)
   SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[0-9]') THEN 2 ELSE 3 END AS n_phrases, (p_size % 5 + 1)::DOUBLE AS dining_rate, 'points' AS dining_type, (p_size % 9)::DOUBLE AS type_rate FROM s""",
)
def reward_phrases(t):
    txt = F.concat(
        F.col("p_name"), F.lit(" earns "), (F.col("p_size") % 9).cast("string"), F.lit("% cash back on "), F.col("p_type"),
        F.lit(". Also "), (F.col("p_size") % 5 + 1).cast("string"), F.lit("x points on dining and gas, 2X on "), F.col("p_brand"),
        F.lit(", then 7% back on dining and gas."),
    )
    d = t("part").select("p_partkey", F.lower("p_type").alias("ty"), text.reward_rate_phrases(txt).alias("r"))
    one = lambda c: F.try_element_at(F.filter("r", lambda e: e["category"] == c), F.lit(1))
    return d.select(
        "p_partkey", F.size("r").alias("n_phrases"), one(F.lit("dining and gas"))["rate"].alias("dining_rate"),
        one(F.lit("dining and gas"))["type"].alias("dining_type"), one(F.col("ty"))["rate"].alias("type_rate"),
    )


ISSUER_CASE = "CASE " + " ".join(f"WHEN contains(lower(card_name), '{k}') THEN '{v}'" for k, v in text.ISSUER_FRAGMENTS) + " END"


@query(
    "small_text_rules",
    "STR6 STR7 STR8 STR9 STR12 STR17 TXT5",
    f"""SELECT card_id, {ISSUER_CASE} AS issuer_guess,
   coalesce(nullif(trim(regexp_replace(lower(card_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown_card') AS slug,
   try_cast(trim(regexp_replace('$' || annual_fee || ',0', '[$,]', '', 'g')) AS DOUBLE) AS fee_money,
   try_cast(regexp_replace(annual_fee || ' USD', '[^0-9.\\-]', '', 'g') AS DOUBLE) AS fee_like,
   substr(sha256(card_id), 1, 12) AS anon, substr(sha256(coalesce(welcome_bonus, '')), 1, 16) AS fingerprint FROM cards""",
    "cards",
)
def small_text_rules(t):
    return t("cards").select(
        "card_id",
        text.issuer_from_name(F.col("card_name")).alias("issuer_guess"),
        text.slug(F.col("card_name")).alias("slug"),
        text.money(F.concat(F.lit("$"), F.col("annual_fee"), F.lit(",0"))).alias("fee_money"),
        text.numeric_like(F.concat(F.col("annual_fee"), F.lit(" USD"))).alias("fee_like"),
        text.anonymous_id(F.col("card_id")).alias("anon"),
        text.prompt_fingerprint(F.coalesce("welcome_bonus", F.lit(""))).alias("fingerprint"),
    )


@query(
    "map_and_array_rules",
    "ARR4 ARR6 MAP1 MAP2 MAP3 ARR5",
    """WITH l AS (SELECT user_id, list_filter(list_transform(string_split(regexp_replace(cards, '[\\[\\]''"]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS cl, monthly_budget, age_group, redemption_preference FROM users)
   SELECT user_id, array_to_string(cl, '|') AS card_list, len(cl)::INT AS num_cards, CASE WHEN list_contains(cl, 'card_1') THEN 1 ELSE 0 END AS pref_card_1,
     CASE age_group WHEN '18-25' THEN 1 WHEN '26-35' THEN 2 WHEN '36-50' THEN 3 WHEN '51-65' THEN 4 WHEN '65+' THEN 5 ELSE 0 END AS age_ordinal,
     CASE redemption_preference WHEN 'cash_back' THEN 0.01 WHEN 'statement_credit' THEN 0.01 WHEN 'travel_portal' THEN 0.015 WHEN 'travel_transfer' THEN 0.02 WHEN 'gift_cards' THEN 0.009 WHEN 'merchandise' THEN 0.008 ELSE 0.01 END::DOUBLE AS point_value,
     monthly_budget AS spend_dining, 0.0::DOUBLE AS spend_travel, CASE WHEN monthly_budget >= 100 THEN 'dining' ELSE 'gas' END AS dominant FROM l""",
    "users",
)
def map_and_array_rules(t):
    d = t("users").withColumn("cl", nested.card_list(F.col("cards")))
    m = nested.lower_keys(F.create_map(F.lit("DINING"), F.col("monthly_budget"), F.lit("gas"), F.lit(100.0)))
    flat = nested.columns_from_map(m, ["dining", "travel"], "spend_")
    return d.select(
        "user_id",
        F.concat_ws("|", "cl").alias("card_list"),
        F.size("cl").alias("num_cards"),
        nested.flags_from_array(F.col("cl"), ["card_1"], "pref_")["pref_card_1"].alias("pref_card_1"),
        nested.lookup(F.col("age_group"), dims.AGE_ORDINAL, 0).alias("age_ordinal"),
        nested.lookup(F.col("redemption_preference"), dims.POINT_VALUE, 0.01).alias("point_value"),
        flat["spend_dining"].alias("spend_dining"),
        flat["spend_travel"].alias("spend_travel"),
        nested.dominant_key(m).alias("dominant"),
    )


@query(
    "explanation_measures",
    "TXT1 TXT2",
    r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, regexp_extract_all(text, '([A-Za-z0-9'']+)') AS v FROM documents),
   m AS (SELECT doc_id, length(text) AS len, len(w) AS nw, greatest(len(w), 1) AS n, greatest(len(regexp_extract_all(text, '[.!?]')), 1) AS s,
      coalesce(list_sum(list_transform(w, lambda x: greatest(length(regexp_replace(lower(x), '[^aeiou]', '', 'g')), 1))), 0) AS syl,
      greatest(len(v), 1) AS n2, greatest(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')), 1) AS s2,
      greatest(coalesce(list_sum(list_transform(v, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN lower(x)[-1] = 'e' AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1))), 0), 1) AS syl2 FROM w)
   SELECT doc_id, len::INT AS length, nw::INT AS words, round(0.39 * (n / s) + 11.8 * (syl / n) - 15.59, 6) AS grade,
     round(206.835 - 1.015 * (n2 / s2) - 84.6 * (syl2 / n2), 6) AS ease, round(0.39 * (n2 / s2) + 11.8 * (syl2 / n2) - 15.59, 6) AS grade2,
     206.835 - 1.015 * (n2 / s2) - 84.6 * (syl2 / n2) >= 50 AND 0.39 * (n2 / s2) + 11.8 * (syl2 / n2) - 15.59 <= 10 AS passed FROM m""",
)
def explanation_measures(t):
    d = t("documents").select("doc_id", text.text_measures(F.col("text")).alias("m"), text.reading_ease(F.col("text"), digits=6).alias("r"))
    return d.select(
        "doc_id", "m.length", "m.words", F.round("m.grade", 6).alias("grade"), F.col("r.ease").alias("ease"),
        F.col("r.grade").alias("grade2"), F.col("r.passed").alias("passed"),
    )


@query(
    "claims_and_quality",
    "TXT3 TXT4 MON9",
    r"""WITH c AS (SELECT p_partkey, 'The ' || p_name || ' earns ' || p_size || 'x and costs $' || p_size * 5 || ' a year' AS s, 'about $' || p_size % 10 || ' back' AS r1, p_size % 20 || 'x at home' AS r2, p_name, p_size, p_partkey % 3 AS pros FROM part),
   v AS (SELECT *, CASE WHEN p_size IN (7, p_size // 2 * 2) THEN 1 ELSE 0 END + CASE WHEN p_size % 20 IN (7, p_size // 2 * 2) THEN 1 ELSE 0 END
        + CASE WHEN p_size * 5 IN (100, 25) THEN 1 ELSE 0 END + CASE WHEN p_size % 10 IN (100, 25) THEN 1 ELSE 0 END AS sup FROM c),
   q AS (SELECT *, length(s) + length(r1) + length(r2) <= 60 AS length_ok, true AS relevance_ok, pros = 2 AS pros_cons_ok, p_size <= 25 AND p_size % 20 <= 25 AS guard_ok FROM v)
   SELECT p_partkey, 4 AS total, sup::INT AS supported, round(sup / 4, 6) AS score, sup / 4 >= 0.95 AS passed, length_ok, relevance_ok, pros_cons_ok, guard_ok,
     round((length_ok::INT + relevance_ok::INT + pros_cons_ok::INT + guard_ok::INT) / 4, 3) AS quality_score FROM q""",
)
def claims_and_quality(t):
    size = F.col("p_size")
    s = F.concat(F.lit("The "), F.col("p_name"), F.lit(" earns "), size.cast("string"), F.lit("x and costs $"), (size * 5).cast("string"), F.lit(" a year"))
    rat = F.array(
        F.concat(F.lit("about $"), (size % 10).cast("string"), F.lit(" back")), F.concat((size % 20).cast("string"), F.lit("x at home"))
    )
    full = F.concat_ws(" ", s, F.concat_ws(" ", rat))
    mult = F.array(F.lit(7.0), (F.floor(size / 2) * 2).cast("double"))
    check = text.claim_check(full, mult, F.array(F.lit(100.0), F.lit(25.0)))
    pros = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("p_partkey") % 3).cast("int"))
    flags = text.quality_flags(s, rat, pros, pros, F.col("p_name"), F.lit(25.0), max_chars=60)
    d = t("part").select("p_partkey", check.alias("c"), flags.alias("f"))
    score = text.quality_score(
        F.create_map(*[x for k in ["length_ok", "relevance_ok", "pros_cons_ok", "hallucination_guard_ok"] for x in (F.lit(k), F.col(f"f.{k}"))])
    )
    return d.select(
        "p_partkey", "c.total", "c.supported", F.round("c.score", 6).alias("score"), "c.passed", "f.length_ok", "f.relevance_ok",
        "f.pros_cons_ok", F.col("f.hallucination_guard_ok").alias("guard_ok"), score.alias("quality_score"),
    )
