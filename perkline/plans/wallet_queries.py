"""Recommendations per user: wallets, card finder, personas, savings, profiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from perkline import dims
from perkline.functions import wording
from perkline.operators import modeling, recommend
from perkline.operators import scoring as sc
from perkline.plans.registry import query
from perkline.plans.scoring_queries import CARD_CTES, CATALOGUE_CTES, SIGNED_AMOUNT, catalogue
from perkline.sources import sinks


def catalog(t):
    return F.broadcast(sc.card_frame(t("users").sparkSession, sc.curated_portfolio()))


SPEND = f"""spend AS (
  SELECT user_id, CASE WHEN lower(trim(raw_category)) IN ({', '.join(f"'{c}'" for c in dims.SPENDING_CATEGORIES)}) THEN lower(trim(raw_category)) ELSE 'other' END AS category,
         sum(raw_amount) AS amount FROM spend_profile WHERE raw_amount > 0 GROUP BY 1, 2)"""
BOOST = (
    "CASE " + " ".join(
        f"WHEN persona = '{p}' AND category = '{c}' THEN {b}" for p, (_, _, cs) in dims.PERSONAS.items() for c, b in cs.items()
    ) + " ELSE 1.0 END::DOUBLE"
)
FEE_MULT = "CASE persona " + " ".join(f"WHEN '{p}' THEN {m}" for p, (_, m, _) in dims.PERSONAS.items()) + " END::DOUBLE"
KNOWN = ", ".join(f"'{p}'" for p in dims.PERSONAS)


@query("spend_normalized", "CLN20", f"WITH {SPEND} SELECT user_id, category, round(amount, 4) AS amount FROM spend", "spend_profile")
def spend_normalized(t):
    return sc.normalize_spend(t("spend_profile")).select("user_id", "category", F.round("amount", 4).alias("amount"))


WALLET = f"""WITH {CARD_CTES}, {SPEND},
totals AS (
  SELECT s.user_id, c.card_id, c.annual_fee, sum(s.amount * (coalesce(b.rate, c.base_rate) / 100)) AS reward
  FROM spend s JOIN user_cards u ON u.user_id = s.user_id JOIN cat_cards c ON c.card_id = u.card_id
  LEFT JOIN cat_bonus b ON b.card_id = c.card_id AND b.category = s.category GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(reward, 8) DESC, annual_fee, card_id) AS rnk FROM totals)
"""


def wallet_totals(t):
    spend = sc.normalize_spend(t("spend_profile"))
    pairs = spend.join(sc.wallet(t("user_cards"), catalog(t)), "user_id")
    totals = sc.totals_per_card(sc.score_card_table(pairs)).withColumn("sort_reward", F.round("reward_amount", 8))
    return spend, sc.rank_cards(totals, ["user_id"], "sort_reward")


@query(
    "wallet_recommendation",
    "JON7 RWD13",
    WALLET + "SELECT user_id, card_id, rnk::INT AS rank, round(reward, 6) AS reward FROM ranked",
    "spend_profile user_cards",
)
def wallet_recommendation(t):
    _, ranked = wallet_totals(t)
    return ranked.select("user_id", "card_id", "rank", F.round("reward_amount", 6).alias("reward"))


PERSONA = f"""dominant AS (SELECT user_id, category, amount, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, category) AS k FROM spend),
factors AS (SELECT d.user_id, avg({BOOST}) AS boost, avg({FEE_MULT}) AS fm, string_agg(persona, ', ' ORDER BY persona) AS names
  FROM dominant d JOIN user_personas p ON p.user_id = d.user_id WHERE k = 1 AND persona IN ({KNOWN}) GROUP BY 1),
adj AS (SELECT r.*, f.boost, f.fm, f.names, CASE WHEN f.boost IS NULL THEN reward ELSE round(reward * boost - (fm - 1) * annual_fee / 12, 4) END AS adjusted
  FROM ranked r LEFT JOIN factors f ON f.user_id = r.user_id),
fin AS (SELECT *, CASE WHEN boost IS NULL THEN rnk ELSE row_number() OVER (PARTITION BY user_id ORDER BY adjusted DESC, rnk) END AS new_rank FROM adj)
"""


def persona_ranked(t):
    spend, ranked = wallet_totals(t)
    dominant = spend.groupBy("user_id").agg(F.min(F.struct((-F.col("amount")).alias("a"), "category")).alias("d"))
    dominant = dominant.select("user_id", F.col("d.category").alias("category"), (-F.col("d.a")).alias("dominant_amount"))
    return sc.apply_personas(ranked.join(dominant, "user_id"), t("user_personas"), ["user_id"])


@query(
    "persona_recommendation",
    "RWD9 MAP3 RWD13",
    WALLET.rstrip() + ", " + PERSONA + "SELECT user_id, card_id, new_rank::INT AS rank, round(adjusted, 4) AS adjusted_reward, round(coalesce(boost, 1), 3) AS category_boost, round(coalesce(fm, 1), 3) AS fee_multiplier FROM fin",
    "spend_profile user_cards user_personas",
)
def persona_recommendation(t):
    return persona_ranked(t).select(
        "user_id", "card_id", "rank", F.round("adjusted_reward", 4).alias("adjusted_reward"),
        F.round("category_boost", 3).alias("category_boost"), F.round("fee_multiplier", 3).alias("fee_multiplier"),
    )


NOTES = "CASE persona " + " ".join(f"WHEN '{p}' THEN '{n}'" for p, (n, _, _) in dims.PERSONAS.items()) + " END"


@query(
    "persona_texts",
    "STR18",
    f"""WITH f AS (SELECT user_id, 'travel' AS category, persona FROM user_personas WHERE persona IN ({KNOWN})),
  g AS (SELECT user_id, avg({BOOST}) AS boost, avg({FEE_MULT}) AS fm, string_agg(persona, ', ' ORDER BY persona) AS names,
        string_agg({NOTES}, '; ' ORDER BY persona) AS listed, string_agg({NOTES}, ' | ' ORDER BY persona) AS bar FROM f GROUP BY 1)
  SELECT u.user_id,
    CASE WHEN names IS NULL THEN 'No active persona — ranked by raw reward value.' ELSE 'Matches ' || names || ' (' || listed || ').'
      || CASE WHEN boost > 1 THEN ' travel rewards boosted ×' || printf('%.2f', boost) || ' for this persona.' ELSE '' END
      || CASE WHEN fm > 1 THEN ' $95 annual fee is penalised under fee-sensitive persona.' WHEN fm < 1 THEN ' $95 annual fee is discounted — persona favours premium benefits.' ELSE '' END END AS reason,
    CASE WHEN names IS NULL THEN '' ELSE 'Active personas: ' || names || '. ' || bar
      || CASE WHEN boost <> 1 THEN ' Category reward boosted ×' || printf('%.2f', boost) || '.' ELSE '' END
      || CASE WHEN fm <> 1 THEN ' Annual fee sensitivity ' || CASE WHEN fm > 1 THEN 'increased' ELSE 'reduced' END || ' (×' || printf('%.2f', fm) || ').' ELSE '' END END AS context
  FROM users u LEFT JOIN g ON g.user_id = u.user_id""",
    "users user_personas",
)
def persona_texts(t):
    d = t("users").select("user_id").join(sc.valid_personas(t("user_personas")), "user_id", "left")
    boost, fee = sc.persona_factors(F.col("personas"), F.lit("travel"))
    d = d.withColumn("b", boost).withColumn("f", fee)
    return d.select(
        "user_id",
        sc.persona_reason(F.col("personas"), F.lit("travel"), F.lit(95.0), F.col("b"), F.col("f")).alias("reason"),
        sc.persona_context(F.col("personas"), F.col("b"), F.col("f")).alias("context"),
    )


@query(
    "card_finder",
    "JON8 RWD13",
    f"""WITH {CARD_CTES}, {SPEND},
  totals AS (SELECT s.user_id, c.card_id, c.annual_fee, sum(s.amount * (coalesce(b.rate, c.base_rate) / 100)) AS reward
    FROM spend s CROSS JOIN cat_cards c LEFT JOIN cat_bonus b ON b.card_id = c.card_id AND b.category = s.category
    WHERE NOT EXISTS (SELECT 1 FROM user_cards u WHERE u.user_id = s.user_id AND u.card_id = c.card_id) GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(reward, 8) DESC, annual_fee, card_id) AS rnk FROM totals)
  SELECT user_id, card_id, rnk::INT AS rank, round(reward, 6) AS reward FROM ranked WHERE rnk <= 3""",
    "spend_profile user_cards",
)
def card_finder(t):
    spend = sc.normalize_spend(t("spend_profile"))
    offered = sc.finder(t("users"), t("user_cards"), sc.curated_portfolio())
    totals = sc.totals_per_card(sc.score_card_table(spend.join(offered, "user_id").join(catalog(t), "card_id")))
    ranked = sc.rank_cards(totals.withColumn("s", F.round("reward_amount", 8)), ["user_id"], "s").where("rank <= 3")
    return ranked.select("user_id", "card_id", "rank", F.round("reward_amount", 6).alias("reward"))


@query(
    "quick_recommendation",
    "RWD14 STR10 JON7",
    f"""WITH {CARD_CTES},
  q AS (SELECT transaction_id, tie_break, user_id, amount, CASE WHEN lower(merchant) LIKE '%supplier 1%' THEN 'dining' ELSE lower(category) END AS used FROM transactions),
  s AS (SELECT q.*, c.card_id, c.annual_fee, CASE WHEN amount = 0 THEN 0 ELSE amount * (coalesce(b.rate, c.base_rate) / 100) END AS reward
    FROM q JOIN user_cards u ON u.user_id = q.user_id JOIN cat_cards c ON c.card_id = u.card_id
    LEFT JOIN cat_bonus b ON b.card_id = c.card_id AND b.category = q.used),
  r AS (SELECT *, row_number() OVER (PARTITION BY transaction_id, tie_break ORDER BY reward DESC, annual_fee, card_id) AS k FROM s)
  SELECT user_id, used AS category_used, card_id AS top_card, count(*) AS n, round(sum(reward), 6) AS estimated_reward FROM r WHERE k = 1 GROUP BY 1, 2, 3""",
    "transactions user_cards",
)
def quick_recommendation(t):
    """Best saved card per purchase: the wallet travels as one short array per user."""
    cards = sc.wallet(t("user_cards"), catalog(t)).groupBy("user_id").agg(
        F.collect_list(F.struct("card_id", "annual_fee", "base_rate", "bonuses")).alias("wallet")
    )
    words = {"dining": ["supplier 1"]}
    q = t("transactions").select("user_id", "amount", "category", "merchant").join(cards, "user_id")
    used = sc.resolve_category(F.col("merchant"), F.col("category"), words, hint_first=False)
    q = q.withColumn("category_used", used)
    top = F.array_min(
        F.transform(
            "wallet",
            lambda c: F.struct(
                (-sc.reward_amount(F.col("amount"), F.coalesce(F.try_element_at(c["bonuses"], F.col("category_used")), c["base_rate"]))).alias("neg"),
                c["annual_fee"].alias("fee"),
                c["card_id"].alias("id"),
            ),
        )
    )
    q = q.withColumn("top", top)
    return q.groupBy("user_id", "category_used", F.col("top.id").alias("top_card")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(-F.col("top.neg")), 6).alias("estimated_reward")
    )


HINTS_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}'"
    for c, ws in {"dining": ["ment", "cafe"], "travel": ["on "], "gas": ["the"]}.items()
) + " END"


@query(
    "merchant_category",
    "STR10",
    f"""WITH h AS (SELECT doc_id, {HINTS_SQL} AS found, lower(nullif(CASE WHEN doc_id % 3 = 0 THEN 'Gas' WHEN doc_id % 3 = 1 THEN '' END, '')) AS hint FROM documents)
  SELECT coalesce(hint, found, 'other') AS hint_first, coalesce(found, hint, 'other') AS keyword_first, count(*) AS n FROM h GROUP BY 1, 2""",
)
def merchant_category(t):
    words = {"dining": ["ment", "cafe"], "travel": ["on "], "gas": ["the"]}
    hint = F.when(F.col("doc_id") % 3 == 0, "Gas").when(F.col("doc_id") % 3 == 1, "")
    return (
        t("documents")
        .groupBy(
            sc.resolve_category(F.col("text"), hint, words).alias("hint_first"),
            sc.resolve_category(F.col("text"), hint, words, hint_first=False).alias("keyword_first"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


_KEYWORDS = [w for words in dims.MERCHANT_WORDS.values() for w in words]
_KEYWORD_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _KEYWORDS) + "]"
_KEYWORD_CASE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(m, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)} THEN '{c}'" for c, words in dims.MERCHANT_WORDS.items()
) + " ELSE 'other' END"


@query(
    "merchant_keywords",
    "STR10",
    f"""WITH m AS (SELECT lower(p_brand || ' ' || upper({_KEYWORD_LIST}[(p_partkey % {len(_KEYWORDS) + 20})::INT + 1]) || ' no ' || p_partkey) AS m FROM part)
  SELECT {_KEYWORD_CASE} AS category, count(*) AS n FROM (SELECT coalesce(m, 'unnamed shop') AS m FROM m) GROUP BY 1""",
)
def merchant_keywords(t):
    """Merchants by every keyword of the table, the first category in its order winning."""
    word = F.get(F.array(*[F.lit(w) for w in _KEYWORDS]), (F.col("p_partkey") % (len(_KEYWORDS) + 20)).cast("int"))
    merchant = F.coalesce(F.concat(F.col("p_brand"), F.lit(" "), F.upper(word), F.lit(" no "), F.col("p_partkey").cast("string")), F.lit("unnamed shop"))
    found = t("part").select(sc.resolve_category(merchant, F.lit(None).cast("string")).alias("category"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "personalized_scores",
    "RWD8",
    WALLET + """, p AS (SELECT user_id, CASE ord % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN 0.02 ELSE 0.015 END::DOUBLE AS pv FROM users)
  SELECT r.user_id, card_id, round(reward, 6) AS raw_reward, round(reward * CASE WHEN pv IS NULL OR isnan(pv) OR pv <= 0 THEN 1.0 ELSE pv END, 6) AS reward,
   CASE WHEN pv IS NULL OR isnan(pv) OR pv <= 0 THEN false ELSE true END AS is_personalized FROM ranked r JOIN p ON p.user_id = r.user_id""",
    "spend_profile user_cards users",
)
def personalized_scores(t):
    _, ranked = wallet_totals(t)
    m = F.col("ord") % 5
    pv = (
        F.when(m == 1, -1.0).when(m == 2, float("nan")).when(m == 3, 0.02).when(m == 4, 0.015)
    )
    preds = t("users").select("user_id", pv.alias("point_value"))
    d = sc.personalize(ranked, preds)
    return d.select(
        "user_id", "card_id", F.round("raw_reward_amount", 6).alias("raw_reward"), F.round("reward_amount", 6).alias("reward"), "is_personalized"
    )


@query(
    "welcome_bonus_eligibility",
    "RWD4",
    """SELECT card_id, count(*) AS n, sum(CASE WHEN saved_order <> 3 AND NOT coalesce(CASE WHEN card_id = 'amex_gold' THEN true END, false)
         AND tenure <= coalesce(win, 90) THEN 1 ELSE 0 END)::BIGINT AS eligible
       FROM (SELECT *, length(card_id) * 9 AS tenure, CASE WHEN saved_order = 2 THEN 180 END AS win FROM user_cards) GROUP BY 1""",
    "user_cards",
)
def welcome_bonus_eligibility(t):
    ok = sc.welcome_bonus_eligible(
        F.col("saved_order") != 3,
        F.when(F.col("card_id") == "amex_gold", True),
        F.length("card_id") * 9,
        F.when(F.col("saved_order") == 2, 180),
    )
    return t("user_cards").groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("eligible"))


@query(
    "savings_calculator",
    "RWD15 RWD16",
    f"""WITH {CARD_CTES}, {SPEND},
  base AS (SELECT user_id, min_by(c.card_id, saved_order) AS baseline_card_id, min_by(c.annual_fee, saved_order) AS fee, min_by(c.base_rate, saved_order) AS rate
    FROM user_cards u JOIN cat_cards c ON c.card_id = u.card_id WHERE c.card_id NOT IN (SELECT card_id FROM cat_bonus) GROUP BY 1),
  x AS (SELECT s.user_id, c.card_id, c.annual_fee, b.baseline_card_id, coalesce(b.fee, 0) AS bfee,
     sum(amount * coalesce(bo.rate, c.base_rate) / 100) AS reward, sum(amount * coalesce(bo.rate, c.base_rate) / 100 - amount * coalesce(b.rate, 1) / 100) AS uplift
    FROM spend s JOIN user_cards u ON u.user_id = s.user_id JOIN cat_cards c ON c.card_id = u.card_id
    LEFT JOIN cat_bonus bo ON bo.card_id = c.card_id AND bo.category = s.category LEFT JOIN base b ON b.user_id = s.user_id GROUP BY 1, 2, 3, 4, 5)
  SELECT user_id, card_id, baseline_card_id, round(reward, 6) AS monthly_reward, round(reward * 12, 5) AS annual_reward, round(uplift, 6) AS monthly_uplift,
     round(uplift * 12 - (annual_fee - bfee), 5) AS net_annual_benefit FROM x""",
    "spend_profile user_cards",
)
def savings_calculator(t):
    cat = catalog(t)
    spend = sc.normalize_spend(t("spend_profile"))
    s = sc.savings(spend, t("user_cards").select("user_id", "card_id"), cat, sc.baseline_cards(t("user_cards"), cat))
    return s.select(
        "user_id", "card_id", "baseline_card_id", F.round("monthly_reward", 6).alias("monthly_reward"),
        F.round("annual_reward", 5).alias("annual_reward"), F.round("monthly_uplift", 6).alias("monthly_uplift"),
        F.round("net_annual_benefit", 5).alias("net_annual_benefit"),
    )


DEFAULT_SQL = "CASE WHEN {b} > 0 THEN {b} ELSE 1000 END"


@query(
    "default_spend_profile",
    "RWD17",
    f"""SELECT user_id, c.category, round(floor(CASE WHEN monthly_budget > 0 THEN monthly_budget ELSE 1000 END * w * 100 / 1000 + 0.5) / 100, 2) AS amount
   FROM users CROSS JOIN (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in dims.DEFAULT_SPEND.items())}) c(category, w)""",
    "users",
)
def default_spend_profile(t):
    d = t("users").select("user_id", F.explode(sc.default_spend_rows(F.col("monthly_budget"))).alias("r"))
    return d.select("user_id", "r.category", "r.amount")


PURCHASES = """ex AS (SELECT user_id, sum(amount) AS e FROM spend GROUP BY 1),
 pur AS (SELECT user_id, category, amount, 'monthly_profile' AS merchant FROM spend
   UNION ALL SELECT user_id, category, amount, merchant FROM transactions WHERE amount > 0
   UNION ALL SELECT u.user_id, 'other', u.monthly_budget - coalesce(e, 0), 'monthly_spend_remainder' FROM users u LEFT JOIN ex ON ex.user_id = u.user_id WHERE u.monthly_budget > coalesce(e, 0)
   UNION ALL SELECT u.user_id, 'other', 1000.0, 'default_spend' FROM users u LEFT JOIN ex ON ex.user_id = u.user_id
     WHERE NOT u.monthly_budget > coalesce(e, 0) AND e IS NULL AND u.user_id NOT IN (SELECT user_id FROM transactions WHERE amount > 0))
"""


def purchases(t):
    spend = sc.normalize_spend(t("spend_profile"))
    profiles = t("users").select("user_id", F.col("monthly_budget").alias("monthly_spend"))
    return spend, profiles, sc.profile_purchases(profiles, spend, t("transactions"))


@query(
    "profile_purchases",
    "RSH6",
    f"WITH {SPEND}, {PURCHASES} SELECT user_id, merchant LIKE 'Supplier%' AS from_history, count(*) AS n, round(sum(amount), 4) AS amount FROM pur GROUP BY 1, 2",
    "spend_profile users transactions",
)
def profile_purchases(t):
    _, _, p = purchases(t)
    return p.groupBy("user_id", F.col("merchant").startswith("Supplier").alias("from_history")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount")
    )


@query(
    "profile_scores",
    "RWD10 RWD11 TOP1 STR15",
    f"""WITH {CARD_CTES}, {SPEND}, {PURCHASES},
  cs AS (SELECT user_id, category, sum(amount) AS amount FROM pur GROUP BY 1, 2),
  det AS (SELECT s.user_id, c.card_id, c.annual_fee, sum(s.amount * (coalesce(b.rate, c.base_rate) / 100)) AS det
     FROM cs s CROSS JOIN cat_cards c LEFT JOIN cat_bonus b ON b.card_id = c.card_id AND b.category = s.category GROUP BY 1, 2, 3),
  tot AS (SELECT user_id, sum(amount) AS tot FROM spend GROUP BY 1),
  af AS (SELECT t.user_id, c.card_id, 1 + coalesce(sum(s.amount / t.tot * greatest(coalesce(b.rate, c.base_rate) - c.base_rate, 0) * 0.75), 0) AS m
     FROM tot t CROSS JOIN cat_cards c LEFT JOIN spend s ON s.user_id = t.user_id LEFT JOIN cat_bonus b ON b.card_id = c.card_id AND b.category = s.category GROUP BY 1, 2),
  bl AS (SELECT d.user_id, d.card_id, d.annual_fee, d.det, CASE WHEN u.redemption_preference IN ('travel_portal', 'travel_transfer', 'cash_back') THEN
       0.6 * d.det + 0.4 * (d.det * 1.5 * CASE WHEN a.m IS NULL THEN 1 ELSE greatest(a.m + CASE WHEN u.redemption_preference LIKE 'travel%' AND tb.rate > c.base_rate THEN 0.15 ELSE 0 END
          + CASE WHEN u.redemption_preference = 'cash_back' AND d.annual_fee <= 0 THEN 0.1 ELSE 0 END, 0.1) END) ELSE d.det END AS score
     FROM det d JOIN users u ON u.user_id = d.user_id JOIN cat_cards c ON c.card_id = d.card_id LEFT JOIN af a ON a.user_id = d.user_id AND a.card_id = d.card_id
     LEFT JOIN cat_bonus tb ON tb.card_id = d.card_id AND tb.category = 'travel'),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 7) DESC, annual_fee, card_id) AS k FROM bl)
  SELECT user_id, card_id, k::INT AS rank, round(score, 10) AS score, round(det, 6) AS deterministic_score FROM r WHERE k <= 3""",
    "spend_profile users transactions",
)
def profile_scores(t):
    """Spend is summed per category first, as scores are linear in the amount, and written once."""
    folder = sinks.work_folder(t.spark, "profiles")
    spend = modeling.written(sc.normalize_spend(t("spend_profile")), f"{folder}/spend")
    profiles = t("users").select("user_id", F.col("monthly_budget").alias("monthly_spend"))
    p = sc.profile_purchases(profiles, spend, t("transactions"))
    cat = catalog(t)
    cards = sc.curated_portfolio()
    by_cat = modeling.written(p.groupBy("user_id", "category").agg(F.sum("amount").alias("amount")), f"{folder}/totals")
    det = sc.totals_per_card(sc.score_portfolio(by_cat, cards, day=None, foreign=None))
    pref = t("users").select(
        "user_id",
        F.col("redemption_preference").startswith("travel").alias("likes_travel"),
        (F.col("redemption_preference") == "cash_back").alias("likes_cashback"),
    )
    aff = sc.affinity(spend, cat, det.select("user_id", "card_id"), pref)
    d = det.join(aff, ["user_id", "card_id"], "left").join(pref, "user_id")
    personalised = F.col("likes_travel") | F.col("likes_cashback")
    d = d.withColumn("score", sc.blend(F.col("reward_amount"), F.lit(1.5), F.coalesce("affinity", F.lit(1.0)), personalised))
    ranked = sc.rank_cards(d.withColumn("s", F.round("score", 7)), ["user_id"], "s").where("rank <= 3")
    return ranked.select(
        "user_id", "card_id", "rank", F.round("score", 10).alias("score"), F.round("reward_amount", 6).alias("deterministic_score")
    )


@query(
    "online_user_features",
    "RWD12",
    f"""WITH {SPEND}, {PURCHASES},
  b AS (SELECT user_id, count(*) AS n, sum(amount) AS ts, avg(amount) AS av, stddev_pop(amount) AS sd, list_sort(list(amount))[count(*)//2 + 1] AS med FROM pur GROUP BY 1),
  m AS (SELECT user_id, count(*) AS nm, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS rep FROM (SELECT user_id, lower(trim(merchant)) AS mm, count(*) AS k FROM pur GROUP BY 1, 2) GROUP BY 1),
  e AS (SELECT s.user_id, count(*) AS nc, sum(-(amount / e) * log2(amount / e)) AS ent FROM spend s JOIN ex ON ex.user_id = s.user_id GROUP BY 1)
  SELECT b.user_id, round(CASE WHEN u.monthly_budget > 0 THEN u.monthly_budget WHEN ts > 0 THEN ts ELSE 1000 END, 4) AS monthly_budget, round(ts, 4) AS total_spending, round(med, 4) AS median_amount,
    round(sd, 5) AS std_amount, round(greatest(coalesce(ent, 0), 0), 5) AS spending_diversity, round(coalesce(ent, 0) / log2(greatest(coalesce(nc, 0), 2)), 5) AS affinity_score,
    nm AS num_unique_merchants, round(rep / greatest(nm, 1), 6) AS repeat_merchant_ratio, round(CASE WHEN av > 0 THEN sd / av ELSE 0 END, 5) AS spending_velocity
  FROM b JOIN users u ON u.user_id = b.user_id LEFT JOIN m ON m.user_id = b.user_id LEFT JOIN e ON e.user_id = b.user_id""",
    "spend_profile users transactions",
)
def online_user_features(t):
    """Spend and purchases are written once; every block of features reads the narrow tables."""
    folder = sinks.work_folder(t.spark, "requests")
    spend = modeling.written(sc.normalize_spend(t("spend_profile")), f"{folder}/spend")
    profiles = t("users").select("user_id", F.col("monthly_budget").alias("monthly_spend"))
    p = modeling.written(sc.profile_purchases(profiles, spend, t("transactions")).select("user_id", "amount", "merchant"), f"{folder}/purchases")
    f = sc.online_user_features(p, spend, profiles)
    return f.select(
        "user_id",
        F.round("monthly_budget", 4).alias("monthly_budget"),
        F.round("total_spending", 4).alias("total_spending"),
        F.round("median_transaction_amount", 4).alias("median_amount"),
        F.round("transaction_amount_std", 5).alias("std_amount"),
        F.round("spending_diversity", 5).alias("spending_diversity"),
        F.round("category_affinity_score", 5).alias("affinity_score"),
        "num_unique_merchants",
        F.round("repeat_merchant_ratio", 6).alias("repeat_merchant_ratio"),
        F.round("spending_velocity", 5).alias("spending_velocity"),
    )


@query(
    "card_explanations",
    "STR15 STR16 RWD13",
    WALLET.rstrip() + ", " + PERSONA.rstrip() + f"""
  , x AS (SELECT fin.user_id, fin.card_id, new_rank, c.card_name, d.category, coalesce(b.rate, c.base_rate) AS rate, round(reward * 12, 2) AS sv, names, boost
     FROM fin JOIN cat_cards c ON c.card_id = fin.card_id JOIN dominant d ON d.user_id = fin.user_id AND d.k = 1
     LEFT JOIN cat_bonus b ON b.card_id = fin.card_id AND b.category = d.category),
  y AS (SELECT *, rtrim(rtrim(printf('%.6f', rate), '0'), '.') || CASE WHEN rate >= 1 THEN 'x' ELSE '%' END AS rt,
       CASE WHEN sv >= 1 THEN '$' || format('{{:,}}', round(sv)::BIGINT) ELSE printf('$%.2f', sv) END AS mt FROM x)
  SELECT user_id, card_id, CASE WHEN new_rank = 1 THEN 'Top pick for your spending profile. ' || card_name || ' earns ' || rt || ' on ' || category || ', projecting ' || mt || '/year in rewards.'
      ELSE card_name || ' earns ' || rt || ' on ' || category || '. Projected annual reward: ' || mt || '.' END
      || CASE WHEN boost > 1 THEN ' Boosted by your ' || names || ' profile.' ELSE '' END AS explanation FROM y""",
    "spend_profile user_cards user_personas",
)
def card_explanations(t):
    d = persona_ranked(t).join(catalog(t).select("card_id", "base_rate", "bonuses"), "card_id")
    rate = F.coalesce(F.try_element_at("bonuses", F.col("category")), F.col("base_rate"))
    text = wording.card_explanation(
        F.col("card_name"), F.col("rank"), rate, F.round(F.col("reward_amount") * 12, 2), F.col("category"),
        F.coalesce("personas", F.array().cast("array<string>")), F.col("category_boost"),
    )
    return d.select("user_id", "card_id", text.alias("explanation"))


@query(
    "wallet_highlights",
    "STR16 STR15",
    f"""WITH {CARD_CTES},
  l AS (SELECT card_id, 0 AS part, -rate AS o, category AS k, rtrim(rtrim(printf('%.6f', rate), '0'), '.') || 'x ' || category AS line FROM cat_bonus
    UNION ALL SELECT card_id, 1, 0, '', rtrim(rtrim(printf('%.6f', base_rate), '0'), '.') || CASE WHEN card_id IN (SELECT card_id FROM cat_bonus) THEN '% on everything else' ELSE '% on everything' END FROM cat_cards WHERE base_rate > 0
    UNION ALL SELECT card_id, 2, 0, '', 'No annual fee' FROM cat_cards WHERE annual_fee = 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY part, o, k) AS i FROM l),
  h AS (SELECT card_id, string_agg(line, ' | ' ORDER BY i) AS highlights FROM n WHERE i <= 4 GROUP BY 1)
  SELECT u.card_id, h.highlights, count(*) AS n_wallets FROM user_cards u JOIN h ON h.card_id = u.card_id GROUP BY 1, 2""",
    "user_cards",
)
def wallet_highlights(t):
    w = sc.wallet(t("user_cards"), catalog(t))
    lines = wording.reward_highlights(F.col("bonuses"), F.col("base_rate"), F.col("annual_fee"))
    return w.groupBy("card_id", F.concat_ws(" | ", lines).alias("highlights")).agg(F.count(F.lit(1)).alias("n_wallets"))


_RATE = "rtrim(rtrim(printf('%.6f', rate), '0'), '.') || CASE WHEN rate >= 1 THEN 'x' ELSE '%' END"
_MONEY = "'$' || round(savings)::INT"


@query(
    "card_arguments",
    "STR15",
    f"""WITH d AS (SELECT p_partkey, (p_size % 6)::DOUBLE / 2 AS rate, (p_size % 4 * 95)::DOUBLE AS fee, (p_size * 10)::DOUBLE AS savings, p_type AS category, p_size % 3 = 0 AS bonus,
     CASE WHEN p_size % 2 = 0 THEN 'gas' END AS missing, p_size % 5 AS n, p_size % 7 < 3 AS persona FROM part)
   SELECT p_partkey,
     CASE WHEN bonus THEN '4x dining — strong for your spending pattern' ELSE 'Flat ' || {_RATE} || ' on all purchases — no category tracking needed' END AS pro1,
     CASE WHEN fee = 0 THEN 'No annual fee keeps your net rewards positive from day one' WHEN savings > fee THEN 'Projected ' || {_MONEY} || '/year in rewards more than offsets the $' || fee::INT || ' annual fee'
       ELSE 'Projected annual reward of ' || {_MONEY} || ' across your spending categories' END AS pro2,
     CASE WHEN fee > 0 THEN '$' || fee::INT || '/year annual fee requires consistent spending to offset' WHEN bonus THEN 'Lower base rate on purchases outside bonus categories'
       ELSE 'No bonus categories — specialized cards may earn more in your top areas' END AS con1,
     CASE WHEN bonus AND missing IS NOT NULL THEN 'No bonus rate for ' || missing || ' — your ' || CASE WHEN n > 1 THEN '#2' ELSE '' END || ' spending category' WHEN bonus THEN 'Rewards value depends on how you redeem points'
       ELSE 'Other cards may offer higher rates in specific spending categories' END AS con2,
     CASE WHEN persona AND bonus THEN 'Student, Traveler spenders focused on ' || category WHEN persona THEN 'Student, Traveler spenders looking for simple flat-rate rewards' WHEN bonus THEN 'Spenders with high ' || category || ' purchases'
       ELSE 'Everyday spenders who prefer simplicity over category optimization' END AS best_for FROM d""",
)
def card_arguments(t):
    """Two arguments for and against a card, and whom it suits."""
    size = F.col("p_size")
    bonus = size % 3 == 0
    lines = F.when(bonus, F.array(F.lit("4x dining"), F.lit("1% on everything else"))).otherwise(F.array(F.lit("1.5% on everything")))
    personas = F.when(size % 7 < 3, F.array(F.lit("student"), F.lit("traveler"))).otherwise(F.array().cast("array<string>"))
    pros, cons = wording.pros_and_cons(
        lines, (size % 6) / 2, (size % 4 * 95).cast("double"), (size * 10).cast("double"), F.col("p_type"), F.when(size % 2 == 0, F.lit("gas")), size % 5
    )
    suits = wording.best_for(personas, bonus, F.col("p_type"))
    return t("part").select("p_partkey", pros[0].alias("pro1"), pros[1].alias("pro2"), cons[0].alias("con1"), cons[1].alias("con2"), suits.alias("best_for"))


# ------------------------------------------------------- the first cards of a whole catalogue

_UP = "floor({x} * 1e{d} + (0.5 + 1e-6)) / 1e{d}"
# Users' spend or the default purchase, their first category, personas and yearly factor.
_ASKED = f"""asked AS (SELECT user_id, category, amount FROM spend
   UNION ALL SELECT user_id, 'other', CASE WHEN monthly_budget > 0 THEN monthly_budget ELSE 100 END FROM users WHERE user_id NOT IN (SELECT user_id FROM spend)),
 main AS (SELECT user_id, min_by(category, (-amount, category)) AS category, max(amount) AS amount FROM asked GROUP BY 1),
 fac AS (SELECT d.user_id, avg({BOOST}) AS boost, avg({FEE_MULT}) AS fm FROM main d JOIN user_personas p ON p.user_id = d.user_id WHERE persona IN ({KNOWN}) GROUP BY 1),
 tot AS (SELECT a.user_id, c.card_id, c.annual_fee, sum(a.amount * (coalesce(b.rate, c.base_rate) / 100)) AS reward
   FROM asked a CROSS JOIN c LEFT JOIN b ON b.card_id = c.card_id AND b.category = a.category GROUP BY 1, 2, 3),
 scr AS (SELECT t.*, m.amount AS main_amount, CASE WHEN u.monthly_budget > 0 THEN u.monthly_budget ELSE m.amount END AS monthly,
   CASE WHEN f.boost IS NULL THEN {_UP.format(x='reward', d=8)} ELSE {_UP.format(x='(reward * boost - (fm - 1) * annual_fee / 12)', d=4)} END AS score
   FROM tot t JOIN users u ON u.user_id = t.user_id JOIN main m ON m.user_id = t.user_id LEFT JOIN fac f ON f.user_id = t.user_id)"""
_PICKED = f"""SELECT user_id, card_id, (row_number() OVER w)::INT AS rank, round(reward, 6) AS raw_reward, round(score, 4) AS score, {_UP.format(x='(reward * (monthly / main_amount * 12))', d=2)} AS projected_savings
   FROM pool WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, {_UP.format(x='reward', d=8)} DESC, annual_fee, card_id)"""


def _sentence(name, **values):
    """A fixed sentence as SQL, its places filled by expressions."""
    parts = re.split(r"\{(\w+)\}", dims.CARD_TEXTS[name])
    return " || ".join(values[x] if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(parts) if i % 2 or x)


def _asked(t):
    users = t("users").select("user_id", F.col("monthly_budget").alias("monthly_spend"))
    return users, sc.normalize_spend(t("spend_profile")), t("user_cards"), t("user_personas")


@query(
    "portfolio_recommendation",
    "RWD13 JON7 TOP1",
    f"""WITH {CATALOGUE_CTES}, {SPEND}, {_ASKED},
 pool AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM user_cards u WHERE u.user_id = s.user_id) AS generic FROM scr s
   WHERE s.user_id NOT IN (SELECT user_id FROM user_cards) OR (s.user_id, s.card_id) IN (SELECT (user_id, card_id) FROM user_cards)),
 r AS ({_PICKED.replace('round(reward, 6)', 'generic AS is_generic, round(reward, 6)')})
 SELECT * FROM r WHERE NOT is_generic OR rank <= 10""",
    "spend_profile user_cards user_personas users card_feed",
)
def portfolio_recommendation(t):
    """Saved cards in order; for users without any, the first ten of the whole catalogue."""
    d = recommend.portfolio(*_asked(t), catalogue(t))
    return d.select("user_id", "card_id", "rank", "is_generic", F.round("raw_reward", 6).alias("raw_reward"), F.round("score", 4).alias("score"), "projected_savings")


@query(
    "catalogue_finder",
    "RWD13 JON8 TOP1",
    f"""WITH {CATALOGUE_CTES}, {SPEND}, {_ASKED},
 pool AS (SELECT s.* FROM scr s WHERE (s.user_id, s.card_id) NOT IN (SELECT (user_id, card_id) FROM user_cards)),
 r AS ({_PICKED}) SELECT * FROM r WHERE rank <= 10""",
    "spend_profile user_cards user_personas users card_feed",
)
def catalogue_finder(t):
    """The first ten cards of the whole catalogue that a user hasn't saved."""
    d = recommend.portfolio(*_asked(t), catalogue(t), full_catalogue=True)
    return d.select("user_id", "card_id", "rank", F.round("raw_reward", 6).alias("raw_reward"), F.round("score", 4).alias("score"), "projected_savings")


@query(
    "purchase_recommendation",
    "RWD14 RWD9 STR10",
    f"""WITH {CATALOGUE_CTES},
 q AS (SELECT transaction_id, tie_break, user_id, {SIGNED_AMOUNT} AS amount, lower(category) AS used, lower(category) AS known FROM transactions WHERE suspicious = 0),
 fac AS (SELECT x.user_id, x.category, avg({BOOST}) AS boost, avg({FEE_MULT}) AS fm FROM (SELECT DISTINCT user_id, used AS category FROM q) x JOIN user_personas p ON p.user_id = x.user_id WHERE persona IN ({KNOWN}) GROUP BY 1, 2),
 rate AS (SELECT k.known, c.card_id, c.annual_fee, coalesce(b.rate, c.base_rate) AS rate FROM (SELECT DISTINCT known FROM q) k CROSS JOIN c LEFT JOIN b ON b.card_id = c.card_id AND b.category = k.known),
 same AS (SELECT DISTINCT amount, used, known, boost, fm FROM q LEFT JOIN fac f ON f.user_id = q.user_id AND f.category = q.used),
 edge AS (SELECT known, rate, annual_fee, card_id, row_number() OVER (PARTITION BY known, rate, annual_fee ORDER BY card_id) AS i FROM rate QUALIFY i <= 5),
 scr AS (SELECT s.*, e.card_id, e.annual_fee, coalesce(amount, 0) * (rate / 100) AS reward,
   CASE WHEN boost IS NULL THEN {_UP.format(x='(coalesce(amount, 0) * (rate / 100))', d=8)} ELSE {_UP.format(x='(coalesce(amount, 0) * (rate / 100) * boost - (fm - 1) * annual_fee / 12)', d=4)} END AS score
   FROM same s JOIN edge e ON e.known = s.known),
 r AS (SELECT *, row_number() OVER (PARTITION BY amount, used, boost, fm ORDER BY score DESC, {_UP.format(x='reward', d=8)} DESC, annual_fee, card_id) AS k FROM scr QUALIFY k <= 5)
 SELECT r.used AS category_used, r.card_id, r.k::INT AS rank, count(*) AS n, round(sum(r.reward), 5) AS raw_reward
 FROM q LEFT JOIN fac f ON f.user_id = q.user_id AND f.category = q.used JOIN r ON r.amount IS NOT DISTINCT FROM q.amount AND r.used = q.used AND r.boost IS NOT DISTINCT FROM f.boost AND r.fm IS NOT DISTINCT FROM f.fm GROUP BY 1, 2, 3""",
    "transactions user_personas card_feed",
)
def purchase_recommendation(t):
    """The first five cards of the whole catalogue for every unsuspicious purchase, refunds too, with the user's personas."""
    q = t("transactions").where("suspicious = 0").withColumn("amount", F.expr(SIGNED_AMOUNT))
    d = recommend.for_purchases(q, t("user_personas"), catalogue(t), ["transaction_id", "tie_break"], k=5)
    return d.groupBy("category_used", "card_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("raw_reward"), 5).alias("raw_reward"))


@query(
    "modelled_profile_scores",
    "RWD10 RWD11 TOP1 STR15",
    f"""WITH {CATALOGUE_CTES}, {SPEND}, {PURCHASES},
 m AS (SELECT regr_slope(pv, x) AS slope, regr_intercept(pv, x) AS icpt FROM (SELECT ln(1 + greatest(monthly_budget, 0)) AS x, {{POINT_VALUE}} AS pv FROM users)),
 pred AS (SELECT user_id, icpt + slope * ln(1 + greatest(monthly_budget, 0)) AS pv FROM users, m),
 cs AS (SELECT user_id, category, sum(amount) AS amount FROM pur GROUP BY 1, 2),
 det AS (SELECT s.user_id, c.card_id, c.annual_fee, c.base_rate, sum(s.amount * (coalesce(b.rate, c.base_rate) / 100)) AS det
   FROM cs s CROSS JOIN c LEFT JOIN b ON b.card_id = c.card_id AND b.category = s.category GROUP BY 1, 2, 3, 4),
 stot AS (SELECT user_id, sum(amount) AS tot FROM spend GROUP BY 1),
 up AS (SELECT s.user_id, b.card_id, sum(s.amount / t.tot * greatest(b.rate - c.base_rate, 0) * 0.75) AS m FROM spend s JOIN stot t ON t.user_id = s.user_id JOIN b ON b.category = s.category JOIN c ON c.card_id = b.card_id GROUP BY 1, 2),
 sc AS (SELECT d.user_id, d.card_id, d.annual_fee, d.base_rate, d.det, p.pv > 0 AS personal, CASE WHEN p.pv > 0 THEN 0.6 * d.det + 0.4 * (d.det * (p.pv / 0.01::DOUBLE)
     * CASE WHEN st.tot IS NULL THEN 1 ELSE greatest(1 + coalesce(u.m, 0) + CASE WHEN us.redemption_preference LIKE 'travel%' AND tb.rate > d.base_rate THEN 0.15 ELSE 0 END + CASE WHEN us.redemption_preference = 'cash_back' AND d.annual_fee <= 0 THEN 0.1 ELSE 0 END, 0.1) END) ELSE d.det END AS score
   FROM det d JOIN users us ON us.user_id = d.user_id JOIN pred p ON p.user_id = d.user_id LEFT JOIN stot st ON st.user_id = d.user_id LEFT JOIN up u ON u.user_id = d.user_id AND u.card_id = d.card_id LEFT JOIN b tb ON tb.card_id = d.card_id AND tb.category = 'travel'),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_UP.format(x='score', d=7)} DESC, {_UP.format(x='det', d=8)} DESC, annual_fee, card_id) AS k FROM sc QUALIFY k <= 10),
 fb AS (SELECT r.user_id, r.card_id, min_by(b.category, (-s.amount, b.category)) AS cat, min_by(b.rate, (-s.amount, b.category)) AS rate FROM r JOIN spend s ON s.user_id = r.user_id JOIN b ON b.card_id = r.card_id AND b.category = s.category GROUP BY 1, 2)
 SELECT r.user_id, r.card_id, k::INT AS rank, round(det, 4) AS deterministic_score, round(score, 3) AS blended_score, personal AS is_personalized,
   CASE WHEN fb.cat IS NOT NULL THEN {{BONUS_LINE}} ELSE {{BASE_LINE}} END AS explanation FROM r LEFT JOIN fb ON fb.user_id = r.user_id AND fb.card_id = r.card_id""".replace(
        "{POINT_VALUE}", "CASE redemption_preference " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.POINT_VALUE.items()) + " ELSE 0.01 END::DOUBLE"
    )
    .replace("{BONUS_LINE}", _sentence("template_bonus", category="fb.cat", rate="printf('%.1f', fb.rate)"))
    .replace("{BASE_LINE}", _sentence("template_base", rate="printf('%.1f', r.base_rate)")),
    "spend_profile users transactions card_feed",
)
def modelled_profile_scores(t):
    """Ten cards per profile, scored with the point value that a trained, saved and reloaded model predicts."""
    spend, _, bought = purchases(t)
    users = t("users")
    value = F.create_map(*[x for k, v in dims.POINT_VALUE.items() for x in (F.lit(k), F.lit(float(v)))])
    frame = users.select("user_id", F.log1p(F.greatest("monthly_budget", F.lit(0.0))).alias("monthly_budget_log"), F.coalesce(F.try_element_at(value, F.col("redemption_preference")), F.lit(0.01)).alias("point_value"))
    folder = sinks.work_folder(t.spark, "point-value-model")
    modeling.train_point_value(frame, ["monthly_budget_log"], folder, model=modeling.linear("point_value"))
    predicted = modeling.predicted_point_values(frame.drop("point_value"), folder)
    profiles = users.select("user_id", F.col("redemption_preference").startswith("travel").alias("likes_travel"), (F.col("redemption_preference") == "cash_back").alias("likes_cashback"))
    d = recommend.profile_scores(profiles, spend, bought, predicted, catalogue(t))
    return d.select("user_id", "card_id", "rank", F.round("deterministic_score", 4).alias("deterministic_score"), F.round("blended_score", 3).alias("blended_score"), "is_personalized", "explanation")
