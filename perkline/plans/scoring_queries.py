"""Scoring queries over the transaction, wallet and spend tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline import dims
from perkline.operators import scoring as sc
from perkline.plans.registry import query


def _values(rows: list[tuple]) -> str:
    def one(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


CARDS_SQL = (
    "cat_cards AS (SELECT * FROM (VALUES "
    + _values([(c, n, i, f, b) for c, n, i, f, b, _ in dims.CURATED_CARDS])
    + ") t(card_id, card_name, issuer, annual_fee_dec, base_dec))"
)
CARD_CTES = (
    CARDS_SQL.replace("cat_cards", "cat_raw")
    + ", cat_cards AS (SELECT card_id, card_name, issuer, annual_fee_dec::DOUBLE AS annual_fee, base_dec::DOUBLE AS base_rate FROM cat_raw)"
    + ", cat_bonus AS (SELECT card_id, category, r::DOUBLE AS rate FROM (VALUES "
    + _values([(c, k, v) for c, _, _, _, _, bs in dims.CURATED_CARDS for k, v in bs.items()])
    + ") t(card_id, category, r))"
)

MCC_CASE = (
    "CASE "
    + " ".join(f"WHEN mcc_code = {k} THEN '{v}'" for k, v in dims.MCC_EXACT.items())
    + " "
    + " ".join(f"WHEN mcc_code BETWEEN {lo} AND {hi} THEN '{c}'" for lo, hi, c in dims.MCC_RANGES)
    + f" ELSE '{dims.MCC_DEFAULT}' END"
)

SCORED = f"""
WITH {CARD_CTES},
scored AS (
  SELECT t.*, c.card_id, c.annual_fee, c.card_name,
         CASE WHEN amount = 0 THEN 0 ELSE amount * (coalesce(b.rate, c.base_rate) / 100) END AS reward
  FROM transactions t CROSS JOIN cat_cards c LEFT JOIN cat_bonus b ON b.card_id = c.card_id AND b.category = t.category
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id, tie_break ORDER BY reward DESC, annual_fee, card_id) AS rnk FROM scored
)
"""


@query(
    "best_card_rewards",
    "JON6 RWD1 RWD2 RWD7 WIN3",
    SCORED + "SELECT category, card_id AS best_card_id, count(*) AS n, round(sum(reward), 6) AS total_reward "
    "FROM ranked WHERE rnk = 1 GROUP BY 1, 2",
    "transactions",
)
def best_card_rewards(t):
    best = sc.best_card(t("transactions"), sc.curated_portfolio())
    return best.groupBy("category", "best_card_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("best_reward"), 6).alias("total_reward")
    )


@query(
    "mcc_category",
    "JON5 UDF4",
    f"SELECT mcc_code, {MCC_CASE} AS mapped, count(*) AS n FROM raw_transactions GROUP BY 1, 2",
    "raw_transactions",
)
def mcc_category(t):
    return t("raw_transactions").groupBy("mcc_code", sc.mcc_category(F.col("mcc_code")).alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "portfolio_scores",
    "JON6 RWD2 RWD6",
    SCORED + """SELECT card_id, category, count(*) AS n, round(sum(reward), 6) AS total_reward,
      round(avg(CASE WHEN amount > 0 THEN reward / amount * 100 ELSE 0 END), 6) AS mean_rate FROM scored GROUP BY 1, 2""",
    "transactions",
)
def portfolio_scores(t):
    s = sc.score_portfolio(t("transactions"), sc.curated_portfolio(), foreign=None)
    return s.groupBy("card_id", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("reward_amount"), 6).alias("total_reward"),
        F.round(F.avg("reward_rate"), 6).alias("mean_rate"),
    )


@query(
    "card_rank_counts",
    "WIN2 TOP1",
    SCORED + "SELECT card_id, rnk::INT AS rank, count(*) AS n, round(sum(reward), 6) AS total_reward FROM ranked WHERE rnk <= 5 GROUP BY 1, 2",
    "transactions",
)
def card_rank_counts(t):
    r = sc.rank_portfolio(t("transactions"), sc.curated_portfolio(), top_k=5)
    return r.groupBy("card_id", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward_amount"), 6).alias("total_reward")
    )


FEATURED = [
    sc.Card("rotator", "Rotator", 0.0, 1.0, {"gas": 2.0}, {"Q1": (["groceries", "gas"], 5.0), "Q3": (["dining"], 5.0)}, foreign_fee_pct=3.0),
    sc.Card("credits", "Credits", 240.0, 1.5, {"dining": 3.0}, credits={"dining": (10.0, "monthly"), "travel": (50.0, "annual"), "gas": (30.0, "quarterly"), "other": (8.0, "weekly")}),
    sc.Card("bare", "Bare", 95.0, None),
]


@query(
    "rewards_with_fees_and_credits",
    "RWD1 RWD2 RWD3 DAT2",
    """, f AS (SELECT *, 'Q' || quarter(txn_date) AS q FROM transactions),
  s AS (
   SELECT 'rotator' AS card_id, category, amount, CASE WHEN amount = 0 THEN 0 ELSE amount * ((CASE WHEN q = 'Q1' AND category IN ('groceries','gas') THEN 5.0 WHEN q = 'Q3' AND category = 'dining' THEN 5.0 WHEN category = 'gas' THEN 2.0 ELSE 1.0 END)::DOUBLE / 100) - CASE WHEN is_foreign = 1 THEN amount * (3.0::DOUBLE / 100) ELSE 0 END END AS reward, 0.0 AS credit FROM f
   UNION ALL
   SELECT 'credits', category, amount, CASE WHEN amount = 0 THEN 0 ELSE amount * ((CASE WHEN category = 'dining' THEN 3.0 ELSE 1.5 END)::DOUBLE / 100) - 240.0::DOUBLE / 12 / 30 END,
     CASE category WHEN 'dining' THEN least(10.0::DOUBLE / 4, amount) WHEN 'travel' THEN least(50.0::DOUBLE / 48, amount) WHEN 'gas' THEN least(30.0::DOUBLE / 12, amount) WHEN 'other' THEN least(8.0::DOUBLE / 4, amount) ELSE 0 END FROM f
   UNION ALL
   SELECT 'bare', category, amount, CASE WHEN amount = 0 THEN 0 ELSE amount * (1.0::DOUBLE / 100) - 95.0::DOUBLE / 12 / 30 END, 0.0 FROM f)
  SELECT card_id, category, count(*) AS n, round(sum(reward + credit), 6) AS total_reward FROM s GROUP BY 1, 2""",
    "transactions",
)
def rewards_with_fees_and_credits(t):
    s = sc.score_portfolio(t("transactions"), FEATURED, amortize_months=12, with_credits=True)
    return s.groupBy("card_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward_amount"), 6).alias("total_reward")
    )


@query(
    "net_ranked_cards",
    "WIN2 WIN3 RWD2 RWD3 RWD7",
    """, f AS (SELECT *, 'Q' || quarter(txn_date) AS q FROM transactions),
  s AS (
   SELECT transaction_id, tie_break, 'rotator' AS card_id, 0.0 AS fee, amount, CASE WHEN amount = 0 THEN 0 ELSE amount * ((CASE WHEN q = 'Q1' AND category IN ('groceries','gas') THEN 5.0 WHEN q = 'Q3' AND category = 'dining' THEN 5.0 WHEN category = 'gas' THEN 2.0 ELSE 1.0 END)::DOUBLE / 100) - CASE WHEN is_foreign = 1 THEN amount * (3.0::DOUBLE / 100) ELSE 0 END END AS reward FROM f
   UNION ALL
   SELECT transaction_id, tie_break, 'credits', 240.0, amount, CASE WHEN amount = 0 THEN 0 ELSE amount * ((CASE WHEN category = 'dining' THEN 3.0 ELSE 1.5 END)::DOUBLE / 100) - 240.0::DOUBLE / 12 / 30 END
     + CASE category WHEN 'dining' THEN least(10.0::DOUBLE / 4, amount) WHEN 'travel' THEN least(50.0::DOUBLE / 48, amount) WHEN 'gas' THEN least(30.0::DOUBLE / 12, amount) WHEN 'other' THEN least(8.0::DOUBLE / 4, amount) ELSE 0 END FROM f
   UNION ALL
   SELECT transaction_id, tie_break, 'bare', 95.0, amount, CASE WHEN amount = 0 THEN 0 ELSE amount * (1.0::DOUBLE / 100) - 95.0::DOUBLE / 12 / 30 END FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY transaction_id, tie_break ORDER BY reward DESC, fee, card_id) AS rnk FROM s)
  SELECT card_id, rnk::INT AS rank, count(*) AS n, round(sum(reward), 6) AS total_reward FROM r GROUP BY 1, 2""",
    "transactions",
)
def net_ranked_cards(t):
    """Cards of each purchase by what they earn after foreign fees, amortised fees and credits."""
    r = sc.rank_portfolio(t("transactions"), FEATURED, amortize_months=12, with_credits=True)
    return r.groupBy("card_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward_amount"), 6).alias("total_reward"))


#: The catalogue of ``catalogue`` as SQL: c (cards) and b (bonuses).
CATALOGUE_CTES = f"""{CARD_CTES},
  c AS (SELECT source || '_' || ord AS card_id, greatest(annual_fee, 0.0)::DOUBLE AS annual_fee, coalesce(try_cast(base_reward_rate AS DOUBLE), 1.0) AS base_rate, CASE WHEN ord % 3 = 0 THEN 2.7::DOUBLE ELSE 0 END AS fee FROM card_feed
        UNION ALL SELECT card_id, annual_fee, base_rate, 0 FROM cat_cards),
  b AS (SELECT source || '_' || ord AS card_id, 'dining' AS category, (ord % 7)::DOUBLE AS rate FROM card_feed WHERE ord % 5 = 0 UNION ALL SELECT * FROM cat_bonus)"""
#: Some purchases turned into refunds, zero and missing amounts; both engines read it.
SIGNED_AMOUNT = "CASE mcc_code % 7 WHEN 1 THEN -amount WHEN 2 THEN CAST(0 AS DOUBLE) WHEN 3 THEN NULL ELSE amount END"


def catalogue(t):
    """The curated cards and every card of the feeds, with any rates they give."""
    feed = t("card_feed").select(
        F.concat_ws("_", "source", "ord").alias("card_id"), F.greatest("annual_fee", F.lit(0.0)).alias("annual_fee"), F.expr("try_cast(base_reward_rate AS DOUBLE)").alias("base_rate"),
        F.when(F.col("ord") % 5 == 0, F.create_map(F.lit("dining"), (F.col("ord") % 7).cast("double"))).otherwise(F.create_map().cast("map<string,double>")).alias("bonuses"),
        F.when(F.col("ord") % 3 == 0, F.lit(2.7)).otherwise(F.lit(0.0)).alias("foreign_fee_pct"),
    )
    rows = [(c.card_id, c.annual_fee, c.base_rate, dict(c.bonuses), c.foreign_fee_pct) for c in sc.curated_portfolio()]
    curated = t.spark.createDataFrame(rows, "card_id string, annual_fee double, base_rate double, bonuses map<string,double>, foreign_fee_pct double")
    return feed.unionByName(curated)


@query(
    "catalog_ranked_cards",
    "JON6 RWD10 RWD13 TOP1",
    f""", {CATALOGUE_CTES},
  k AS (SELECT DISTINCT category FROM b UNION ALL SELECT ''),
  n AS (SELECT k.category, x.abroad, c.card_id, c.annual_fee, coalesce(b.rate, c.base_rate) - CASE WHEN x.abroad THEN c.fee ELSE 0 END AS net
        FROM c CROSS JOIN k CROSS JOIN (VALUES (true), (false)) x(abroad) LEFT JOIN b ON b.card_id = c.card_id AND b.category = k.category),
  g AS (SELECT *, row_number() OVER (PARTITION BY category, abroad, sgn ORDER BY -sgn * net, annual_fee, card_id) AS rnk FROM n CROSS JOIN (VALUES (1), (-1), (0)) y(sgn) QUALIFY rnk <= 10),
  p AS (SELECT category, is_foreign, {SIGNED_AMOUNT} AS amount FROM transactions)
  SELECT g.card_id, g.rnk::INT AS rank, g.sgn AS sign, count(*) AS n, round(sum(p.amount * net / 100), 6) AS total_reward
  FROM p JOIN g ON g.category = CASE WHEN p.category IN (SELECT category FROM k) THEN p.category ELSE '' END AND g.abroad = (p.is_foreign = 1) AND g.sgn = sign(coalesce(p.amount, 0)) GROUP BY 1, 2, 3""",
    "transactions card_feed",
)
def catalog_ranked_cards(t):
    """The ten best cards of the whole catalogue for every purchase, refund and missing amount, the catalogue being a table."""
    r = sc.rank_card_table(t("transactions").withColumn("amount", F.expr(SIGNED_AMOUNT)), catalogue(t))
    r = r.withColumn("sign", F.signum(F.coalesce("amount", F.lit(0.0))).cast("int"))
    return r.groupBy("card_id", "rank", "sign").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward_amount"), 6).alias("total_reward"))


CAPPED = [
    sc.Card("gold", "Gold", 250.0, 1.0, {"dining": 4.0, "groceries": 4.0}, caps={"dining": 1500.0, "groceries": 2500.0}),
    sc.Card("flat", "Flat", 0.0, 2.0),
]


@query(
    "capped_rewards",
    "WIN4 WIN5 RWD5",
    """, c AS (SELECT *, round(greatest(amount, 0) * 100)::BIGINT AS cents FROM transactions),
  r AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY user_id, category, year(txn_date) ORDER BY txn_date, transaction_id, tie_break
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100 AS spent FROM c),
  g AS (SELECT *, CASE category WHEN 'dining' THEN 1500.0::DOUBLE WHEN 'groceries' THEN 2500.0::DOUBLE END AS cap FROM r),
  s AS (SELECT user_id, 'gold' AS card_id, amount,
          CASE WHEN cap IS NOT NULL AND (greatest(cap - spent, 0) <= 0 OR greatest(cap - spent, 0) < amount) THEN 1 ELSE 0 END AS capped,
          category FROM g UNION ALL SELECT user_id, 'flat', amount, 0, category FROM g)
  SELECT user_id, card_id, sum(capped)::BIGINT AS n_capped, count(*) AS n,
         round(sum(amount * ((CASE WHEN card_id = 'flat' THEN 2.0 WHEN capped = 0 AND category IN ('dining','groceries') THEN 4.0 ELSE 1.0 END)::DOUBLE / 100)), 6) AS total_reward
  FROM s GROUP BY 1, 2""",
    "transactions",
)
def capped_rewards(t):
    s = sc.score_with_caps(
        t("transactions"), CAPPED, order=("txn_date", "transaction_id", "tie_break"), period=F.year("txn_date")
    )
    return s.groupBy("user_id", "card_id").agg(
        F.sum(F.col("is_capped").cast("long")).alias("n_capped"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("reward_amount"), 6).alias("total_reward"),
    )
