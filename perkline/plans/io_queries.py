"""Source, sink, page, join and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline.functions import html, nested, text
from perkline.operators import cleaning, drift, features, monitoring, quality
from perkline.operators import scoring as sc
from perkline.plans.registry import query
from perkline.sources import files, sinks, tables
from perkline.streaming import streams

R = lambda c, n=8: F.round(c, n).alias(c)


# ----------------------------------------------------------------------------- pages

_ISSUER_CASE = "CASE " + " ".join(f"WHEN contains(lower(h), '{k}') THEN '{v}'" for k, v in text.ISSUER_FRAGMENTS) + " END"


@query(
    "page_listings",
    "STR13",
    r"""WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS txt,
     regexp_extract(url, '^(https?://[^/]+)', 1) AS site, coalesce(nullif(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1), ''), nullif(regexp_extract(html, '(?is)<h3[^>]*>(.*?)</h3>', 1), ''), nullif(regexp_extract(html, '(?is)<h4[^>]*>(.*?)</h4>', 1), ''), nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '')) AS h,
     nullif(regexp_extract(html, '(?i)<a[^>]*\shref="([^"]+)"', 1), '') AS href FROM pages)
   SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS name, length(txt)::INT AS text_length,
     CASE WHEN contains(lower(txt), 'no annual fee') OR contains(lower(txt), '$0 annual fee') THEN 0 ELSE try_cast(nullif(regexp_extract(txt, '\$(\d+)', 1), '') AS INT) END AS annual_fee,
     trim(nullif(regexp_extract(txt, '(?i)((\d+(?:\.\d+)?)\s*[%x]\s*(cash\s*back|points?|miles?)?)', 1), '')) AS base_reward_rate,
     CASE WHEN starts_with(href, '/') THEN site || href WHEN starts_with(href, 'http') THEN href END AS detail_url, len(regexp_extract_all(html, '(?i)<a[^>]*\shref='))::INT AS n_links,
     nullif(regexp_extract(html, '(?i)<img[^>]*\ssrc="([^"]+)"', 1), '') AS image_url,
     trim(coalesce(nullif(regexp_extract(txt, '(?i)(\$[\d,]+|\d+[,\d]*\s*(?:points?|miles?))\s*(?:sign.?up|welcome|bonus)', 1), ''), nullif(regexp_extract(txt, '(?i)(?:earn|get)\s+(\$[\d,]+|\d+[,\d]*)\s*(?:points?|miles?|bonus)?', 1), ''))) AS welcome_bonus,
     """ + _ISSUER_CASE + r""" AS issuer, len(regexp_extract_all(html, '(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'))::INT AS n_products FROM p""",
)
def page_listings(t):
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    d = t("pages").select("page_id", html.card_listing(F.col("html"), site).alias("c"), F.length(html.page_text(F.col("html"))).alias("text_length"), F.size(html.json_ld_cards(F.col("html"))).alias("n_products"))
    return d.select("page_id", "c.name", "text_length", "c.annual_fee", "c.base_reward_rate", "c.detail_url", "c.n_links", "c.image_url", "c.welcome_bonus", "c.issuer", "n_products")


def _product(kind, name):
    """JSON text of one product of a page."""
    return F.concat(
        F.lit('{"@type": "'), kind, F.lit('", "name": "'), name, F.lit('", "description": "a \\"fine\\" card", "url": "'), F.col("url"),
        F.lit('", "image": "/i.png", "offers": {"price": "$'), F.col("page_id").cast("string"), F.lit('.50"}, "aggregateRating": {"ratingValue": 4.5, "reviewCount": '), F.col("page_id").cast("string"), F.lit("}}"),
    )


@query(
    "page_products",
    "STR13",
    """WITH p AS (SELECT page_id, url, page_id % 6 AS k FROM pages),
    i AS (SELECT page_id, url, 0 AS place, 'Chase One ' || page_id AS name, 'Chase' AS issuer FROM p WHERE k IN (0, 1, 2) UNION ALL SELECT page_id, url, 1, 'Discover Two ' || page_id, 'Discover' FROM p WHERE k IN (1, 2))
    SELECT page_id, place, name, issuer, 'a "fine" card' AS description, url AS detail_url, '/i.png' AS image_url, page_id + 0.5::DOUBLE AS annual_fee, '4.5' AS rating, page_id::VARCHAR AS review_count FROM i""",
)
def page_products(t):
    """Products that JSON-LD blocks put into the given pages: one object, a list, an item list; broken, other and unnamed ones give none."""
    pid = F.col("page_id").cast("string")
    one, two = _product(F.lit("CreditCard"), F.concat(F.lit("Chase One "), pid)), _product(F.lit("FinancialProduct"), F.concat(F.lit("Discover Two "), pid))
    other = F.lit('{"@type": "Organization", "name": "none"}')
    k = F.col("page_id") % 6
    block = (
        F.when(k == 0, one)
        .when(k == 1, F.concat(F.lit(" ["), one, F.lit(", "), other, F.lit(", "), two, F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"@type": "ItemList", "itemListElement": [{"item": "https://a.b/c"}, {"item": '), one, F.lit('}, {"position": 2}, {"item": '), two, F.lit("}]}")))
        .when(k == 3, F.concat(F.lit("{broken "), one)).when(k == 4, two).otherwise(_product(F.lit("Product"), F.lit("")))
    )
    page = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/ld+json">\n'), block, F.lit("</script><script>var x = 1</script>"))
    found = t("pages").select("page_id", F.posexplode(html.json_ld_cards(page)).alias("place", "c"))
    return found.select("page_id", "place", "c.*")


# -------------------------------------------------------------------- joins and checks


@query(
    "bias_features",
    "JON4 AGG16",
    """WITH a AS (SELECT user_id, sum(amount) AS ts, avg(amount) AS av, count(amount) AS n, count(DISTINCT category) AS nc, sum(amount) FILTER (category = 'dining') AS dining FROM transactions GROUP BY 1)
     SELECT u.user_id, round(coalesce(ts, 0), 4) AS total_spend, round(coalesce(av, 0), 8) AS avg_txn, coalesce(n, 0) AS txn_count, coalesce(nc, 0) AS n_categories, round(coalesce(dining, 0), 4) AS spend_dining FROM users u LEFT JOIN a ON a.user_id = u.user_id""",
    "transactions users",
)
def bias_features(t):
    per = t("transactions").groupBy("user_id", "category").agg(F.sum("amount").alias("s"), F.count("amount").alias("n"))
    a = per.groupBy("user_id").agg(
        F.sum("s").alias("total_spend"), (F.sum("s") / F.sum("n")).alias("avg_txn"), F.sum("n").alias("txn_count"),
        F.count("category").alias("n_categories"), F.sum(F.when(F.col("category") == "dining", F.col("s"))).alias("spend_dining"),
    )
    d = t("users").select("user_id").join(a, "user_id", "left").na.fill(0)
    return d.select("user_id", R("total_spend", 4), R("avg_txn"), "txn_count", "n_categories", R("spend_dining", 4))


@query(
    "metric_changes",
    "JON12 STA4",
    """WITH a AS (SELECT segment, source, avg(score) AS v FROM predictions WHERE item_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT segment, source, avg(score) AS v FROM predictions WHERE item_id % 2 = 1 GROUP BY 1, 2),
    j AS (SELECT coalesce(a.segment, b.segment) AS name, coalesce(a.source, b.source) AS feature, coalesce(a.v, 0) AS before, coalesce(b.v, 0) AS after FROM a FULL JOIN b ON a.segment = b.segment AND a.source = b.source),
    k AS (SELECT *, CASE WHEN before <> 0 THEN (after - before) / abs(before) WHEN after = 0 THEN 0 ELSE 'inf'::DOUBLE END AS rel FROM j)
    SELECT name, feature, round(before, 8) AS before, round(after, 8) AS after, CASE WHEN rel > 0.05 THEN 'regression' WHEN rel < -0.05 THEN 'improvement' ELSE 'stable' END AS verdict FROM k""",
    "predictions",
)
def metric_changes(t):
    p = t("predictions")

    def version(cond):
        return p.where(cond).groupBy(F.col("segment").alias("name"), F.col("source").alias("feature")).agg(F.avg("score").alias("value"))

    d = drift.metric_drift(version("item_id % 2 = 0"), version("item_id % 2 = 1"), ["name", "feature"], "value")
    return d.select("name", "feature", R("before"), R("after"), "verdict")


@query(
    "user_overlap",
    "JON15 SET4",
    """SELECT 'users_without_transactions' AS "check", count(*) AS n FROM users WHERE user_id NOT IN (SELECT user_id FROM transactions) UNION ALL SELECT 'transaction_users_without_profile', count(DISTINCT user_id) FROM transactions WHERE user_id NOT IN (SELECT user_id FROM users)""",
    "transactions users",
)
def user_overlap(t):
    u, x = t("users").select("user_id"), t("transactions").select("user_id").distinct()
    a = u.join(x, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("users_without_transactions").alias("check"), "n")
    b = x.join(u, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("transaction_users_without_profile").alias("check"), "n")
    return a.unionByName(b)


@query(
    "scoring_agreement",
    "RWD22",
    "SELECT category, count(*) * 9 AS cases, count(*) * 9 AS passed FROM transactions GROUP BY 1",
    "transactions",
)
def scoring_agreement(t):
    """The literal rate book against the card-table join, case by case."""
    cards = sc.curated_portfolio()
    spark = t("transactions").sparkSession
    tx = t("transactions").select("transaction_id", "category", "amount", "txn_date", "is_foreign")
    actual = sc.score_portfolio(tx, cards).withColumnRenamed("reward_amount", "actual")
    d = sc.score_card_table(actual.drop("card_name", "annual_fee", "reward_rate").join(F.broadcast(sc.card_frame(spark, cards)), "card_id"))
    c = sc.check_cases(d.withColumnRenamed("reward_amount", "expected"))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("passed").cast("long")).alias("passed"))


# --------------------------------------------------------------------- files in and out


def _logs(t):
    """Request logs in their nested file shape."""
    r = t("requests")
    m = F.create_map(
        *[x for k in ("normalize", "deterministic", "personalization", "rank", "llm_explanation", "total") for x in (F.lit(k), F.col(f"{k}_ms"))]
    )
    score = lambda i: F.struct(
        F.concat(F.lit("card_"), F.lit(str(i))).alias("card_name"), F.lit(i).alias("rank"), F.col("blended_score").alias("deterministic_score"),
        F.lit(None).cast("double").alias("personalization_score"), (F.col("blended_score") / i).alias("blended_score"),
    )
    return r.select(
        F.date_format("request_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("request_id").cast("string").alias("request_id"),
        F.substring(F.sha2("user_id", 256), 1, 12).alias("user_hash"),
        F.struct(
            F.create_map(F.lit("dining"), F.col("total_ms"), F.when(F.col("request_id") % 2 == 0, "travel").otherwise("gas"), F.lit(10.0)).alias("spending_categories"),
            F.when(F.col("request_id") % 3 != 0, F.col("total_ms") * 2).alias("monthly_spend"),
            F.when(F.col("request_id") % 2 == 0, F.array(F.lit("travel"))).otherwise(F.array(F.lit("cashback"), F.lit("travel"))).alias("preferred_rewards"),
            (F.col("request_id") % 5).cast("int").alias("transaction_history_count"),
        ).alias("input_features"),
        F.array(score(1), score(2)).alias("predicted_scores"),
        "top_card", "model_version", m.alias("latency_breakdown_ms"), (F.col("is_personalized") == 1).alias("is_personalized"),
        "explanation_latency_ms", "recommendation_flow", "request_status",
    )


@query(
    "log_frames",
    "MON1 MAP2 ARR6 RSH3",
    """SELECT count(*) AS requests, round(sum(total_ms), 4) AS spend_dining, (count(*) FILTER (request_id % 2 = 0) * 10)::DOUBLE AS spend_travel, count(*) FILTER (request_id % 2 <> 0) AS pref_cashback, round(sum(CASE WHEN request_id % 3 <> 0 THEN total_ms * 2 ELSE 0 END), 4) AS monthly_spend,
      count(*) * 2 AS predictions, round(sum(blended_score) * 1.5, 4) AS blended, 0.0::DOUBLE AS personal, round(sum(coalesce(normalize_ms, 0)), 4) AS normalize_ms, sum(is_personalized)::BIGINT AS personalized FROM requests""",
    "requests",
)
def log_frames(t):
    logs = _logs(t)
    i = monitoring.input_frame(logs, ["dining", "travel", "gas"], ["cashback", "travel"]).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.sum("spend_dining"), 4).alias("spend_dining"), F.round(F.sum("spend_travel"), 4).alias("spend_travel"),
        F.sum("pref_cashback").alias("pref_cashback"), F.round(F.sum("monthly_spend"), 4).alias("monthly_spend"),
    )
    p = monitoring.prediction_frame(logs).agg(
        F.struct(F.count(F.lit(1)).alias("predictions"), F.round(F.sum("blended_score"), 4).alias("blended"), F.sum("personalization_score").alias("personal")).alias("p")
    ).scalar()
    lat = monitoring.latency_frame(logs).agg(F.round(F.sum("normalize_ms"), 4)).scalar()
    meta = monitoring.metadata_frame(logs).agg(F.sum(F.col("is_personalized").cast("long"))).scalar()
    d = i.withColumn("p", p).withColumn("normalize_ms", lat).withColumn("personalized", meta)
    return d.select("requests", "spend_dining", "spend_travel", "pref_cashback", "monthly_spend", "p.*", "normalize_ms", "personalized")


@query(
    "logs_round_trip",
    "SNK3 SRC4",
    "SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, round(sum(total_ms), 4) AS total_ms, count(DISTINCT user_id) AS users FROM requests WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1",
    "requests",
)
def logs_round_trip(t):
    """Logs written below their day, then a seven-day range read back."""
    spark = t("events").sparkSession
    base = sinks.append_logs(_logs(t), sinks.work_folder(spark, "logs"))
    d = files.read_logs(spark, base, "2024-01-05", "2024-01-11")
    return d.groupBy(F.col("dt").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("latency_breakdown_ms")["total"]), 4).alias("total_ms"), F.count_distinct("user_hash").alias("users")
    )


@query(
    "feature_run_round_trip",
    "SNK1 SNK2 SRC5 SRC1",
    "SELECT 'run_2' AS run_id, count(*) AS n, round(sum(monthly_budget), 4) AS budget FROM users",
    "users",
)
def feature_run_round_trip(t):
    """Two runs of a feature table written, the newest read back."""
    spark = t("users").sparkSession
    base = sinks.work_folder(spark, "features")
    f = t("users").select("user_id", "monthly_budget")
    sinks.write_run({"users": f.where("ord % 2 = 0")}, base, "run_1")
    path = sinks.write_run({"users": f.withColumnsRenamed({})}, base, "run_2")["users"]
    d = files.latest_snapshot(spark.read.parquet(path))
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("monthly_budget"), 4).alias("budget"))


@query(
    "offers_round_trip",
    "SRC2 SRC3 CLN22",
    """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'issuers' ELSE 'api' END AS source, count(*) AS n, sum(p_size)::BIGINT AS spend FROM part GROUP BY 1""",
)
def offers_round_trip(t):
    """A feed of payload objects and one of bare offers, read back with nested keys flattened and sources tagged."""
    spark = t.spark
    base = sinks.work_folder(spark, "offers")
    offer = F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").cast("long").alias("spend"), F.col("p_type").alias("kind")).alias("terms"))
    d = t("part").select(offer.alias("offer"), "p_partkey")
    d.where("p_partkey % 2 = 0").select("offer.*").write.json(f"{base}/issuers")
    payloads = d.where("p_partkey % 2 = 1").groupBy(F.floor(F.col("p_partkey") / 50)).agg(F.collect_list("offer").alias("offers")).select("offers")
    payloads.write.json(f"{base}/api")
    out = files.read_feeds(spark, {"api": f"{base}/api", "issuers": f"{base}/issuers", "absent": f"{base}/none"}, lines=True)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("`terms.spend`").alias("spend"))


@query(
    "offer_array_files",
    "SRC2",
    """SELECT p_brand AS brand, p_partkey AS part, p_name || ' "' || p_type || '" [{' AS name, p_size::BIGINT AS spend, len(string_split(p_type, ' '))::INT AS n_tags FROM part""",
)
def offer_array_files(t):
    """One array file per brand, every second one a payload with other lists beside the offers, read in slices."""
    named = F.concat("p_name", F.lit(' "'), "p_type", F.lit('" [{'))
    offer = F.struct("p_brand", "p_partkey", named.alias("name"), F.struct(F.col("p_size").cast("long").alias("spend"), F.split("p_type", " ").alias("tags")).alias("terms"))
    payload = F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    d = t("part").select("p_brand", "p_partkey", F.to_json(offer).alias("line"), payload.alias("payload"))
    ends = d.groupBy("p_brand", "payload").agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    d = d.join(ends, ["p_brand", "payload"])
    before = F.when(F.col("p_partkey") != F.col("first"), F.lit("  ,")).when(F.col("payload"), F.lit('{"meta": {"offers": [{"p_partkey": -1}]}, "old": [{"p_partkey": -2}],\n "offers": [')).otherwise(F.lit("[ "))
    after = F.when(F.col("p_partkey") != F.col("last"), F.lit("")).when(F.col("payload"), F.lit('], "notes": [{"p_partkey": -3}]}')).otherwise(F.lit("]"))
    base = sinks.work_folder(t.spark, "arrays")
    lines = d.select(F.concat(before, "line", after).alias("value"), F.col("p_brand").alias("brand"), "p_partkey")
    lines.repartition("brand").sortWithinPartitions("brand", "p_partkey").select("value", "brand").write.partitionBy("brand").text(base)
    out = files.read_offer_arrays(t.spark, base, "p_brand string, p_partkey long, name string, terms struct<spend:long,tags:array<string>>")
    return out.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), "name", F.col("`terms.spend`").alias("spend"), F.size("`terms.tags`").alias("n_tags"))


@query(
    "latest_output",
    "SRC5",
    """WITH r AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN event_id % 97 = 0 THEN 'final' ELSE 'checkpoint' END AS stage, event_type FROM events)
     SELECT event_type, run_id, stage FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY run_id DESC, stage = 'final' DESC) = 1""",
)
def latest_output(t):
    """The newest run of each kind, its final output if there is one, else its checkpoint."""
    r = t("events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.when(F.col("event_id") % 97 == 0, "final").otherwise("checkpoint").alias("stage"))
    return files.latest_run(r.distinct(), ["event_type"])


@query(
    "file_manifest",
    "SRC6",
    """SELECT p_brand AS brand, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256 FROM (SELECT p_brand, string_agg(p_partkey || ';' || p_name || chr(10), '' ORDER BY p_partkey) AS body FROM part GROUP BY 1)""",
)
def file_manifest(t):
    """One text file per brand, listed with size and checksum."""
    lines = t("part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(";"), F.col("p_name")).alias("value"), F.col("p_brand").alias("brand"))
    base = sinks.work_folder(t.spark, "manifest")
    lines.repartition("brand").sortWithinPartitions("brand", "p_partkey").select("value", "brand").write.partitionBy("brand").text(base)
    m = files.manifest(t.spark, base).where(F.col("path").endswith(".txt"))
    return m.select(F.url_decode(F.regexp_extract("path", "brand=([^/]+)", 1)).alias("brand"), "bytes", "sha256")


@query(
    "ledger_csv",
    "SNK4",
    "SELECT source_flow, count(*) AS n, round(sum(amount), 2) AS amount, count(*) FILTER (chosen_card_name IS NULL) AS unnamed FROM ledger GROUP BY 1",
    "ledger",
)
def ledger_csv(t):
    """The export written as CSV and read back with its declared schema."""
    from perkline.operators import ledger as lg

    spark = t("orders").sparkSession
    rows = lg.export_rows(t("ledger").withColumn("card_was_saved", F.lit(False)), "id", "tie_break")
    path = sinks.write_export(rows, sinks.work_folder(spark, "export"))
    schema = "id string, merchant string, amount double, category string, chosen_card_id string, chosen_card_name string, reward_earned double, estimated_savings double, source_flow string, card_was_saved boolean, timestamp string"
    d = files.read_csv(spark, path, schema)
    return d.groupBy("source_flow").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.count(F.when(F.col("chosen_card_name").isNull(), 1)).alias("unnamed")
    )


@query(
    "report_and_history",
    "SNK5 SNK6",
    "SELECT 'orders' AS dataset, '2024-01-02' AS ts, count(*)::DOUBLE AS rows_now, round(count(*) FILTER (o_orderkey % 2 = 0)::DOUBLE, 0) AS rows_before FROM orders",
)
def report_and_history(t):
    """Two statistics snapshots appended; the latest and the one before it read back."""
    spark = t("orders").sparkSession
    base = sinks.work_folder(spark, "history")
    one = lambda d: d.agg(F.count(F.lit(1)).cast("double").alias("value"))
    sinks.append_snapshot(one(t("orders").where("o_orderkey % 2 = 0")), base, "orders", "2024-01-01")
    sinks.append_snapshot(one(t("orders")), base, "orders", "2024-01-02")
    d = monitoring.with_previous(spark.read.parquet(base), "dataset", "ts", "value")
    last = monitoring.latest(d, "dataset", "ts").select("dataset", F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.col("value").alias("rows_now"), F.col("previous").alias("rows_before"))
    path = sinks.write_report(last, base + "-report")
    return spark.read.schema("dataset string, ts string, rows_now double, rows_before double").json(path)


@query(
    "table_fingerprints",
    "HSH1 JSN2 SNK7",
    """SELECT 'users' AS step, count(*) AS rows, 8 AS columns, false AS used_checkpoint, true AS order_free, 64 AS hash_length FROM users UNION ALL SELECT 'cards', count(*), 14, true, true, 64 FROM cards""",
    "users cards",
)
def table_fingerprints(t):
    """Audit rows; the fingerprint of a reshuffled table is the same."""
    audit = sinks.run_audit({"users": t("users"), "cards": t("cards")}, "run_1", "{}", ["cards"])
    again = sinks.run_audit({"users": t("users").repartition(7), "cards": t("cards").repartition(5, "ord")}, "run_1", "{}", ["cards"])
    d = audit.join(again.select("step", F.col("fingerprint").alias("f2")), "step")
    return d.select("step", "rows", "columns", "used_checkpoint", (F.col("fingerprint") == F.col("f2")).alias("order_free"), F.length("fingerprint").alias("hash_length"))


@query(
    "canonical_rows",
    "JSN2",
    """SELECT card_id, CASE WHEN issuer IS NULL THEN '{"id":"' || card_id || '"}' ELSE '{"id":"' || card_id || '","issuer":"' || issuer || '"}' END AS row_json FROM cards""",
    "cards",
)
def canonical_rows(t):
    return t("cards").select("card_id", nested.canonical_json(("issuer", F.col("issuer")), ("id", F.col("card_id"))).alias("row_json"))


@query(
    "transformation_run",
    "RWD21 SNK7 CLN17",
    """WITH t AS (SELECT count(*) AS n FROM raw_transactions WHERE NOT coalesce(amount < 0, false) AND coalesce(try_cast(date_text AS TIMESTAMP) <= TIMESTAMP '2001-06-01', false)), u AS (SELECT count(DISTINCT user_id) AS n FROM raw_users),
    f AS (SELECT count(DISTINCT user_id) AS n FROM raw_transactions WHERE NOT coalesce(amount < 0, false) AND coalesce(try_cast(date_text AS TIMESTAMP) <= TIMESTAMP '2001-06-01', false))
    SELECT 'clean_transactions' AS step, n AS rows FROM t UNION ALL SELECT 'clean_users', n FROM u UNION ALL SELECT 'user_features', n FROM f""",
    "raw_transactions raw_users",
)
def transformation_run(t):
    """Raw tables to clean tables to features, with row counts per step."""
    clean = cleaning.clean_transactions(t("raw_transactions"), "2001-06-01", order=("transaction_id", "tie_break")).withColumnRenamed("date", "txn_date")
    users = cleaning.clean_users(t("raw_users"), F.col("ord"))
    feats = features.build_all(None, clean, users)
    audit = sinks.run_audit({"clean_transactions": clean, "clean_users": users, "user_features": feats["transactions"]}, "run_1", "{}")
    return audit.select("step", "rows")


# --------------------------------------------------------------------------- streaming


def _stream(t, table: str, domain: str | None = None):
    """A driver table as a file stream, optionally through a domain SELECT."""
    spark = t.spark
    # A source that is one file has to be a pattern; this one matches the name and nothing beside it.
    path = t.path(table)
    s = streams.file_stream(spark, f"{path[:-1]}[{path[-1]}]", t(table).schema)
    if domain:
        s = spark.sql(tables.SQL[domain].replace(f"FROM {table}", "FROM {src}"), src=s)
    return spark, s


def _run(spark, df, name):
    base = sinks.work_folder(spark, name)
    return streams.run_available(df, base + "/rows", base + "/checkpoint")


@query(
    "stream_intake",
    "STM1",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1",
)
def stream_intake(t):
    spark, s = _stream(t, "events")
    d = _run(spark, s, "intake")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(
    "stream_daily_metrics",
    "STM2",
    """SELECT CAST(day AS VARCHAR) AS day, count(*) AS request_count, count(*) FILTER (request_status = 'error') AS error_count, round(avg(is_personalized), 8) AS personalization_rate, coalesce(sum(llm_calls), 0)::BIGINT AS llm_calls FROM requests
     WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
    "requests",
)
def stream_daily_metrics(t):
    """Days the watermark has closed; the last day stays open."""
    spark, s = _stream(t, "events", "requests")
    s = s.withColumn("request_ts", F.col("request_ts").cast("timestamp"))
    d = _run(spark, streams.daily_metrics(s, "request_ts"), "daily")
    return d.select(F.col("day").cast("string").alias("day"), "request_count", "error_count", R("personalization_rate"), "llm_calls")


@query(
    "stream_sliding_latency",
    "STM3",
    """WITH h AS (SELECT epoch_ms(ts) // 3600000 AS hr, value FROM events), w AS (SELECT hr - i AS start, value FROM h CROSS JOIN range(0, 24) r(i))
     SELECT strftime(make_timestamp(start * 3600000000), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 8) AS mean_ms, max(value) AS max_ms, quantile_disc(value, 0.95) AS p95_ms_approx, quantile_disc(value, 0.95) > 100 AS alert FROM w
     WHERE make_timestamp((start + 24) * 3600000000) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY start""",
)
def stream_sliding_latency(t):
    spark, s = _stream(t, "events")
    s = s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("total_ms"))
    d = _run(spark, streams.sliding_latency(s, "ts", alert_ms=100.0), "sliding")
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", R("mean_ms"), "max_ms", "p95_ms_approx", "alert")


@query(
    "stream_alert_dedupe",
    "STM4",
    """WITH RECURSIVE e AS (SELECT event_type AS message, user_id % 4 AS severity, ts FROM events),
     sent AS (SELECT message, severity, min(ts) AS ts FROM e GROUP BY 1, 2
       UNION ALL SELECT s.message, s.severity, min(e.ts) FROM sent s JOIN e ON e.message = s.message AND e.severity = s.severity AND e.ts >= s.ts + INTERVAL 1 HOUR GROUP BY 1, 2)
     SELECT message, severity, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM sent GROUP BY 1, 2""",
)
def stream_alert_dedupe(t):
    """Alerts sent with the hour of silence after each."""
    spark, s = _stream(t, "events")
    s = s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("message"), (F.col("user_id") % 4).alias("severity"))
    d = _run(spark, streams.dedupe_alerts(s, "ts"), "alerts")
    return d.groupBy("message", "severity").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query(
    "stream_spending_caps",
    "STM5",
    """SELECT user_id, event_type, count(*) AS n, round(sum(before), 2) AS sum_before FROM (SELECT *, coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100 AS before FROM events) GROUP BY 1, 2""",
)
def stream_spending_caps(t):
    spark, s = _stream(t, "events")
    s = s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    d = streams.spend_before(
        s, ["user_id", "event_type"], ["ts", "event_id"], "value", ["event_id", "value"],
        "event_id long, value double, user_id long, event_type string, spent_before double",
    )
    out = _run(spark, d, "caps")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("spent_before"), 2).alias("sum_before"))


@query(
    "stream_row_contract",
    "STM6",
    """SELECT o_orderpriority AS archetype, 'archetype' || CASE WHEN NOT o_totalprice > 30000 THEN ',monthly_budget' ELSE '' END AS reasons, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def stream_row_contract(t):
    spark, s = _stream(t, "orders")
    s = s.select(
        F.format_string("user_%d", F.col("o_custkey")).alias("user_id"), F.col("o_orderpriority").alias("archetype"), (F.col("o_totalprice") - 30000).alias("monthly_budget"),
        F.lit("cash_back").alias("redemption_preference"), F.lit("26-35").alias("age_group"), F.lit("urban").alias("location_type"),
    )
    _, bad = streams.contract_split(s, quality.user_reasons())
    d = _run(spark, bad, "contract")
    return d.groupBy("archetype", F.concat_ws(",", "reject_reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))
