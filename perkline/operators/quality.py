"""Data-quality suites, row contracts and anomaly rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline import dims
from perkline.operators import drift, ordered

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)
ANOMALY_COLUMNS = ["dataset", "check_name", "column", "severity", "observed", "ratio"]
SEVERITY_LEVEL = {"INFO": 1, "WARNING": 2, "CRITICAL": 3}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


# ------------------------------------------------------------------------------ suites


@dataclass(frozen=True)
class Rule:
    """One expectation: ``kind`` with its column and parameters."""

    kind: str
    column: str = ""
    low: float | None = None
    high: float | None = None
    strict: bool = False
    mostly: float = 1.0
    pattern: str = ""
    values: tuple = ()

    def broken(self) -> Column:
        """True for a row that breaks a row-level rule; null cells only break not_null."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "between":
            ok = F.lit(True)
            if self.low is not None:
                ok = ok & ((c > self.low) if self.strict else (c >= self.low))
            if self.high is not None:
                ok = ok & ((c < self.high) if self.strict else (c <= self.high))
        elif self.kind == "matches":
            ok = c.cast("string").rlike(self.pattern)
        elif self.kind == "in_set":
            ok = c.isin(list(self.values))
        else:
            raise ValueError(f"{self.kind} is not a row rule")
        return c.isNotNull() & ~ok


# Expectations per table.
SUITES: dict[str, list[Rule]] = {
    "transactions": [
        Rule("columns", values=("transaction_id", "user_id", "date", "category", "merchant", "mcc_code", "amount", "card_used")),
        Rule("not_null", "transaction_id"),
        Rule("not_null", "user_id"),
        Rule("not_null", "amount"),
        Rule("between", "amount", low=0, strict=True),
        Rule("between", "mcc_code", low=1000, high=9999),
        Rule("matches", "transaction_id", pattern=r"^txn_\d+$"),
        Rule("matches", "user_id", pattern=r"^user_\d{4,}$"),
        Rule("in_set", "category", values=tuple(dims.TXN_CATEGORIES)),
    ],
    "users": [
        Rule("columns", values=("user_id", "archetype", "monthly_budget", "cards", "redemption_preference", "age_group", "location_type")),
        Rule("not_null", "user_id"),
        Rule("unique", "user_id"),
        Rule("between", "monthly_budget", low=0, strict=True),
        Rule("in_set", "archetype", values=tuple(dims.ARCHETYPES)),
        Rule("in_set", "age_group", values=tuple(dims.AGE_GROUPS)),
        Rule("in_set", "location_type", values=tuple(dims.LOCATIONS)),
        Rule("in_set", "redemption_preference", values=tuple(dims.REDEMPTIONS)),
    ],
    "cards": [
        Rule("not_null", "card_id"),
        Rule("not_null", "card_name"),
        Rule("not_null", "issuer"),
        Rule("unique", "card_id"),
        Rule("between", "annual_fee", low=0, high=1000, mostly=0.95),
        Rule("not_null", "reward_rates"),
    ],
}


def run_suite(df: DataFrame, rules: Sequence[Rule], dataset: str) -> DataFrame:
    """One row per rule: rows evaluated, rows broken, pass flag.

    All row rules share one scan and one aggregate; each uniqueness rule is a count
    per value.  Column rules are settled from the schema.
    """
    spark = df.sparkSession
    rows = [r for r in rules if r.kind in ("not_null", "between", "matches", "in_set") and r.column in df.columns]
    out = None
    if rows:
        aggs = []
        for i, r in enumerate(rows):
            seen = F.lit(1) if r.kind == "not_null" else F.col(r.column)
            aggs.append(F.count(seen).alias(f"e{i}"))
            aggs.append(F.coalesce(F.sum(r.broken().cast("long")), F.lit(0)).alias(f"b{i}"))
        packed = F.array(
            *[
                F.struct(
                    F.lit(r.kind).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.mostly).alias("mostly"),
                    F.col(f"e{i}").alias("evaluated"), F.col(f"b{i}").alias("broken"),
                )
                for i, r in enumerate(rows)
            ]
        )
        out = df.agg(*aggs).select(F.inline(packed))
    for r in rules:
        if r.kind != "unique" or r.column not in df.columns:
            continue
        per = df.where(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("n"))
        u = per.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("broken")
        ).select(F.lit("unique").alias("rule"), F.lit(r.column).alias("column"), F.lit(1.0).alias("mostly"), "evaluated", "broken")
        out = u if out is None else out.unionByName(u)
    settled = []
    for r in rules:
        if r.kind == "columns":
            settled.append(("columns", "*", 1.0, 1, 0 if list(df.columns) == list(r.values) else 1))
        elif r.kind == "exists" or r.column not in df.columns:
            settled.append(("exists", r.column, 1.0, 1, 0 if r.column in df.columns else 1))
    if settled:
        s = spark.createDataFrame(settled, "rule string, column string, mostly double, evaluated long, broken long")
        out = s if out is None else out.unionByName(s)
    kept = F.when(F.col("evaluated") > 0, 1 - F.col("broken") / F.col("evaluated")).otherwise(F.lit(1.0))
    return out.select(
        F.lit(dataset).alias("dataset"), "rule", "column", "evaluated", "broken", (kept >= F.col("mostly")).alias("passed")
    )


def suite_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("evaluated_rules"),
        F.sum(F.col("passed").cast("long")).alias("successful_rules"),
        F.sum((~F.col("passed")).cast("long")).alias("failed_rules"),
        F.min("passed").alias("passed"),
    )


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """The frame itself, or an error that names what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks required columns: {', '.join(missing)}")
    return df


# ----------------------------------------------------------------------- row contracts


def transaction_reasons() -> Column:
    """Why a transaction row is refused; an empty array means it is accepted."""
    def bad(cond: Column, reason: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(reason))

    return F.array_compact(
        F.array(
            bad(~F.col("user_id").rlike(r"^user_\d+$"), "user_id"),
            bad(~F.col("transaction_id").startswith("txn_"), "transaction_id"),
            bad(~F.col("category").isin(dims.TXN_CATEGORIES), "category"),
            bad(~F.col("mcc_code").between(1000, 9999), "mcc_code"),
            bad(~(F.col("amount") > 0), "amount"),
        )
    )


def user_reasons() -> Column:
    def bad(cond: Column, reason: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.lit(reason))

    return F.array_compact(
        F.array(
            bad(~F.col("user_id").rlike(r"^user_\d+$"), "user_id"),
            bad(~F.col("archetype").isin(dims.ARCHETYPES), "archetype"),
            bad(~(F.col("monthly_budget") > 0), "monthly_budget"),
            bad(~F.col("redemption_preference").isin(dims.REDEMPTIONS), "redemption_preference"),
            bad(~F.col("age_group").isin(dims.AGE_GROUPS), "age_group"),
            bad(~F.col("location_type").isin(dims.LOCATIONS), "location_type"),
        )
    )


def split_rows(df: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; works on a stream as well."""
    d = df.withColumn("reject_reasons", reasons)
    return d.where(F.size("reject_reasons") == 0).drop("reject_reasons"), d.where(F.size("reject_reasons") > 0)


def table_checks(df: DataFrame, id_column: str, amount: str, date: str, as_of: str, low: float, high: float) -> DataFrame:
    """Duplicate ids, negative and out-of-range amounts, future dates, one row each."""
    per = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    dup = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicates").alias("check"), "n")
    a = F.col(amount)
    wide = df.agg(
        F.count(F.when(a < 0, 1)).alias("negative"),
        F.count(F.when((a < low) | (a > high), 1)).alias("out_of_range"),
        F.count(F.when(F.col(date) > F.lit(as_of).cast("date"), 1)).alias("future_dates"),
    )
    return dup.unionByName(wide.unpivot([], wide.columns, "check", "n"))


def null_shares(df: DataFrame, top: int | None = 10) -> DataFrame:
    """Share of nulls per column, largest first."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    long = wide.unpivot([], wide.columns, "column", "null_share")
    return long.orderBy(F.col("null_share").desc(), "column").limit(top) if top else long


# ---------------------------------------------------------------------------- anomalies


def graded(ratio: Column, warning: float, critical: float) -> Column:
    return F.when(ratio >= critical, F.lit("CRITICAL")).when(ratio >= warning, F.lit("WARNING"))


def missing_values(df: DataFrame, dataset: str, warning: float = 0.05, critical: float = 0.20) -> DataFrame:
    aggs = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    long = wide.unpivot(["__n"], list(df.columns), "column", "missing").withColumn("ratio", F.col("missing") / F.col("__n"))
    return _rows(long, dataset, "missing_values", graded(F.col("ratio"), warning, critical), F.col("missing"), F.col("ratio"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")


def outliers_iqr(
    df: DataFrame, dataset: str, columns: Sequence[str] | None = None, fence: float = 1.5, warning: float = 0.05, critical: float = 0.15
) -> DataFrame:
    """Columns with many values outside the quartile fences; the ratio counts all rows."""
    long = _long(df, columns or numeric_columns(df))
    q = ordered.quantiles(long, ["column"], "value", {"q1": 0.25, "q3": 0.75}).where("n_values >= 4 AND q3 <> q1")
    spread = (F.col("q3") - F.col("q1")) * fence
    q = q.withColumns({"lower": F.col("q1") - spread, "upper": F.col("q3") + spread})
    hit = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    found = long.join(F.broadcast(q), "column").groupBy("column").agg(
        F.count(F.when(hit, 1)).alias("k"), F.count(F.lit(1)).alias("n")
    )
    ratio = F.col("k") / F.col("n")
    return _rows(found, dataset, "outlier_iqr", graded(ratio, warning, critical), F.col("k"), ratio)


def outliers_zscore(
    df: DataFrame, dataset: str, columns: Sequence[str] | None = None, limit: float = 3.0, warning: float = 0.05, critical: float = 0.15
) -> DataFrame:
    """Columns with many values further than ``limit`` sample deviations from the mean."""
    long = _long(df, columns or numeric_columns(df))
    s = long.groupBy("column").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("c")
    ).where("c >= 2 AND s > 0")
    hit = F.abs((F.col("value") - F.col("m")) / F.col("s")) > limit
    found = long.join(F.broadcast(s), "column").groupBy("column").agg(F.count(F.when(hit, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    ratio = F.col("k") / F.col("n")
    return _rows(found, dataset, "outlier_zscore", graded(ratio, warning, critical), F.col("k"), ratio)


def schema_violations(df: DataFrame, dataset: str, required: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """Missing required columns and columns of another kind; ``observed`` counts the rows affected."""
    def kind(dt: T.DataType) -> str:
        if isinstance(dt, NUMERIC):
            return "numeric"
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        return "boolean" if isinstance(dt, T.BooleanType) else "string"

    have = {f.name: kind(f.dataType) for f in df.schema.fields}
    rows = [(dataset, "missing_column", c, "CRITICAL") for c in required if c not in have]
    rows += [(dataset, "dtype_mismatch", c, "WARNING") for c, k in kinds.items() if c in have and have[c] != k]
    found = df.sparkSession.createDataFrame(rows, "dataset string, check_name string, column string, severity string")
    count = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    return found.withColumn("observed", count).withColumn("ratio", F.lit(1.0))


def distribution_drift(
    reference: DataFrame, current: DataFrame, dataset: str, columns: Sequence[str], warning: float = 0.05, critical: float = 0.001
) -> DataFrame:
    """Columns whose distribution moved: ``observed`` is the KS statistic, ``ratio`` its p-value."""
    ks = drift.ks_test(reference, current, columns)
    sev = F.when(F.col("p_value") <= critical, F.lit("CRITICAL")).when(F.col("p_value") <= warning, F.lit("WARNING"))
    return _rows(ks, dataset, "distribution_drift", sev, F.col("ks_statistic"), F.col("p_value"))


def _rows(df: DataFrame, dataset: str, check: str, severity: Column, observed: Column, ratio: Column, column: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(dataset).alias("dataset"),
        F.lit(check).alias("check_name"),
        (column if column is not None else F.col("column")).alias("column"),
        severity.alias("severity"),
        observed.cast("double").alias("observed"),
        F.coalesce(ratio.cast("double"), F.lit(0.0)).alias("ratio"),
    ).where(F.col("severity").isNotNull())


def _inline(wide: DataFrame, dataset: str, checks: Sequence[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    """Anomaly rows out of a one-row aggregate: (check, column, severity, observed, ratio)."""
    packed = F.array(
        *[
            F.struct(
                F.lit(dataset).alias("dataset"), F.lit(c).alias("check_name"), F.lit(col).alias("column"), sev.alias("severity"),
                obs.cast("double").alias("observed"), F.coalesce(r.cast("double"), F.lit(0.0)).alias("ratio"),
            )
            for c, col, sev, obs, r in checks
        ]
    )
    return wide.select(F.inline(packed)).where(F.col("severity").isNotNull())


def _repeated(df: DataFrame, column: str) -> DataFrame:
    """One row: how many rows repeat an earlier value of the column, nulls included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup"))


def card_rule_details(df: DataFrame, order: str, named: int = 5) -> DataFrame:
    """check_name, count, max_value, card_names (the first ``named`` in ``order``) of the card rules that look at a value.

    Rules that no card breaks have no row; only the rule on reward rates names cards.
    """
    fee = F.col("annual_fee").try_cast("double")
    rules = [
        ("domain_reward_rate_too_high", F.col("base_reward_rate").cast("double"), 10.0, 2),
        ("domain_annual_fee_extreme", fee, 5000.0, 2),
        ("domain_welcome_bonus_roi_extreme", F.col("welcome_bonus_roi").cast("double"), 1.0, 4),
    ]
    wide = df.agg(*[x for i, (_, v, limit, _) in enumerate(rules) for x in (F.count(F.when(v > limit, 1)).alias(f"n{i}"), F.max(F.when(v > limit, v)).alias(f"m{i}"))])
    first = df.where(rules[0][1] > rules[0][2]).orderBy(order).limit(named)
    names = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("card_name").alias("c")))), lambda x: x["c"]).alias("c")).scalar()
    rows = [
        F.struct(F.lit(name).alias("check_name"), F.col(f"n{i}").alias("count"), F.round(f"m{i}", digits).alias("max_value"), (F.col("__names") if not i else F.array().cast("array<string>")).alias("card_names"))
        for i, (name, _, _, digits) in enumerate(rules)
    ]
    return wide.withColumn("__names", names).select(F.inline(F.array(*rows))).where(F.col("count") > 0)


def card_rules(df: DataFrame, dataset: str = "cards") -> DataFrame:
    """Rates over 10 %, fees over 5000, bonus worth more than the spend, retired cards, name copies."""
    n = F.count(F.lit(1))
    wide = df.agg(
        n.alias("n"),
        F.count(F.when(F.col("base_reward_rate") > 10, 1)).alias("rate"),
        F.count(F.when(F.col("annual_fee").try_cast("double") > 5000, 1)).alias("fee"),
        F.count(F.when(F.col("welcome_bonus_roi") > 1, 1)).alias("roi"),
        F.count(F.when(F.col("discontinued"), 1)).alias("gone"),
    )
    def share(c: str) -> Column:
        return F.col(c) / F.greatest(F.col("n"), F.lit(1))

    out = _inline(
        wide,
        dataset,
        [
            ("domain_reward_rate_too_high", "base_reward_rate", F.when(F.col("rate") > 0, F.lit("CRITICAL")), F.col("rate"), share("rate")),
            ("domain_annual_fee_extreme", "annual_fee", F.when(F.col("fee") > 0, F.lit("WARNING")), F.col("fee"), share("fee")),
            ("domain_welcome_bonus_roi_extreme", "welcome_bonus_roi", F.when(F.col("roi") > 0, F.lit("WARNING")), F.col("roi"), share("roi")),
            ("domain_high_discontinued_ratio", "discontinued", F.when(share("gone") > 0.20, F.lit("WARNING")), F.col("gone"), share("gone")),
        ],
    )
    dup = _inline(
        _repeated(df, "card_name"), dataset,
        [("domain_duplicate_card_names", "card_name", F.when(F.col("dup") > 0, F.lit("WARNING")), F.col("dup"), F.lit(0.0))],
    )
    return out.unionByName(dup)


def transaction_rules(df: DataFrame, as_of: str, dataset: str = "transactions", date: str = "txn_date") -> DataFrame:
    """High amounts, one dominant category, very active users, future dates, id copies."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("amount") > 10000, 1)).alias("high"),
        F.count(F.when(F.col(date) > F.lit(as_of).cast("date"), 1)).alias("future"),
    )
    high = F.col("high") / F.greatest(F.col("n"), F.lit(1))
    out = _inline(
        wide, dataset,
        [
            ("domain_high_value_concentration", "amount", F.when(high > 0.01, F.lit("WARNING")), F.col("high"), high),
            ("domain_future_dates_present", date, F.when(F.col("future") > 0, F.lit("CRITICAL")), F.col("future"), F.col("future") / F.greatest(F.col("n"), F.lit(1))),
        ],
    )
    cats = df.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("k"))
    cats = cats.agg(F.max("k").alias("k"), F.sum("k").alias("n"))
    share = F.col("k") / F.col("n")
    out = out.unionByName(
        _inline(cats, dataset, [("domain_category_imbalance", "category", F.when(share > 0.5, F.lit("WARNING")), F.col("k"), share)])
    )
    per = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    stats = per.agg(F.avg("k").alias("m"), F.stddev_samp("k").alias("s")).select(F.struct("m", "s").alias("x")).scalar()
    busy = per.withColumn("x", stats).agg(
        F.count(F.when((F.col("x.s") > 0) & (F.col("k") > F.col("x.m") + 3 * F.col("x.s")), 1)).alias("busy"), F.count(F.lit(1)).alias("n")
    )
    out = out.unionByName(
        _inline(busy, dataset, [("domain_user_transaction_outliers", "user_id", F.when(F.col("busy") > 0, F.lit("INFO")), F.col("busy"), F.col("busy") / F.col("n"))])
    )
    return out.unionByName(
        _inline(
            _repeated(df, "transaction_id"), dataset,
            [("domain_duplicate_transaction_ids", "transaction_id", F.when(F.col("dup") > 0, F.lit("CRITICAL")), F.col("dup"), F.lit(0.0))],
        )
    )


def user_rules(df: DataFrame, dataset: str = "users") -> DataFrame:
    """Budgets outside their archetype's range, id copies, unknown archetypes."""
    budget = F.coalesce(F.col("monthly_budget"), F.lit(0.0))
    odd = F.lit(False)
    for arch, (lo, hi) in dims.ARCHETYPE_BUDGET.items():
        odd = odd | ((F.col("archetype") == arch) & ~budget.between(lo, hi))
    known = F.coalesce(F.col("archetype").isin(dims.ARCHETYPES), F.lit(False))
    wide = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(odd, 1)).alias("odd"), F.count(F.when(~known, 1)).alias("unknown")
    )
    r = F.col("odd") / F.greatest(F.col("n"), F.lit(1))
    out = _inline(
        wide, dataset,
        [
            ("domain_budget_archetype_mismatch", "monthly_budget", F.when(r > 0.10, F.lit("CRITICAL")).when(F.col("odd") > 0, F.lit("WARNING")), F.col("odd"), r),
            ("domain_invalid_archetype", "archetype", F.when(F.col("unknown") > 0, F.lit("WARNING")), F.col("unknown"), F.col("unknown") / F.greatest(F.col("n"), F.lit(1))),
        ],
    )
    return out.unionByName(
        _inline(
            _repeated(df, "user_id"), dataset,
            [("domain_duplicate_user_ids", "user_id", F.when(F.col("dup") > 0, F.lit("CRITICAL")), F.col("dup"), F.lit(0.0))],
        )
    )


def unknown_archetypes(df: DataFrame, dataset: str = "users", k: int = 10) -> DataFrame:
    """The first ``k`` names outside the known archetypes, and how many rows have one."""
    odd = df.where(~F.coalesce(F.col("archetype").isin(dims.ARCHETYPES), F.lit(True)))
    names = odd.select("archetype").distinct().orderBy("archetype").limit(k).agg(F.sort_array(F.collect_list("archetype")).alias("v"))
    return odd.agg(F.count(F.lit(1)).alias("rows")).withColumn("examples", F.array_join(names.scalar(), ",")).select(F.lit(dataset).alias("dataset"), "rows", "examples")


def severity_level(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, v) for k, v in SEVERITY_LEVEL.items()], F.lit(0))


def anomaly_summary(rows: DataFrame) -> DataFrame:
    """Per dataset: anomalies by severity, the highest level, whether any is critical."""
    def count(s: str) -> Column:
        return F.sum((F.col("severity") == s).cast("long"))

    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("anomalies"),
        count("CRITICAL").alias("critical"),
        count("WARNING").alias("warning"),
        count("INFO").alias("info"),
        F.max(severity_level(F.col("severity"))).alias("max_level"),
        F.max(F.col("severity") == "CRITICAL").alias("has_critical"),
    )


def critical_gate(rows: DataFrame, enforce: bool = True) -> DataFrame:
    """One row: whether the run may go on."""
    crit = F.coalesce(F.sum((F.col("severity") == "CRITICAL").cast("long")), F.lit(0))
    return rows.agg(crit.alias("critical")).withColumn("passed", (F.col("critical") == 0) | F.lit(not enforce))


def alert_text(rows: DataFrame, top: int = 5) -> DataFrame:
    """One message per dataset: counts by severity and the first warnings.

    Anomaly rows number at most (checks x columns) per dataset.
    """
    line = F.format_string("  [%s] %s on %s: %.4f", "severity", "check_name", "column", "ratio")
    place = F.struct((-severity_level(F.col("severity"))).alias("l"), F.col("check_name"), F.col("column"), line.alias("line"))
    s = anomaly_summary(rows).drop("max_level", "has_critical")
    worst = (
        rows.where(severity_level(F.col("severity")) >= 2)
        .groupBy("dataset")
        .agg(F.array_sort(F.collect_list(place)).alias("w"))
    )
    d = s.join(worst, "dataset", "left").withColumn("w", F.coalesce("w", F.array().cast("array<struct<l:int,check_name:string,column:string,line:string>>")))
    head = F.format_string(
        "Dataset: %s\nAnomalies found: %d\n  CRITICAL: %d\n  WARNING:  %d\n  INFO:     %d",
        "dataset", "anomalies", "critical", "warning", "info",
    )
    tail = F.concat_ws(
        "\n",
        head,
        F.when(F.size("w") > 0, F.lit("Top issues:")),
        F.array_join(F.transform(F.slice("w", 1, top), lambda x: x["line"]), "\n"),
        F.when(F.size("w") > top, F.format_string("  ... and %d more", F.size("w") - top)),
    )
    return d.select("dataset", F.rtrim(tail).alias("message"))
