"""Fitted scalers and encoders whose parameters are a small table.

Fitting is one aggregate; the parameters are rows (dataset, column, method, stat, text,
num) that can be written as Parquet and read back.  Applying them is a projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline.operators import ordered

MISSING = "<MISSING>"
UNKNOWN = "<UNKNOWN>"
PARAM_SCHEMA = "dataset string, column string, method string, position int, text string, num double"


@dataclass(frozen=True)
class Plan:
    """Columns per method; configured columns a table lacks are skipped."""

    standard: Sequence[str] = ()
    minmax: Sequence[str] = ()
    onehot: Sequence[str] = ()
    label: Sequence[str] = ()

    def within(self, columns: Sequence[str]) -> "Plan":
        have = set(columns)
        return Plan(*[[c for c in cols if c in have] for cols in (self.standard, self.minmax, self.onehot, self.label)])


def fit(df: DataFrame, plan: Plan, dataset: str) -> DataFrame:
    """Parameter rows: mean and population deviation, min and max, sorted categories."""
    p = plan.within(df.columns)
    parts = []
    stats = []
    for c in p.standard:
        stats += [(c, "standard", 0, F.avg(c)), (c, "standard", 1, F.stddev_pop(c))]
    for c in p.minmax:
        stats += [(c, "minmax", 0, F.min(c)), (c, "minmax", 1, F.max(c))]
    if stats:
        wide = df.agg(*[e.cast("double").alias(f"s{i}") for i, (_, _, _, e) in enumerate(stats)])
        rows = F.array(
            *[
                F.struct(
                    F.lit(dataset).alias("dataset"), F.lit(c).alias("column"), F.lit(m).alias("method"), F.lit(pos).alias("position"),
                    F.lit(None).cast("string").alias("text"), F.col(f"s{i}").alias("num"),
                )
                for i, (c, m, pos, _) in enumerate(stats)
            ]
        )
        parts.append(wide.select(F.inline(rows)))
    coded = [(c, "onehot") for c in p.onehot] + [(c, "label") for c in p.label]
    if coded:
        pairs = F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("text"))
                    for c, m in coded
                ]
            )
        )
        seen = df.select(pairs.alias("p")).select("p.*").distinct()
        seen = ordered.range_chunk(seen, "text", "__range")
        placed = ordered.row_index(seen, ["column", "method"], F.col("__range"), [F.col("text")], "i")
        parts.append(
            placed.select(
                F.lit(dataset).alias("dataset"), "column", "method", (F.col("i") - 1).cast("int").alias("position"), "text",
                F.lit(None).cast("double").alias("num"),
            )
        )
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def collect_params(params: DataFrame, dataset: str, most_columns: int = 10_000) -> dict:
    """Parameters of the methods that shape columns: two numbers, or the names of one-hot columns.

    Label codes stay a table, see :func:`label_join`.  More than ``most_columns`` rows are
    an error, as each would become a column; :func:`onehot_sparse` takes any number.
    """
    rows = params.where((F.col("dataset") == dataset) & (F.col("method") != "label")).limit(most_columns + 1).collect()
    if len(rows) > most_columns:
        raise ValueError(f"{dataset} would get more than {most_columns} columns; use onehot_sparse")
    book: dict = {}
    for r in sorted(rows, key=lambda r: (r["column"], r["method"], r["position"])):
        book.setdefault((r["column"], r["method"]), []).append(r["text"] if r["text"] is not None else r["num"])
    return book


def scaled(value: Column, shift: float, spread: float) -> Column:
    return (value - F.lit(shift)) / F.lit(spread if spread else 1.0)


def transform(df: DataFrame, params: Mapping) -> DataFrame:
    """Apply fitted parameters; encoded columns stand where the original stood."""
    cols: list[Column] = []
    for c in df.columns:
        v = F.col(c)
        if (c, "standard") in params:
            m, s = params[(c, "standard")]
            cols.append((scaled(v, m, s) if m is not None else v.cast("double")).alias(c))
        elif (c, "minmax") in params:
            lo, hi = params[(c, "minmax")]
            cols.append((scaled(v, lo, hi - lo) if lo is not None else v.cast("double")).alias(c))
        elif (c, "onehot") in params:
            text = F.coalesce(v.cast("string"), F.lit(MISSING))
            cols += [(text == F.lit(k)).cast("int").alias(f"{c}_{k}") for k in params[(c, "onehot")]]
        else:
            cols.append(v)
    return df.select(*cols)


def _classes(params: DataFrame, dataset: str, column: str, method: str = "label") -> DataFrame:
    chosen = params.where((F.col("dataset") == dataset) & (F.col("column") == column) & (F.col("method") == method))
    return chosen.select(F.col("text").alias("__t"), F.col("position").alias("__code"))


def label_join(df: DataFrame, params: DataFrame, dataset: str, column: str) -> DataFrame:
    """Label codes for a column of any cardinality, as a join with the class table; -1 for unknown."""
    d = df.withColumn("__t", F.coalesce(F.col(column).cast("string"), F.lit(MISSING)))
    return d.join(_classes(params, dataset, column), "__t", "left").withColumn(column, F.coalesce("__code", F.lit(-1))).drop("__t", "__code")


def onehot_sparse(df: DataFrame, params: DataFrame, dataset: str, column: str, out: str) -> DataFrame:
    """``out`` struct(size, position): the place of the one in a one-hot vector of ``size``, null where the category is unknown.

    The categories stay a table and meet the rows in a join, so their number is free.  Each
    has one row there, and a hash join holds those only: rows of a common category, such as
    the missing one, stream past and are never sorted.
    """
    classes = _classes(params, dataset, column, "onehot").hint("shuffle_hash")
    size = classes.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = df.withColumn("__t", F.coalesce(F.col(column).cast("string"), F.lit(MISSING))).join(classes, "__t", "left")
    return d.withColumn(out, F.struct(size.alias("size"), F.col("__code").alias("position"))).drop("__t", "__code")


def inverse_label(df: DataFrame, params: DataFrame, dataset: str, column: str, code: str, out: str) -> DataFrame:
    """The class behind each code, as a join; unknown codes give ``<UNKNOWN>``."""
    found = _classes(params, dataset, column)
    return df.join(found, F.col(code) == F.col("__code"), "left").withColumn(out, F.coalesce("__t", F.lit(UNKNOWN))).drop("__t", "__code")
