"""Quality rules on whole texts and on lines that many documents of one host share.

Only DataFrame functions: no Python runs on the executors.  Within a text, arrays are
sorted and neighbours compared, so a very long text costs n log n.  Across documents,
each document gives one row per distinct normalised line, counted per host and line with
partial sums, and only lines above the limit are joined back.  Line rows (hashes and sizes)
are written once, as both of these read them.

A null text is an empty one.  A null host is a host of its own.  Rows that repeat a
document count as documents of their own and get the same verdict.  An empty table gives
no rows.  Columns other than doc_id, text and the host column are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline.llm import shared

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate in more documents of its host than this ...
LIMIT_DOCS = 20
#: ... and than this share of the host's documents.
LIMIT_SHARE = 0.005
#: A document is depleted if a smaller share of its word characters is left.
LEAST_LEFT = 0.5
#: Spaces, digits and ASCII punctuation count as one blank in a normalised line.
BLANKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def normalised(line: Column) -> Column:
    """Letters in lower case (A-Z), everything between them one blank; the raw line if it has no letters."""
    plain = F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), BLANKS, " "))
    return F.when(plain != "", plain).otherwise(F.trim(line))


def base_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    raw = docs.select("doc_id", F.col(f"`{host}`").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    cut = raw.withColumn("words", F.filter(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), lambda w: w != ""))
    cut = cut.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != ""))
    at = F.sequence(F.lit(0), F.size("words") - 3)
    windows = cut.withColumn(
        "windows",
        F.when(F.size("words") > 3, F.transform(at, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))),
    )
    found = windows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    found = found.withColumn("twice", F.filter("ordered", lambda x, i: (x["h"] == F.get("ordered", i - 1)["h"]) | (x["h"] == F.get("ordered", i + 1)["h"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))
    n_words = F.size("words").cast("long")
    measured = found.select(
        "doc_id",
        "host",
        "text",
        n_words.alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def line_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, text_key, host, line (hash), chars, first (1 for the first row of a line in its document)."""
    raw = docs.select("doc_id", F.col(f"`{host}`").alias("host"), "text", F.xxhash64("text").alias("text_key"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    hashed = raw.select("doc_id", "text_key", "host", F.sort_array(F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), word_chars(x).alias("chars")))).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), F.when(x["line"] == F.get("lines", i - 1)["line"], 0).otherwise(1).alias("first")))
    return hashed.select("doc_id", "text_key", "host", F.inline(marked))


def frequent_lines(rows: DataFrame, docs: DataFrame, host: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE) -> DataFrame:
    """host, line, line_docs for the lines in more documents of a host than its limit."""
    sizes = docs.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    counts = rows.groupBy("host", "line").agg(F.sum("first").alias("line_docs")).filter(F.col("line_docs") > limit_docs)
    over = counts.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host")))
    return over.filter(F.col("line_docs") > limit_share * F.col("host_docs")).select("c.host", "line", "line_docs")


def judge(docs: DataFrame, host: str = "source", limit_docs: int = LIMIT_DOCS, limit_share: float = LIMIT_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The base measures with chars_removed (in frequent lines) and kept.

    A document is kept if it passes the base rules and at least ``least_left`` of its word
    characters stand in lines under the limits of its host.
    """
    rows = shared.stored(line_rows(docs, host), "line-rows")  # read by the count and by the join
    frequent = frequent_lines(rows, docs, host, limit_docs, limit_share).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    hit = rows.join(frequent, rows["host"].eqNullSafe(frequent["f_host"]) & (rows["line"] == frequent["f_line"]), "inner")
    # Repeated rows of a document add up here, and their own count takes it out again.
    same = F.struct("doc_id", "text_key", "host").alias("own")
    copies = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col(f"`{host}`").alias("host")).select(same)
    removed = hit.select(same, "chars").unionByName(copies.select("own", F.lit(None).cast("long").alias("chars")))
    per_doc = removed.groupBy("own").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("chars").isNull(), 1).otherwise(0)).alias("copies"))
    per_doc = per_doc.filter(F.col("chars").isNotNull()).select(
        F.col("own.doc_id").alias("r_id"), F.col("own.text_key").alias("r_key"), F.col("own.host").alias("r_host"), (F.col("chars") / F.col("copies")).cast("long").alias("chars_removed")
    )
    base = base_measures(docs, host).withColumn("text_key", F.when(F.col("text") == "", F.lit(None).cast("long")).otherwise(F.xxhash64("text"))).drop("text")
    out = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["r_id"]) & (base["text_key"] == per_doc["r_key"]) & base["host"].eqNullSafe(per_doc["r_host"]), "left")
    gone = F.coalesce("chars_removed", F.lit(0).cast("long"))
    left = F.col("word_chars") - gone >= least_left * F.col("word_chars")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & left).alias("kept"), gone.alias("chars_removed")
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice WHERE n > 1) GROUP BY r),
sizes AS (SELECT r, count(*) AS n FROM w GROUP BY r),
raw AS (SELECT r, source, unnest(string_split(t, chr(10))) AS x FROM d),
l AS (SELECT r, source, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '{BLANKS}', ' ', 'g')) AS y FROM raw),
ln AS (SELECT r, source, x, chars, CASE WHEN y <> '' THEN y ELSE trim(x) END AS y FROM l WHERE chars > 0),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY r),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
often AS (SELECT c.source, c.y FROM (SELECT source, y, count(DISTINCT r) AS n FROM ln GROUP BY source, y) c
    JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n > {LIMIT_DOCS} AND c.n > {LIMIT_SHARE} * h.n),
gone AS (SELECT ln.r, sum(ln.chars) AS n FROM ln JOIN often o ON o.source IS NOT DISTINCT FROM ln.source AND o.y = ln.y GROUP BY ln.r),
m AS (SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS chars_removed
    FROM d LEFT JOIN sizes s USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars - chars_removed >= {LEAST_LEFT} * word_chars AS kept, chars_removed FROM f
"""
