"""String functions on card, issuer, merchant and explanation text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkline import dims


def title_case(s: Column) -> Column:
    """Capital after every non-letter, the rest lower, as in ``Chili'S``."""
    pieces = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def clean_card_name(name: Column, acronyms: Mapping[str, str] = dims.ACRONYMS) -> Column:
    s = F.regexp_replace(name, "[®™℠©]", "")
    s = F.regexp_replace(s, r"(?i)\s*credit\s*card\s*$", "")
    s = title_case(F.trim(F.regexp_replace(s, r"\s+", " ")))
    for wrong, right in acronyms.items():
        s = F.replace(s, F.lit(wrong), F.lit(right))
    return F.coalesce(s, F.lit(""))


def standard_issuer(issuer: Column, aliases: Mapping[str, str] = dims.ISSUER_ALIASES) -> Column:
    s = F.regexp_replace(F.trim(F.replace(F.upper(issuer), F.lit("_"), F.lit(" "))), r"\s+", " ")
    if aliases:
        book = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
        s = F.coalesce(
            F.try_element_at(book, s), F.try_element_at(book, F.replace(s, F.lit(" "), F.lit(""))), s
        )
    return F.coalesce(s, F.lit("UNKNOWN"))


def filled(sentence: str, **values: Column) -> Column:
    """A fixed sentence with its ``{places}`` filled by columns; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", sentence)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def _group(s: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(s, pattern, group)
    return F.when(found != "", found)


def _number(s: Column) -> Column:
    return F.regexp_replace(s, ",", "").try_cast("long")


def parse_welcome_bonus(bonus: Column) -> Column:
    """struct(amount, unit, spend_requirement, time_days, raw_text) out of offer text."""
    text = F.lower(bonus)
    cash_first = _number(_group(text, dims.BONUS_CASH_FIRST, 1))
    counted = _number(_group(text, dims.BONUS_COUNTED, 1))
    counted_unit = _group(text, dims.BONUS_COUNTED, 2)
    cash_any = _number(_group(text, dims.BONUS_CASH, 1))
    unit = (
        F.when(cash_first.isNotNull(), F.lit("dollars"))
        .when(
            counted.isNotNull(),
            F.when(counted_unit.contains("mile"), F.lit("miles"))
            .when(counted_unit.contains("dollar"), F.lit("dollars"))
            .otherwise(F.lit("points")),
        )
        .when(cash_any.isNotNull(), F.lit("dollars"))
        .otherwise(F.lit("points"))
    )
    count = _group(text, dims.BONUS_TIME, 1).try_cast("long")
    span = _group(text, dims.BONUS_TIME, 2)
    return F.struct(
        F.coalesce(cash_first, counted, cash_any).alias("amount"),
        unit.alias("unit"),
        _number(_group(text, dims.BONUS_SPEND, 1)).alias("spend_requirement"),
        (count * F.when(span == "month", 30).when(span == "week", 7).otherwise(1)).alias("time_days"),
        F.when(bonus != "", bonus).alias("raw_text"),
    )


def dedup_key(s: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def merge_key(*names: Column) -> Column:
    """First non-empty of ``names``, trimmed, lower, single spaces."""
    first = F.coalesce(*[F.when(n != "", n) for n in names], F.lit(""))
    return F.regexp_replace(F.trim(F.lower(first)), r"\s+", " ")


def slug(s: Column) -> Column:
    out = F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit("unknown_card")).otherwise(out)


def parse_rate(raw: Column) -> Column:
    """'1.5%', '2x' or '3' as a rate within [0, 10], else null."""
    cleaned = F.regexp_replace(F.lower(F.trim(raw)), "[%x]", "")
    value = _group(cleaned, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    value = F.when(cleaned.startswith("-") & F.coalesce(cleaned.try_cast("double") < 0, F.lit(False)), F.lit(None)).otherwise(value)
    return F.when(value.between(0, 10), value)


def money(raw: Column) -> Column:
    """'$1,250' as a number, anything else null."""
    return F.trim(F.regexp_replace(raw, "[$,]", "")).try_cast("double")


def numeric_like(raw: Column) -> Column:
    """Digits, dot and minus only, then a number or null."""
    return F.regexp_replace(raw.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def reward_rate_phrases(text: Column, phrases: Sequence[tuple[str, str]] = dims.RATE_PHRASES) -> Column:
    """array<struct<category, rate, type>>; a category named twice keeps its last rate."""
    found = []
    for pattern, kind in phrases:
        rates = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        cats = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        found.append(
            F.transform(
                F.arrays_zip(rates.alias("r"), cats.alias("c")),
                lambda z: F.struct(
                    F.regexp_replace(F.lower(F.trim(z["c"])), r"\s+", " ").alias("category"),
                    z["r"].cast("double").alias("rate"),
                    F.length(F.trim(z["c"])).alias("raw_length"),
                    F.lit(kind).alias("type"),
                ),
            )
        )
    every = F.concat(*found)
    kept = F.filter(every, lambda e: (e["category"] != "") & (e["raw_length"] <= 30))
    # Sorted by category, the last mention first; so one look at the neighbour settles each.
    ordered = F.sort_array(F.transform(kept, lambda e, i: F.struct(e["category"].alias("category"), (-i).alias("back"), e["rate"].alias("rate"), e["type"].alias("type"))))
    last = F.flatten(F.transform(F.array(ordered), lambda o: F.filter(o, lambda x, k: ~x["category"].eqNullSafe(F.get(o, k - 1)["category"]))))
    placed = F.sort_array(F.transform(last, lambda e: F.struct((-e["back"]).alias("i"), e["category"].alias("category"), e["rate"].alias("rate"), e["type"].alias("type"))))
    return F.transform(placed, lambda e: F.struct(e["category"].alias("category"), e["rate"].alias("rate"), e["type"].alias("type")))


# Issuer by name fragment, first hit wins.
ISSUER_FRAGMENTS = [
    ("chase", "Chase"),
    ("american express", "American Express"),
    ("amex", "American Express"),
    ("citi", "Citi"),
    ("capital one", "Capital One"),
    ("discover", "Discover"),
    ("bank of america", "Bank of America"),
    ("wells fargo", "Wells Fargo"),
    ("barclays", "Barclays"),
    ("u.s. bank", "U.S. Bank"),
    ("us bank", "U.S. Bank"),
]


def issuer_from_name(name: Column, fragments: Sequence[tuple[str, str]] = ISSUER_FRAGMENTS) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in fragments])


def bonus_text(amount: Column, spend: Column, days: Column) -> Column:
    """'70,000 bonus after $5,000 spend in 180 days', empty parts left out."""
    parts = F.concat_ws(
        " ",
        F.when(amount > 0, F.concat(F.format_number(F.floor(amount), 0), F.lit(" bonus"))),
        F.when(spend > 0, F.concat(F.lit("after $"), F.format_number(F.floor(spend), 0), F.lit(" spend"))),
        F.when(days > 0, F.concat(F.lit("in "), F.floor(days).cast("string"), F.lit(" days"))),
    )
    return F.when(parts != "", parts)


def anonymous_id(user_id: Column) -> Column:
    return F.substring(F.sha2(user_id, 256), 1, 12)


def prompt_fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


# ------------------------------------------------------------------- readability


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_measures(text: Column) -> Column:
    """struct(length, words, grade): grade counts vowels per word, at least one each.

    The syllables of all words add up to the vowels of the text plus one for every
    word without a vowel, so the text is scanned whole and never cut into words.
    """
    low = F.lower(text)
    words = _count(text, r"\S+")
    n = F.greatest(words, F.lit(1))
    sentences = F.greatest(_count(text, r"[.!?]"), F.lit(1))
    vowels = F.length(low) - F.length(F.translate(low, "aeiou", ""))
    syllables = vowels + _count(low, r"(?<!\S)[^\saeiou]++(?!\S)")
    return F.struct(
        F.length(text).alias("length"),
        words.alias("words"),
        (0.39 * (n / sentences) + 11.8 * (syllables / n) - 15.59).alias("grade"),
    )


def reading_ease(text: Column, min_ease: float = 50.0, max_grade: float = 10.0, digits: int = 2) -> Column:
    """struct(ease, grade, passed): syllables are vowel runs, a final silent e not counted.

    Over the whole text that is all vowel runs, less one for each word that ends in e
    after an earlier run, plus one for each word without a vowel.
    """
    low = F.lower(text)
    word, cons = "[a-z0-9']", "[b-df-hj-np-tv-xz0-9']"
    n = F.greatest(_count(text, r"[A-Za-z0-9']+"), F.lit(1))
    sentences = F.greatest(_count(text, r"[^.!?]*[^.!?\s][^.!?]*"), F.lit(1))
    silent = _count(low, f"(?<!{word}){cons}*+[aeiouy]++{cons}++{word}*+(?<=e)")
    flat = _count(low, f"(?<!{word}){cons}++(?!{word})")
    total = F.greatest(_count(low, "[aeiouy]+") - silent + flat, F.lit(1))
    ease = 206.835 - 1.015 * (n / sentences) - 84.6 * (total / n)
    grade = 0.39 * (n / sentences) + 11.8 * (total / n) - 15.59
    return F.struct(
        F.round(ease, digits).alias("ease"),
        F.round(grade, digits).alias("grade"),
        ((ease >= min_ease) & (grade <= max_grade)).alias("passed"),
    )


def claim_check(text: Column, multipliers: Column, amounts: Column, min_score: float = 0.95, tolerance: float = 1e-2) -> Column:
    """struct(total, supported, score, passed) of 'Nx' and '$N' claims against context values."""
    xs = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(\d+(?:\.\d+)?)x\b"), F.lit(1)), lambda s: s.cast("double"))
    ds = F.transform(F.regexp_extract_all(text, F.lit(r"\$\s*(\d+(?:\.\d+)?)\b"), F.lit(1)), lambda s: s.cast("double"))

    def grounded(claims: Column, valid: Column) -> Column:
        return F.size(F.filter(claims, lambda c: F.exists(valid, lambda v: F.abs(v - c) <= tolerance)))

    total = F.size(xs) + F.size(ds)
    supported = grounded(xs, multipliers) + grounded(ds, amounts)
    score = F.when(total == 0, F.lit(1.0)).otherwise(supported / total)
    return F.struct(total.alias("total"), supported.alias("supported"), score.alias("score"), (score >= min_score).alias("passed"))


def quality_flags(
    summary: Column, rationale: Column, pros: Column, cons: Column, card_name: Column, best_rate: Column,
    max_chars: int = 800, min_points: int = 2,
) -> Column:
    """struct of four checks: length, relevance, two pros and cons, no impossible multiplier."""
    joined = F.concat_ws(" ", summary, F.concat_ws(" ", rationale))
    size = F.length(summary) + F.aggregate(rationale, F.lit(0), lambda acc, r: acc + F.length(r))
    named = F.when(F.coalesce(card_name, F.lit("")) == "", F.lit(True)).otherwise(F.lower(joined).contains(F.lower(card_name)))
    claims = F.transform(F.regexp_extract_all(F.lower(joined), F.lit(r"\b(\d{1,2})x\b"), F.lit(1)), lambda s: s.cast("int"))
    return F.struct(
        (size <= max_chars).alias("length_ok"),
        ((F.size(rationale) >= min_points) & named).alias("relevance_ok"),
        ((F.size(pros) == 2) & (F.size(cons) == 2)).alias("pros_cons_ok"),
        F.when(best_rate.isNull(), F.lit(True)).otherwise(F.forall(claims, lambda m: m <= best_rate)).alias("hallucination_guard_ok"),
    )


def quality_score(checks: Column) -> Column:
    """Share of passed checks of a map<string, boolean>, three decimals."""
    vals = F.map_values(checks)
    n = F.size(vals)
    return F.when(n > 0, F.round(F.size(F.filter(vals, lambda v: v)) / n, 3)).otherwise(F.lit(0.0))
