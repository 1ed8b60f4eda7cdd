"""Customer-facing texts built from scored rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkline import dims
from perkline.functions.text import filled


def plain_number(x: Column) -> Column:
    """Shortest decimal text: 4.0 -> '4', 1.5 -> '1.5'."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")


def reward_highlights(bonuses: Column, base_rate: Column, annual_fee: Column, limit: int = 4) -> Column:
    """Bonus lines by rate, then the base line, then the no-fee line."""
    best_first = F.array_sort(
        F.transform(F.map_entries(bonuses), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))
    )
    lines = F.transform(best_first, lambda e: F.concat(plain_number(-e["neg"]), F.lit("x "), e["key"]))
    base = F.when(
        base_rate > 0,
        F.concat(plain_number(base_rate), F.when(F.size(bonuses) > 0, F.lit("% on everything else")).otherwise(F.lit("% on everything"))),
    )
    extra = F.array_compact(F.array(base, F.when(annual_fee == 0, F.lit("No annual fee"))))
    return F.slice(F.concat(lines, extra), 1, limit)


def card_explanation(
    name: Column, rank: Column, rate: Column, savings: Column, category: Column, personas: Column, boost: Column
) -> Column:
    say, earned = dims.CARD_TEXTS, {"name": name, "rate": rate_text(rate), "category": category, "money": money_text(savings)}
    tail = F.when((boost > 1) & (F.size(personas) > 0), filled(say["boosted"], personas=F.concat_ws(", ", personas))).otherwise(F.lit(""))
    return F.concat(F.when(rank == 1, filled(say["first"], **earned)).otherwise(filled(say["other"], **earned)), tail)


def template_explanation(category: Column, bonus_rate: Column, base_rate: Column) -> Column:
    """Line on the user's largest category that the card has a bonus for, else on its base rate."""
    say = dims.CARD_TEXTS
    plain = filled(say["template_base"], rate=F.format_string("%.1f", base_rate))
    return F.coalesce(filled(say["template_bonus"], category=category, rate=F.format_string("%.1f", bonus_rate)), plain)


def rate_text(rate: Column) -> Column:
    return F.concat(plain_number(rate), F.when(rate >= 1, F.lit("x")).otherwise(F.lit("%")))


def money_text(x: Column) -> Column:
    """Whole dollars from one dollar up, cents below."""
    return F.when(x >= 1, F.concat(F.lit("$"), F.format_number(F.round(x, 0), 0))).otherwise(F.format_string("$%.2f", x))


def pros_and_cons(
    highlights: Column, rate: Column, annual_fee: Column, savings: Column, category: Column, missing_category: Column, missing_count: Column
) -> tuple[Column, Column]:
    """Exactly two arguments for and two against a card."""
    say = dims.CARD_TEXTS
    has_bonus = F.exists(
        highlights, lambda h: ~F.lower(h).contains("everything") & (F.lower(h).contains("x ") | h.contains("%"))
    )
    fee = F.concat(F.lit("$"), F.format_number(annual_fee, 0))
    pro1 = F.when(has_bonus, filled(say["pro_bonus"], highlight=F.element_at(highlights, 1))).otherwise(filled(say["pro_flat"], rate=rate_text(rate)))
    pro2 = (
        F.when(annual_fee == 0, F.lit(say["pro_no_fee"]))
        .when(savings > annual_fee, filled(say["pro_offset"], money=money_text(savings), fee=fee))
        .otherwise(filled(say["pro_reward"], money=money_text(savings)))
    )
    con1 = F.when(annual_fee > 0, filled(say["con_fee"], fee=fee)).when(has_bonus, F.lit(say["con_base"])).otherwise(F.lit(say["con_flat"]))
    place = F.when(missing_count > 1, F.lit("#2")).otherwise(F.lit(""))
    con2 = (
        F.when(has_bonus & missing_category.isNotNull(), filled(say["con_missing"], category=missing_category, place=place))
        .when(has_bonus, F.lit(say["con_points"]))
        .otherwise(F.lit(say["con_other"]))
    )
    return F.array(pro1, pro2), F.array(con1, con2)


def best_for(personas: Column, has_bonus: Column, category: Column) -> Column:
    say, label = dims.CARD_TEXTS, F.initcap(F.concat_ws(", ", personas))
    return (
        F.when((F.size(personas) > 0) & has_bonus, filled(say["for_focus"], personas=label, category=category))
        .when(F.size(personas) > 0, filled(say["for_flat"], personas=label))
        .when(has_bonus, filled(say["for_category"], category=category))
        .otherwise(F.lit(say["for_everyday"]))
    )
