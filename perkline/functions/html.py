"""Card listings out of web pages with regular expressions on the page column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkline.functions.text import issuer_from_name

JSON_LD_ITEM = (
    "struct<`@type`:string,name:string,description:string,url:string,image:string,"
    "offers:struct<price:string>,aggregateRating:struct<ratingValue:string,reviewCount:string>>"
)
JSON_LD_BLOCK = "struct<`@type`:string,itemListElement:array<struct<item:string>>>"


def _first(s: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(s, pattern, group)
    return F.when(got != "", got)


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed, spaces collapsed."""
    s = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def heading(html: Column) -> Column:
    """Text of the first h2, else h3, h4, h1."""
    found = [_first(html, rf"(?is)<{h}[^>]*>(.*?)</{h}>") for h in ("h2", "h3", "h4", "h1")]
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(*found), r"<[^>]+>", ""), r"\s+", " "))


def absolute_url(href: Column, site: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(site, href)).when(href.startswith("http"), href)


def card_listing(html: Column, site: Column) -> Column:
    """struct(name, issuer, annual_fee, base_reward_rate, welcome_bonus, detail_url, image_url, n_links)."""
    text = page_text(html)
    low = F.lower(text)
    name = heading(html)
    fee = F.when(low.contains("no annual fee") | low.contains("$0 annual fee"), F.lit(0)).otherwise(
        _first(text, r"\$(\d+)").try_cast("int")
    )
    bonus = F.coalesce(
        _first(text, r"(?i)(\$[\d,]+|\d+[,\d]*\s*(?:points?|miles?))\s*(?:sign.?up|welcome|bonus)"),
        _first(text, r"(?i)(?:earn|get)\s+(\$[\d,]+|\d+[,\d]*)\s*(?:points?|miles?|bonus)?"),
    )
    return F.struct(
        name.alias("name"),
        issuer_from_name(name).alias("issuer"),
        fee.alias("annual_fee"),
        F.trim(_first(text, r"(?i)((\d+(?:\.\d+)?)\s*[%x]\s*(cash\s*back|points?|miles?)?)")).alias("base_reward_rate"),
        F.trim(bonus).alias("welcome_bonus"),
        absolute_url(_first(html, r"(?i)<a[^>]*\shref=\"([^\"]+)\""), site).alias("detail_url"),
        _first(html, r"(?i)<img[^>]*\ssrc=\"([^\"]+)\"").alias("image_url"),
        F.regexp_count(html, F.lit(r"(?i)<a[^>]*\shref=")).alias("n_links"),
    )


def json_ld_items(block: Column) -> Column:
    """Items of one JSON-LD block: those of a list, a product itself, or the objects of an item list.

    List elements that are addresses only, and blocks that don't parse, give nothing.
    """
    top = F.from_json(block, JSON_LD_BLOCK)
    listed = F.transform(top["itemListElement"], lambda e: F.from_json(F.when(F.ltrim(e["item"]).startswith("{"), e["item"]), JSON_LD_ITEM))
    return (
        F.when(block.rlike(r"^\s*\["), F.from_json(block, f"array<{JSON_LD_ITEM}>"))
        .when(top["@type"].isin("Product", "CreditCard"), F.array(F.from_json(block, JSON_LD_ITEM)))
        .otherwise(listed)
    )


def json_ld_cards(html: Column) -> Column:
    """array<struct> of named product items in the page's JSON-LD blocks."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    as_list = F.filter(F.transform(blocks, json_ld_items), lambda a: a.isNotNull())
    named = F.filter(F.flatten(as_list), lambda i: (i["name"] != "") & i["@type"].rlike("Product|CreditCard|FinancialProduct"))
    return F.transform(
        named,
        lambda i: F.struct(
            i["name"].alias("name"), issuer_from_name(i["name"]).alias("issuer"), i["description"].alias("description"), i["url"].alias("detail_url"),
            i["image"].alias("image_url"), F.regexp_extract(i["offers"]["price"], r"(\d+(?:\.\d+)?)", 1).try_cast("double").alias("annual_fee"),
            i["aggregateRating"]["ratingValue"].alias("rating"), i["aggregateRating"]["reviewCount"].alias("review_count"),
        ),
    )
