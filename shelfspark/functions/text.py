"""Text expressions: word lists, rule matching, names and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import rules


def strip(text: Column) -> Column:
    """Cut blanks of any script from both ends (``trim`` knows the plain space only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    """Split on any blank and drop the empty pieces."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(F.coalesce(text, F.lit("")))))


def word_overlap(query: Column, name: Column, brand: Column) -> Column:
    """Share of the query's words found in name or brand, scaled to 0.4 .. 0.9."""
    asked = word_set(query)
    known = F.array_union(word_set(name), word_set(brand))
    shared = F.size(F.array_intersect(asked, known))
    share = shared / F.greatest(F.size(asked), F.lit(1))
    return F.least(F.lit(0.9), F.lit(0.4) + share * F.lit(0.5))


def keyword_patterns(query: Column) -> Column:
    """ILIKE patterns of a query: the whole text and its first two words of two letters or more.

    ``%`` and ``_`` typed by the user stay live wildcards.
    """
    long_words = F.filter(words(query), lambda w: F.length(w) > 1)
    first = F.coalesce(F.get(long_words, F.lit(0)), query)
    second = F.coalesce(F.get(long_words, F.lit(1)), first)
    wrap = lambda c: F.concat(F.lit("%"), c, F.lit("%"))
    return F.struct(wrap(query).alias("term"), wrap(first).alias("word1"), wrap(second).alias("word2"))


def first_matching(text: Column, pattern_rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule whose patterns occur in the text, in declared order."""
    cases = [
        F.when(text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(label))
        for label, patterns in pattern_rules
    ]
    return F.coalesce(*cases)


def detect_brand(name: Column) -> Column:
    return first_matching(name, rules.BRAND_PATTERNS)


def detect_brand_longest(name: Column, brands: list[str] | None = None) -> Column:
    """Brand whose literal spelling occurs in the name; longer spellings are tried first."""
    ordered = sorted(brands or rules.LITERAL_BRANDS, key=len, reverse=True)
    return first_matching(name, [(b, [re.escape(b)]) for b in ordered])


def detect_chain(name: Column, other_name: Column) -> Column:
    return F.coalesce(first_matching(name, rules.CHAIN_PATTERNS), first_matching(other_name, rules.CHAIN_PATTERNS))


def classify_category(name: Column, store_category: Column) -> Column:
    """Category path by keyword (plain substring, so "ring" also hits "spring"), else by store category."""
    lowered = F.lower(F.coalesce(name, F.lit("")))
    by_word = []
    for path, keywords in rules.CATEGORY_KEYWORDS:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | lowered.contains(keyword)
        by_word.append(F.when(hit, F.lit(path)))
    by_store = [
        F.when(F.lower(store_category) == category, F.lit(path))
        for category, path in rules.STORE_CATEGORY_FALLBACK
    ]
    return F.coalesce(*by_word, *by_store)


def store_category_by_voucher(types: Column, style_type: str, dining_type: str) -> Column:
    """Store category from the voucher types: style before dining, anything else retail, none other."""
    return (
        F.when(F.coalesce(F.size(types), F.lit(0)) <= 0, "other")
        .when(F.array_contains(types, style_type), "retail")
        .when(F.array_contains(types, dining_type), "restaurant")
        .otherwise("retail")
    )


def store_category_by_name(categories: Column) -> Column:
    """Store category from the first partner category name."""
    first = strip(F.get(categories, F.lit(0)))
    cases = [F.when(first == name, F.lit(category)) for name, category in rules.PARTNER_CATEGORY_MAP]
    return F.coalesce(*cases, F.lit("other"))


def expand_city(city: Column, buckets: list[tuple[list[str], list[str]]] | None = None) -> Column:
    """The typed city followed by its regional buckets; blank gives an empty list."""
    entries = []
    for targets, spellings in buckets or rules.CITY_BUCKETS:
        for spelling in spellings:
            entries += [F.lit(spelling), F.array(*[F.lit(t) for t in targets])]
    lookup = F.create_map(*entries)
    key = strip(F.lower(city))
    bare = F.when(key.startswith(rules.CITY_PREFIX), strip(F.substring(key, 2, 1_000)))
    found = F.coalesce(F.try_element_at(lookup, key), F.try_element_at(lookup, bare))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(key, F.lit("")) == "", none).otherwise(
        F.array_distinct(F.concat(F.array(city), F.coalesce(found, none)))
    )


def city_from_address(address: Column) -> Column:
    """Text after the last comma when it looks like a city: no digit, 1 to 30 characters."""
    tail = strip(F.substring_index(address, ",", -1))
    usable = address.contains(",") & ~tail.rlike(r"(?U)\d") & F.length(tail).between(1, 30)
    return F.when(usable, tail)


def embed_text(name: Column, brand: Column, category: Column | None = None) -> Column:
    """Text to embed: "brand name", or the name alone; optionally followed by the category."""
    parts = [blank_to_null(brand), name]
    if category is not None:
        parts.append(blank_to_null(category))
    return F.concat_ws(" ", *parts)


def section_tag(notes: Column, intent: Column) -> Column:
    """Section of a golden query: the finding number in its notes, else ordered fallbacks."""
    notes = F.coalesce(notes, F.lit(""))
    finding = blank_to_null(F.regexp_extract(notes, r"\b(F-\d+(?:/F-\d+)?)", 1))
    return F.coalesce(
        finding,
        F.when(notes.contains("Sally"), "Sally")
        .when(notes.contains("Edge"), "Edge")
        .when(notes.contains("Help") | intent.contains("help"), "Help")
        .when(notes.contains("Clarify") | (intent == "clarify"), "Clarify")
        .when(notes.contains("English"), "English")
        .otherwise("Other"),
    )


def contains_any(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.coalesce(text, F.lit("")).contains(phrase)
    return hit
