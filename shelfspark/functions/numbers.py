"""Prices, costs, distances and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.text import strip

_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"


def to_number(text: Column) -> Column:
    """Number written in the text, else NULL. NaN and infinities are refused."""
    cleaned = strip(text.cast("string"))
    return F.when(cleaned.rlike(_NUMBER), F.regexp_replace(cleaned, "_", "").try_cast("double"))


def parse_price(text: Column) -> Column:
    """Storefront price: NULL when unreadable, not positive or at the "on request" sentinel."""
    value = to_number(text)
    return F.when((value > 0) & (value < rules.PRICE_SENTINEL), value)


def parse_price_rest(text: Column) -> Column:
    """REST feed price: only values that are not positive count as missing."""
    value = to_number(text)
    return F.when(value > 0, value)


def parse_price_offer(text: Column) -> Column:
    """Offer price of a page: thousands commas are dropped first."""
    return parse_price(F.regexp_replace(text.cast("string"), ",", ""))


def parse_price_digits(text: Column) -> Column:
    """Price text with currency signs: keep digits and points only."""
    return to_number(F.regexp_replace(F.regexp_replace(text, r"[^\d.,]", ""), ",", ""))


def variant_availability(available: Column, quantity: Column) -> Column:
    """Stock flag, else quantity above zero, else available."""
    return F.coalesce(available, quantity > 0, F.lit(True))


def offer_availability(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(True)).otherwise(text.contains("InStock"))


def token_cost(in_tokens: Column, out_tokens: Column, in_chars: Column, out_chars: Column) -> Column:
    """USD of one call from its token counts, else from characters (one token at least)."""
    per_token = F.lit(rules.CHARS_PER_TOKEN)
    guess = lambda chars: F.greatest(F.lit(1), F.floor(chars / per_token))
    counted = in_tokens.isNotNull() | out_tokens.isNotNull()
    tokens_in = F.when(counted, F.coalesce(in_tokens, F.lit(0))).otherwise(guess(in_chars))
    tokens_out = F.when(counted, F.coalesce(out_tokens, F.lit(0))).otherwise(guess(out_chars))
    return tokens_in * F.lit(rules.INPUT_TOKEN_USD) + tokens_out * F.lit(rules.OUTPUT_TOKEN_USD)


def clean_int_label(text: Column) -> Column:
    """Numeric text rounded to a whole number (halves to even), other text unchanged."""
    number = to_number(text)
    return F.coalesce(F.bround(number, 0).cast("bigint").cast("string"), text)


def flat_earth_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance on a flat map scaled at the first point: 111 km per degree."""
    north = (lat1 - lat2) * F.lit(111.0)
    east = (lng1 - lng2) * F.lit(111.0) * F.cos(F.radians(lat1))
    return F.sqrt(north * north + east * east)


def cosine(left: Column, right: Column, clamp: bool = False) -> Column:
    """Cosine of two short arrays in double precision; 0 when either is all zero.

    Arrays of different length raise an error. For many pairs use
    ``operators.vectors``, which multiplies blocks.
    """
    as_double = lambda a: a.cast("array<double>")
    dot = lambda a, b: F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(left, right) / norms)
    if clamp:
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(F.size(left) == F.size(right), value).otherwise(F.raise_error(F.lit("vector lengths differ")))
