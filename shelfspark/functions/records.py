"""Expressions over JSON text, tool calls and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.numbers import to_number
from shelfspark.functions.text import blank_to_null, contains_any, strip

TOOL_CALLS_TYPE = (
    "array<struct<name:string,args:map<string,string>,duration_ms:bigint,error:string,result_count:int>>"
)


def day_key(ts: Column) -> Column:
    """UTC calendar day (sessions run in UTC)."""
    return F.to_date(ts)


def json_list(text: Column) -> Column:
    """JSON list of texts without its blanks; anything unreadable gives an empty list."""
    parsed = F.from_json(text, "array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & (x != "")), none)


def strict_json(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value; NULL otherwise (``try_parse_json`` ignores what follows)."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def json_from_noise(text: Column, greedy: bool = False) -> Column:
    """First ``{...}`` inside other text as a variant; NULL when it is not JSON."""
    pattern = r"(?s)(\{.*\})" if greedy else r"(?s)(\{.*?\})"
    return strict_json(blank_to_null(F.regexp_extract(text, pattern, 1)))


def infer_intent(terminated_by: Column, tool_calls: Column, message: Column) -> Column:
    """Intent of a turn from how it ended and which tools answered without error."""
    answered = F.transform(
        F.filter(F.coalesce(tool_calls, F.array().cast(TOOL_CALLS_TYPE)), lambda c: F.coalesce(c.getField("error"), F.lit("")) == ""),
        lambda c: c.getField("name"),
    )
    return (
        F.when(terminated_by.isin("error", "safety_blocked", "empty_response"), "error")
        .when(F.array_contains(answered, "clarify"), "clarify")
        .when(F.array_contains(answered, "search_products"), "product_search")
        .when(F.array_contains(answered, "search_stores"), "store_search")
        .when(F.length(strip(F.coalesce(message, F.lit("")))) < 3, "clarify")
        .otherwise("help")
    )


def asks_for_location(tool_calls: Column) -> Column:
    """A clarifying question that went through and speaks of a place."""
    return F.coalesce(
        F.exists(
            tool_calls,
            lambda c: (c.getField("name") == "clarify")
            & (F.coalesce(c.getField("error"), F.lit("")) == "")
            & contains_any(F.try_element_at(c.getField("args"), F.lit("question")), rules.LOCATION_WORDS),
        ),
        F.lit(False),
    )


def args_superset(actual: Column, expected: Column) -> Column:
    """Every expected argument is met by an actual one.

    Both are ``map<string, struct<kind, text>>`` with kind ``bool``, ``number`` or
    ``text``. Texts: expected inside actual, any case, one letter or none always
    met. Numbers: within 5 % of the expected one. Booleans: equal.
    """

    def met(key: Column, want: Column) -> Column:
        have = F.try_element_at(actual, key)
        want_kind, have_kind = want.kind, have.kind
        want_number, have_number = to_number(want.text), to_number(have.text)
        return (
            F.when(have.isNull(), F.lit(False))
            .when((want_kind == "bool") | (have_kind == "bool"), (want_kind == have_kind) & (want.text == have.text))
            .when(
                (want_kind == "text") & (have_kind == "text"),
                (F.length(want.text) <= 1) | F.lower(have.text).contains(F.lower(want.text)),
            )
            .when(
                (want_kind == "number") & (have_kind == "number"),
                F.abs(have_number - want_number) <= F.abs(want_number) * 0.05,
            )
            .otherwise((want_kind == have_kind) & (want.text == have.text))
        )

    return F.forall(F.map_entries(expected), lambda e: F.coalesce(met(e.key, e.value), F.lit(False)))


def typed_args(args: Column) -> Column:
    """``map<string,string>`` of JSON scalars to the typed form ``args_superset`` reads.

    A value written with quotes is a text; ``true``/``false`` are booleans; bare
    numbers are numbers; other bare words are texts.
    """

    def typed(text: Column) -> Column:
        quoted = text.rlike('(?s)^".*"$')
        return F.struct(
            F.when(quoted, "text")
            .when(text.isin("true", "false"), "bool")
            .when(to_number(text).isNotNull(), "number")
            .otherwise("text")
            .alias("kind"),
            F.when(quoted, F.regexp_replace(text, '(?s)^"|"$', "")).otherwise(text).alias("text"),
        )

    return F.transform_values(args, lambda k, v: typed(v))


def merged_name(name_part: Column, spec_part: Column) -> Column:
    """Value of the name extractor, else the one of the spec extractor; blanks count as missing."""
    return F.coalesce(blank_to_null(name_part), blank_to_null(spec_part))


def top_level(path: Column) -> Column:
    return F.split_part(path, F.lit(" > "), F.lit(1))
