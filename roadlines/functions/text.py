"""Safe typing and road-name expressions (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlines.config import TargetRules

# Spellings that the road-name rules recognise.
ROUTE_TOKEN = r"^(A|N|E)(\d+)$"
LONG_NAME_TOKEN = r"^(?:RIJKSWEG|AUTOSNELWEG)(\d+)$"
LONG_NAME_LETTER = "A"
# End of fixed values.


def filled(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def safe_double(c: Column) -> Column:
    """Number or NULL; Java literals such as '1d' are not numbers."""
    text = F.trim(c.cast("string"))
    return F.when(~F.right(text, F.lit(1)).isin("d", "D", "f", "F"), text).try_cast("double")


def safe_int(c: Column) -> Column:
    """Integer or NULL; text fractions round half away from zero."""
    return F.round(safe_double(c)).try_cast("int")


def safe_date(c: Column) -> Column:
    """Date or NULL from y-m-d or y/m/d text; a bare year or month is not a date."""
    text = F.translate(F.trim(c.cast("string")), "/", "-")
    complete = F.length(text) - F.length(F.translate(text, "-", "")) >= 2
    return F.when(complete, text).try_cast("date")


def safe_cast(c: Column, kind: str) -> Column:
    return {"double": safe_double, "int": safe_int, "date": safe_date, "string": filled}[kind](c)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def bare_number(c: Column) -> Column:
    """Digits of the text without leading zeros (a lone zero stays); NULL without digits."""
    return F.regexp_replace(F.nullif(digits(c), F.lit("")), r"^0+(?=\d)", "")


def _truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def squeeze(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def parsed_road(c: Column) -> Column:
    """Letter plus number for a recognised spelling, else NULL."""
    token = squeeze(c)
    short, long = F.lit(ROUTE_TOKEN), F.lit(LONG_NAME_TOKEN)
    return (
        F.when(F.regexp_like(token, short),
               F.concat(F.substring(token, 1, 1), bare_number(token)))
        .when(F.regexp_like(token, long),
              F.concat(F.lit(LONG_NAME_LETTER), bare_number(token)))
    )


def road_token(c: Column) -> Column:
    """Recognised road name, else the cleaned text, else NULL for blank text."""
    return F.coalesce(parsed_road(c), F.nullif(squeeze(c), F.lit("")))


def general_road_number(raw: Column, letter: Column, number: Column) -> Column:
    """Road name from the raw text, or from letter and number when the raw text is blank."""
    combined = F.when(_truthy(letter) & _truthy(number), road_token(F.concat(letter, number)))
    return F.coalesce(road_token(raw), combined)


def target_road_number(raw: Column, letter: Column, number: Column, alt: Column,
                       rules: TargetRules) -> Column:
    """Target road when one of the target rules holds, else the raw text without spaces."""
    text = F.coalesce(raw, F.lit(""))
    named = F.upper(F.trim(text)).isin(
        *rules.allowed_raw_road_number_values, rules.canonical_road_number)
    spaced = F.upper(F.replace(text, F.lit(" "), F.lit(""))) == rules.canonical_road_number
    lettered = (
        (F.upper(F.trim(F.coalesce(letter, F.lit("")))) == rules.letter)
        & F.coalesce(bare_number(F.coalesce(number, alt, F.lit(""))) == rules.number, F.lit(False))
    )
    return (
        F.when(named | lettered | spaced, F.lit(rules.canonical_road_number))
        .when(text != "", F.upper(F.replace(F.trim(raw), F.lit(" "), F.lit(""))))
    )


def target_flag(norm: Column, raw: Column, kind: Column, letter: Column, number: Column,
                rules: TargetRules) -> Column:
    """True when any of the configured target rules holds (never NULL)."""
    def same(c: Column, values: tuple[str, ...]) -> Column:
        return F.upper(F.trim(c)).isin(*[v.upper() for v in values])

    def first_filled(a: Column, b: Column) -> Column:
        return F.when(_truthy(a), a).otherwise(F.coalesce(b, F.lit("")))

    rule_hits = [
        norm == rules.canonical_road_number,
        same(raw, (*rules.allowed_raw_road_number_values, rules.canonical_road_number)),
        same(kind, rules.allowed_road_type_values)
        & (bare_number(first_filled(raw, number)) == rules.number),
        same(letter, rules.route_letter_values)
        & (bare_number(first_filled(number, raw)) == rules.number),
        parsed_road(raw) == rules.canonical_road_number,
    ]
    hit = F.lit(False)
    for rule in rule_hits:
        hit = hit | F.coalesce(rule, F.lit(False))
    return hit
