"""Tag texts, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AI_FEATURES, COMPASS, FOLD_FROM, FOLD_TO, MAX_TAG_BYTES

#: White space in the Unicode sense.
_SPACE = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NOT_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"


def trim(v: Column) -> Column:
    return F.regexp_replace(v, f"^{_SPACE}+|{_SPACE}+$", "")


def number(v: Column) -> Column:
    """Decimal text as double, null for anything else (suffixes included)."""
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def first_item(v: Column) -> Column:
    return trim(F.substring_index(v, ";", 1))


def parse_metres(v: Column) -> Column:
    item = first_item(v)
    digits = F.regexp_extract(item, r"^[0-9.,]*", 0)
    unit = trim(F.regexp_extract(item, r"^[0-9.,]*([\s\S]*)$", 1))
    foot = unit.startswith("ft") | unit.startswith("'") | unit.startswith("feet")
    metres = number(F.replace(digits, F.lit(","), F.lit("."))) * F.when(foot, 0.3048).otherwise(1.0)
    return F.when((metres > 0) & (metres <= 1000), metres)


def parse_direction(v: Column) -> Column:
    text = trim(v)
    turned = ((number(text) % 360.0) + 360.0) % 360.0
    names = F.create_map(*[F.lit(x) for pair in COMPASS.items() for x in pair])
    return F.when(text.rlike(_NOT_FINITE), F.lit(float("nan"))).when(text.rlike(_NUMBER), turned).otherwise(F.try_element_at(names, F.upper(text)))


def cut_bytes(v: Column, most: int = MAX_TAG_BYTES) -> Column:
    """The longest prefix of whole characters within so many bytes. v is worked out once."""
    longest = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda best, k: F.when(F.octet_length(F.left(x, k)) <= most, k).otherwise(best))
    return F.transform(F.array(v), lambda x: F.when(F.octet_length(x) <= most, x).otherwise(F.left(x, longest(x))))[0]


def first_text(*values: Column) -> Column:
    """The first that is not blank, trimmed and cut."""
    return cut_bytes(F.coalesce(*[F.nullif(trim(v), F.lit("")) for v in values]))


def has_ai_feature(v: Column) -> Column:
    return F.coalesce(F.exists(F.split(v, ";"), lambda x: F.translate(F.lower(trim(x)), "_-", "  ").isin(*AI_FEATURES)), F.lit(False))


def fold(v: Column) -> Column:
    """The search key: trimmed, lower case, without common accents."""
    return F.replace(F.translate(F.lower(trim(v)), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))
