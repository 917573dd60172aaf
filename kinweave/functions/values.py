"""Keys, ids, labels and bands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """A key or raw value as text."""
    return c.cast("string")


def role_of(party_type: Column) -> Column:
    """The last dot-separated part of a party type."""
    return F.substring_index(party_type, ".", -1)


def party_id(system: str, table: str, key: Column, role: Column | None = None) -> Column:
    return F.concat_ws("_", F.lit("SP"), F.lit(system), F.lit(table), text(key), *([role] if role is not None else []))


def attribute_id(party: Column, column_id: Column) -> Column:
    return F.concat_ws("_", F.lit("RA"), party, column_id)


def relationship_id(kind: str, a: Column, b: Column) -> Column:
    """``kind`` is FK for foreign keys and SR for parties of one row."""
    return F.concat_ws("_", F.lit("REL"), F.lit(kind), a, b)


def rule_id(attribute: Column) -> Column:
    return F.concat(F.lit("RULE_EXACT_"), attribute)


def column_key(system: Column, table: Column, column: Column) -> Column:
    return F.upper(F.concat_ws("_", F.lit("COL"), system, table, column))


def table_prefix(party: Column) -> Column:
    """The third underscore-separated part of a party id: its table."""
    return F.split_part(party, F.lit("_"), F.lit(3))


def stable_id(*parts: Column) -> Column:
    """An id that depends on the natural key only, so reruns agree."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))


def prefix_id(prefix: Column) -> Column:
    """Eight hex digits that depend on a prefix only."""
    return F.substring(F.sha1(prefix), 1, 8)


def next_version(row_id: Column) -> Column:
    """``id`` becomes ``id_v2``, ``id_vN`` becomes ``id_vN+1``."""
    n = F.regexp_extract(row_id, r"_v(\d+)$", 1)
    return F.when(n == "", F.concat(row_id, F.lit("_v2"))).otherwise(F.concat(F.regexp_replace(row_id, r"_v\d+$", "_v"), (F.when(n == "", F.lit("1")).otherwise(n).cast("int") + 1).cast("string")))


def iso_timestamp(t: Column) -> Column:
    """A timestamp as ``2026-01-31T08:05:00``, with microseconds only where there are some."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(t, "SSSSSS") == "000000", whole).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def numbered(prefix: str, n: Column, width: int = 4) -> Column:
    """``ENTITY_0001`` and so on."""
    return F.format_string(f"{prefix}%0{width}d", n)


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Two ids in canonical order."""
    return F.least(a, b), F.greatest(a, b)


def ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest), 0 where both are 0."""
    return F.when(part + rest > 0, part / (part + rest)).otherwise(F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent(x: Column) -> Column:
    """A share as whole percent, such as ``43%``."""
    return F.format_string("%.0f%%", x * 100)


def reason_code(rule_name: Column) -> Column:
    return F.replace(F.upper(rule_name), F.lit("_BLOCKS_MATCH"), F.lit(""))


def parsed_json(text_: Column) -> Column:
    """A JSON object as a map; text that is none becomes ``{'raw': text}``."""
    parsed = F.from_json(text_, "map<string,string>")
    return F.when(text_.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.coalesce(F.when(F.size(parsed) > 0, parsed), F.create_map(F.lit("raw"), text_)))


def json_list(text_: Column) -> Column:
    """A JSON array of strings."""
    return F.from_json(text_, "array<string>")


def attribute_label(subtype: Column) -> Column:
    """``ATTR_FIRST_NAME`` as ``FIRST NAME``."""
    return F.replace(F.replace(subtype, F.lit("ATTR_"), F.lit("")), F.lit("_"), F.lit(" "))


def score_band(x: Column, high: float = 0.9, middle: float = 0.7) -> Column:
    """high, medium or low, the bands that attribute and entity scores are shown in."""
    return F.when(x.isNull(), "none").when(x >= high, "high").when(x >= middle, "medium").otherwise("low")


def evidence_band(x: Column) -> Column:
    return F.when(x >= 0.95, "very high").when(x >= 0.85, "high").when(x >= 0.75, "medium").otherwise("low")


def match_band(percent_: Column) -> Column:
    """full, partial or poor: the bands of an attribute's match percentage."""
    return F.when(percent_ >= 100, "full").when(percent_ >= 50, "partial").otherwise("poor")


def edge_band(percent_: Column) -> Column:
    """The bands of an edge label by its match percentage."""
    return F.when(percent_ < 50, "poor").when(percent_ < 70, "fair").when(percent_ < 90, "good").otherwise("strong")


# What reason codes mean to a reader.
REASONS = {
    "CONFLICTING_HKID": "Different HKID numbers",
    "CONFLICTING_PASSPORT": "Different passport numbers",
    "DIFFERENT_HKID": "Different HKID numbers",
    "DIFFERENT_PASSPORT": "Different passport numbers",
    "GENDER_CONFLICT": "Same name, different gender",
    "TRANSITIVE_CONFLICT": "Conflict through other parties",
}


def reason_label(code: Column) -> Column:
    """A readable label; codes without one are shown as words."""
    out: Column | None = None
    for known, label in REASONS.items():
        out = F.when(code == known, label) if out is None else out.when(code == known, label)
    return out.otherwise(F.initcap(F.replace(code, F.lit("_"), F.lit(" "))))


def reason_text(code: Column, details: Column) -> Column:
    """The label with the conflict's details, sorted by name."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(details), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?"))))), ", ")
    return F.when(F.size(F.map_keys(details)) > 0, F.concat(reason_label(code), F.lit(" ("), pairs, F.lit(")"))).otherwise(reason_label(code))
