"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalog type codes and colours.
TYPE_CODES = {"P": "StoredProcedures", "V": "Views", "TR": "Triggers", "FN": "Functions", "IF": "Functions", "TF": "Functions"}


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """The mapped value, the default or null."""
    found = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]
    return F.coalesce(found, default) if default is not None else found


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")


def format_kb(kb: Column) -> Column:
    """Whole KB as KB, MB or GB; ties at the one decimal place go up, as in toFixed."""
    whole = kb.cast("double")
    return F.when(kb.isNull(), "-").when(kb >= 1024 * 1024, F.format_string("%.1f GB", whole / (1024 * 1024))).when(kb >= 1024, F.format_string("%.1f MB", whole / 1024)).otherwise(F.concat(kb.cast("string"), F.lit(" KB")))


def format_count(n: Column) -> Column:
    return F.when(n.isNull(), "-").otherwise(F.format_number(n, 0))


def iso_utc(ts: Column) -> Column:
    """The instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def size_bytes(text: Column) -> Column:
    return F.octet_length(text)


def to_json_list(rows: Column) -> Column:
    """A list as JSON; a single struct is a list of one, null an empty one."""
    return F.coalesce(F.to_json(rows), F.lit("[]"))


def normalised(json: Column, schema: str) -> Column:
    """Rows of a JSON text that holds a list or a single object; null where it is neither."""
    text = F.trim(json)
    return F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), f"array<struct<{schema}>>")


def tolerant(json: Column, schema: str) -> Column:
    """The parsed value, or null where the text is no JSON of that kind."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})
