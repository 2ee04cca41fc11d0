"""Request paths reduced to templates with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: segment classes, tested in this order
SEGMENT_CLASSES = [
    ("{uuid}", r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("{int}", r"^[0-9]+$"),
    ("{hex}", r"^(?i)[0-9a-f]{12,}$"),
    ("{token}", r"^[A-Za-z0-9_-]{10,}$"),
]


def _segment(seg: Column) -> Column:
    word = F.regexp_replace(F.lower(seg), r"[0-9]+", "{num}")
    word = F.regexp_replace(word, r"[^a-z0-9{}]+", "-")
    word = F.regexp_replace(word, r"-+", "-")
    word = F.regexp_replace(word, r"^-|-$", "")
    out = F.when(word == "", "{token}").otherwise(word)
    for label, pattern in reversed(SEGMENT_CLASSES):
        out = F.when(seg.rlike(pattern), label).otherwise(out)
    return out


def path_template(path: Column) -> Column:
    """Template of a path or URL; empty paths give ``root``."""
    raw = F.trim(F.coalesce(path, F.lit("")))
    after_host = F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    local = F.when(raw.contains("://"), after_host).otherwise(raw)
    local = F.regexp_replace(local, r"[?#].*$", "")
    parts = F.filter(F.transform(F.split(local, "/"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return F.when(F.size(parts) == 0, "root").otherwise(F.array_join(F.transform(parts, _segment), "/"))


def _upper_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("UNKNOWN"))


def template_id(category: Column, method: Column, path: Column) -> Column:
    """``CATEGORY::METHOD::template``."""
    return F.concat_ws("::", _upper_or_unknown(category), _upper_or_unknown(method), path_template(path))
