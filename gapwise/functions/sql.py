"""Expressions of the engine as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .hashing import _pads

PATH_TEMPLATE = r"""
  CASE WHEN size(filter(transform(split(regexp_replace({local}, '[?#].*$', ''), '/'), s -> trim(s)), s -> length(s) > 0)) = 0
    THEN 'root'
    ELSE array_join(transform(
      filter(transform(split(regexp_replace({local}, '[?#].*$', ''), '/'), s -> trim(s)), s -> length(s) > 0),
      s -> CASE
        WHEN s RLIKE '^(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$' THEN '{{uuid}}'
        WHEN s RLIKE '^[0-9]+$' THEN '{{int}}'
        WHEN s RLIKE '^(?i)[0-9a-f]{{12,}}$' THEN '{{hex}}'
        WHEN s RLIKE '^[A-Za-z0-9_-]{{10,}}$' THEN '{{token}}'
        ELSE coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          lower(s), '[0-9]+', '{{num}}'), '[^a-z0-9{{}}]+', '-'), '-+', '-'), '^-|-$', ''), ''), '{{token}}')
      END), '/') END"""

LOCAL = (
    "CASE WHEN contains(coalesce(p, ''), '://') "
    "THEN regexp_replace(trim(p), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') ELSE trim(coalesce(p, '')) END"
)

TAIL_P = """
  CASE WHEN y <= 0 THEN greatest(p_ref, 0D)
    WHEN abs(xi) < 1e-12 THEN greatest(p_ref, 0D) * exp(-y / greatest(beta, 1e-12D))
    WHEN 1 + xi * y / greatest(beta, 1e-12D) <= 0 THEN 0D
    ELSE greatest(p_ref, 0D) * pow(1 + xi * y / greatest(beta, 1e-12D), -1 / nullif(xi, 0D)) END"""

GAP_SURVIVAL = """
  exp(-CASE WHEN w <= 1e-6 THEN exp(g) * greatest(d, 0D) ELSE exp(g) * expm1(w * greatest(d, 0D)) / nullif(w, 0D) END)"""


def register(spark: SparkSession, key: bytes | None = None) -> list[str]:
    """Create temporary functions; ``keyed_hash`` only when a key is given."""
    made = {
        "path_template(p STRING) RETURNS STRING": PATH_TEMPLATE.format(local=LOCAL),
        "tail_probability(y DOUBLE, xi DOUBLE, beta DOUBLE, p_ref DOUBLE) RETURNS DOUBLE": TAIL_P,
        "gap_survival(g DOUBLE, w DOUBLE, d DOUBLE) RETURNS DOUBLE": GAP_SURVIVAL,
    }
    if key is not None:
        inner, outer = (bytes(p).hex() for p in _pads(key, "sha256"))
        made["keyed_hash(m STRING) RETURNS STRING"] = (
            f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', cast(m AS BINARY)), 256))), 256)"
        )
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
