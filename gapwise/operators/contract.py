"""Row contract, canonical columns, audits of single rows and pseudonyms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from ..functions.paths import template_id
from ..functions.timestamps import parse_epoch
from ..scale import at_least, at_most, attach

# fixed values: the ten columns of the log contract and its closed lists
LOG_COLUMNS = [
    "timestamp_utc", "uid", "session_id", "method", "path",
    "referer", "user_agent", "ip", "cookie", "op_category",
]
NEVER_EMPTY = ["uid", "session_id", "method", "path", "ip", "cookie"]
CATEGORIES = ["AUTH", "READ", "UPDATE"]
METHODS = ["GET", "POST", "PUT", "DELETE"]
NULL_SESSION = ["", "nan", "None", "<NA>"]
REFUSED = ["jwt", "authorization", "cookies", "Cookie"]  # exact names; ingest stops
FORBIDDEN = ["authorization", "jwt", "token", "id_token", "access_token", "refresh_token", "set-cookie"]  # findings of the audit, any case
SECRET_KEY = r"(?i)^(authorization|cookie|cookies|set-cookie|jwt|token|id_token|access_token|refresh_token)$"
SECRET_VALUE = (
    r"(?i)(bearer\s+[a-z0-9._~-]+\.[a-z0-9._~-]+\.[a-z0-9._~-]+|eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,})"
)
AUTH_REASONS = [
    "unauthenticatedoperation", "unauthenticatedbeforelogin", "logoutwithoutlogin", "missinginitiallogin",
    "unauthorizedoperation", "invalidcredentials", "tokenmismatch", "sessionmismatch", "invalidsessionidformat",
]
AUTH_STATUS = ["invalid", "revoked", "expired", "unauthorized", "forbidden"]
MARKS = {
    "authenticationbypass": "auth_failure", "auth_failure": "auth_failure",
    "protocolviolation": "protocol_violation", "protocol_violation": "protocol_violation",
    "timedeviation": "time_deviation", "time_deviation": "time_deviation",
}


def reject_reason(df: DataFrame) -> Column:
    """First broken rule of a row, NULL for a valid row."""
    missing = [F.when(F.col(c).isNull(), f"missing_column:{c}") for c in LOG_COLUMNS]
    ts = F.trim("timestamp_utc")
    rules = [
        F.when(ts == "", "missing_timestamp"),
        F.when(~F.coalesce(ts.try_cast("double"), F.lit(float("nan"))).between(-1e300, 1e300), "invalid_timestamp_value"),
        *[F.when(F.col(c) == "", f"missing_value:{c}") for c in NEVER_EMPTY],
        F.when(~F.col("op_category").isin(CATEGORIES), "invalid_value:op_category"),
    ]
    return F.coalesce(*missing, *rules)


def check_rows(df: DataFrame) -> DataFrame:
    """Add ``reason``; absent optional columns become empty text."""
    for c in LOG_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("reason", reject_reason(df))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NULL").withColumn("epoch_s", F.trim("timestamp_utc").cast("double")).drop("reason")


def quarantine(checked: DataFrame, index: str = "row_index") -> DataFrame:
    """Rejected rows with their raw values as a map."""
    pairs = [x for c in LOG_COLUMNS for x in (F.lit(c), F.col(c))]
    return checked.where("reason IS NOT NULL").select(index, "reason", F.create_map(*pairs).alias("raw"))


def reject_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def column_findings(df: DataFrame, allowed: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    """P5: forbidden, unexpected and missing columns of a table; refused names are forbidden too."""
    bad = [c for c in df.columns if c.lower() in FORBIDDEN or c in REFUSED]
    rows = [(c, "forbidden") for c in bad]
    rows += [(c, "unexpected") for c in df.columns if c not in allowed and c not in bad]
    rows += [(c, "missing") for c in allowed if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, finding string")


def refuse_forbidden(df: DataFrame) -> DataFrame:
    """P5: the guard of ingest; a ``token`` column is legal here."""
    bad = [c for c in df.columns if c in REFUSED]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def canonical(df: DataFrame) -> DataFrame:
    """Aliases, trimming, upper case, UNKNOWN defaults, numbers, event default."""
    refuse_forbidden(df)
    for old, new in {"status_code": "status", "meta": "metadata", "user_id": "uid", "timestamp_utc": "timestamp"}.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)

    def text(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit("")

    def number(c: str) -> Column:
        return F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")

    def known(c: str) -> Column:
        return F.coalesce(F.nullif(F.upper(text(c)), F.lit("")), F.lit("UNKNOWN"))

    sid = text("session_id")
    out = df.withColumns(
        {
            "uid": text("uid"),
            "session_id": F.when(~sid.isin(NULL_SESSION), sid),
            "method": known("method"),
            "op_category": known("op_category"),
            **{c: text(c) for c in ("path", "referer", "user_agent", "ip", "event")},
            "latency_ms": number("latency_ms"),
            "response_bytes": number("response_bytes"),
        }
    )
    if "timestamp" in have:
        out = out.withColumn("epoch_s", parse_epoch(F.col("timestamp").cast("string")))
    out = out.withColumn("template_id", template_id(F.col("op_category"), F.col("method"), F.col("path")))
    return out.withColumn("event", F.coalesce(F.nullif(F.col("event"), F.lit("")), F.col("template_id")))


def _null_like(c: str) -> Column:
    t = F.lower(F.trim(c))
    return F.col(c).isNull() | (t == "") | (t == "null")


def ipv4(c: Column) -> Column:
    octet = r"[0-9]{1,3}"
    parts = F.transform(F.split(c, r"\."), lambda p: p.try_cast("int"))
    return F.coalesce(c.rlike(rf"^{octet}(\.{octet}){{3}}$") & F.forall(parts, lambda n: n <= 255), F.lit(False))


def row_findings(df: DataFrame, index: str = "row_index") -> DataFrame:
    """One row per broken audit rule."""
    epoch = F.trim("timestamp_utc").try_cast("double")
    rules: dict[str, Column] = {
        "timestamp_utc": epoch.isNull() | (epoch < 0),
        "method": (F.coalesce("method", F.lit("")) != "") & ~F.col("method").isin(METHODS),
        "op_category": (F.coalesce("op_category", F.lit("")) != "") & ~F.col("op_category").isin(CATEGORIES),
        "uid": _null_like("uid"),
        "referer": ~_null_like("referer") & ~F.lower("referer").rlike("^https?://"),
        "user_agent": _null_like("user_agent"),
        "ip": _null_like("ip") | ~ipv4(F.col("ip")),
        "cookie": _null_like("cookie"),
    }
    if "status_code" in df.columns:
        code = F.trim("status_code").try_cast("double")
        rules["status_code"] = code.isNull() | (code < 0) | (code != F.floor(code))
    found = F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(index, F.explode(found).alias("finding"))


# any key at any depth, or any text value
_ANY_SECRET_KEY = r'(?i)"(authorization|cookie|cookies|set-cookie|jwt|token|id_token|access_token|refresh_token)"\s*:'


def metadata_is_sensitive(json_text: Column) -> Column:
    """JSON metadata that names or contains credentials at any depth."""
    valid = F.try_parse_json(json_text).isNotNull()
    return F.coalesce(valid & (json_text.rlike(_ANY_SECRET_KEY) | json_text.rlike(SECRET_VALUE)), F.lit(False))


def _clean(v: Column, depth: int) -> Column:
    """A JSON value without credentials, NULL if nothing is left of it."""
    if depth == 0:  # deeper than any level: all or nothing
        text = F.to_json(v)
        return F.when(~(text.rlike(_ANY_SECRET_KEY) | text.rlike(SECRET_VALUE)), v)
    # objects and arrays both as entries, an array's without a key, so that the expression has one branch per level
    named = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    listed = F.transform(
        F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))
    )
    legal = F.filter(F.coalesce(named, listed), lambda e: ~F.coalesce(e["key"].rlike(SECRET_KEY), F.lit(False)))
    clean = F.transform(legal, lambda e: F.struct(e["key"].alias("key"), _clean(e["value"], depth - 1).alias("value")))
    kept = F.filter(clean, lambda e: e["value"].isNotNull())
    built = F.transform(
        F.array(kept),  # one element: what is kept is computed once
        lambda all_: F.when(F.size(all_) == 0, F.lit(None))
        .when(all_[0]["key"].isNotNull(), F.to_variant_object(F.map_from_entries(all_)))
        .otherwise(F.to_variant_object(F.transform(all_, lambda e: e["value"]))),
    )
    single = ~((F.schema_of_variant(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(SECRET_VALUE))
    return F.when(named.isNotNull() | listed.isNotNull(), F.element_at(built, 1)).when(single, v)


def redact_metadata(json_text: Column, depth: int = 6) -> Column:
    """Credentials removed at every level, by key and by value; what becomes empty goes too.

    Numbers, truth values and nested values keep their types.  Arrays and single
    values at the top become ``{"value": ...}``, an empty result ``{}``, text that is
    not JSON is NULL.  Below ``depth`` levels a value with a credential goes whole.
    """
    parsed = F.try_parse_json(json_text)
    kind = F.schema_of_variant(parsed)
    clean = _clean(parsed, depth)
    whole = F.when(F.startswith(kind, F.lit("OBJECT")), F.to_json(clean)).when(kind != "VOID", F.concat(F.lit('{"value":'), F.to_json(clean), F.lit("}")))
    return F.when(parsed.isNotNull(), F.coalesce(whole, F.lit("{}")))


def _claims(part: Column) -> Column:
    """Base64url part of a token as JSON text."""
    plain = F.translate(part, "-_", "+/")
    return F.decode(F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "="), F.lit("base64")), "UTF-8")


def token_uid(
    header: Column,
    secret: bytes,
    now: int,
    skew: float = 0.0,
    issuers: Sequence[str] = (),
    audiences: Sequence[str] = (),
) -> Column:
    """P10: user pseudonym of a signed bearer token, NULL when the token is not accepted."""
    skew = min(max(skew, 0.0), 60.0)
    text = F.trim(header)
    token = F.when(text.rlike(r"^(?i)bearer\s+"), F.trim(F.regexp_replace(text, r"^(?i)bearer\s+", "")))
    parts = F.split(token, r"\.")
    three = F.size(parts) == 3
    p0, p1, p2 = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    signed = F.base64(F.unhex(hmac_sha256(secret, F.concat_ws(".", p0, p1))))
    signature = F.rtrim(F.translate(signed, "+/", "-_"), F.lit("="))
    claims, head = _claims(p1), _claims(p0)
    exp = F.get_json_object(claims, "$.exp").try_cast("double")
    nbf = F.get_json_object(claims, "$.nbf").try_cast("double")
    ok = three & (signature == p2) & (exp + skew > now) & F.coalesce(nbf - skew <= now, F.lit(True))
    if issuers:
        ok = ok & F.coalesce(F.trim(F.get_json_object(claims, "$.iss")).isin(list(issuers)), F.lit(False))
    if audiences:
        aud = F.get_json_object(claims, "$.aud")
        many = F.from_json(aud, "array<string>")
        have = F.when(aud.startswith("["), many).otherwise(F.array(aud))
        need = F.array(*[F.lit(a) for a in audiences])
        ok = ok & F.coalesce(F.size(F.array_except(need, have)) == 0, F.lit(False))
    kid = F.get_json_object(head, "$.kid")
    return F.when(ok, F.concat_ws(":", hmac_sha256(secret, token), F.nullif(kid, F.lit(""))))


DELTA_NAMES = ["dt_sec", "delta_t", "delta_seconds", "dt_seconds"]


def log_delta(df: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """First usable delta column (else 0) and its floored logarithm."""
    found = [F.col(c).try_cast("double") for c in DELTA_NAMES if c in df.columns]
    out = df.withColumn("dt", F.coalesce(*found, F.lit(0.0)))
    return out.withColumn("log_dt", F.ln(F.greatest(F.col("dt") + epsilon, F.lit(1e-12))))


def standardise(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Z-scores over the whole table, NULL counted as 0."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    stats = filled.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    out = attach(filled, stats, [])
    out = out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + eps) for c in columns})
    return out.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def clip(c: Column, bound: float) -> Column:
    """Limit to +/- bound."""
    return at_least(at_most(c, bound), -float(bound))


def priority_label(
    mark: Column | None, reasons: Column, protocol_flag: Column, time_flag: Column, auth_status: Column | None = None
) -> Column:
    """The most serious of mark, authentication failure, protocol violation, time deviation."""
    none = F.lit(None).cast("string")
    known = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    marked = F.try_element_at(known, F.lower(F.trim(mark))) if mark is not None else none
    low = F.transform(reasons, lambda r: F.lower(F.trim(r)))
    auth = F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(a) for a in AUTH_REASONS])), F.lit(False))
    if auth_status is not None:
        auth = auth | F.coalesce(F.lower(F.trim(auth_status)).isin(AUTH_STATUS), F.lit(False))
    flag = F.coalesce(protocol_flag, F.lit(False))
    late = F.coalesce(time_flag, F.lit(False))
    return (
        F.when((F.coalesce(marked, F.lit("")) == "auth_failure") | auth, "auth_failure")
        .when((F.coalesce(marked, F.lit("")) == "protocol_violation") | flag, "protocol_violation")
        .when((F.coalesce(marked, F.lit("")) == "time_deviation") | late, "time_deviation")
        .otherwise("normal")
    )
