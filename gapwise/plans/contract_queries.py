"""Queries over the row contract, projections and privacy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256, session_key
from ..functions.paths import path_template, template_id
from ..functions.timestamps import guess_epoch, parse_epoch, utc_hour
from ..operators import contract as C
from ..sources.provenance import dataset_fingerprint, source_manifest
from .registry import query
from .views import EV, GAP, events, gaps, r6, table

SECRET = bytes(range(32))


def raw_log(spark, sf):
    """Event log as text with broken values, like a CSV export."""
    e = events(spark, sf)
    k = F.col("k")

    def text(c):
        return c.cast("string")

    return e.select(
        "row_index",
        F.when(k % 19 == 0, "")
        .when(k % 23 == 0, "not-a-time")
        .when(k % 11 != 0, text(F.floor("epoch_s")))
        .alias("timestamp_utc"),
        F.when(k % 17 == 0, "").otherwise(F.col("uid")).alias("uid"),
        F.when(k % 29 != 0, F.col("session_id")).alias("session_id"),
        F.when(k % 13 == 0, " patch ").otherwise(F.col("method")).alias("method"),
        "path",
        F.when(k % 5 == 0, None)
        .when(k % 7 == 0, "ftp://x")
        .otherwise(F.concat(F.lit("https://ref.example/"), "event"))
        .alias("referer"),
        F.when(k % 31 == 0, "null").otherwise(F.concat(F.lit("ua-"), "event")).alias("user_agent"),
        F.concat(F.lit("10."), text(k % 300 * 4), F.lit(".0."), text(F.col("row_index") % 256)).alias("ip"),
        F.when(k % 37 == 0, " ").otherwise(F.concat(F.lit("c"), text(F.col("row_index")))).alias("cookie"),
        F.when(k % 13 == 1, "WRITE").otherwise(F.col("op_category")).alias("op_category"),
        F.when(k % 41 == 0, "-1").when(k % 43 == 0, "2.5").otherwise(text(k + 200)).alias("status_code"),
    )


RAW = (
    EV
    + """, raw AS (SELECT row_index,
  CASE WHEN k%19=0 THEN '' WHEN k%23=0 THEN 'not-a-time' WHEN k%11<>0 THEN CAST(CAST(floor(epoch_s) AS BIGINT) AS VARCHAR) END AS timestamp_utc,
  CASE WHEN k%17=0 THEN '' ELSE uid END AS uid, CASE WHEN k%29<>0 THEN session_id END AS session_id,
  CASE WHEN k%13=0 THEN ' patch ' ELSE method END AS method, path,
  CASE WHEN k%5=0 THEN NULL WHEN k%7=0 THEN 'ftp://x' ELSE 'https://ref.example/' || event END AS referer,
  CASE WHEN k%31=0 THEN 'null' ELSE 'ua-' || event END AS user_agent,
  '10.' || CAST(k%300*4 AS VARCHAR) || '.0.' || CAST(row_index%256 AS VARCHAR) AS ip,
  CASE WHEN k%37=0 THEN ' ' ELSE 'c' || CAST(row_index AS VARCHAR) END AS cookie,
  CASE WHEN k%13=1 THEN 'WRITE' ELSE op_category END AS op_category,
  CASE WHEN k%41=0 THEN '-1' WHEN k%43=0 THEN '2.5' ELSE CAST(k+200 AS VARCHAR) END AS status_code FROM ev)"""
)
_REASON = """coalesce(
  CASE WHEN timestamp_utc IS NULL THEN 'missing_column:timestamp_utc' END, CASE WHEN uid IS NULL THEN 'missing_column:uid' END,
  CASE WHEN session_id IS NULL THEN 'missing_column:session_id' END, CASE WHEN method IS NULL THEN 'missing_column:method' END,
  CASE WHEN path IS NULL THEN 'missing_column:path' END, CASE WHEN referer IS NULL THEN 'missing_column:referer' END,
  CASE WHEN user_agent IS NULL THEN 'missing_column:user_agent' END, CASE WHEN ip IS NULL THEN 'missing_column:ip' END,
  CASE WHEN cookie IS NULL THEN 'missing_column:cookie' END, CASE WHEN op_category IS NULL THEN 'missing_column:op_category' END,
  CASE WHEN trim(timestamp_utc)='' THEN 'missing_timestamp' END,
  CASE WHEN try_cast(trim(timestamp_utc) AS DOUBLE) IS NULL THEN 'invalid_timestamp_value' END,
  CASE WHEN uid='' THEN 'missing_value:uid' END, CASE WHEN session_id='' THEN 'missing_value:session_id' END,
  CASE WHEN method='' THEN 'missing_value:method' END, CASE WHEN path='' THEN 'missing_value:path' END,
  CASE WHEN ip='' THEN 'missing_value:ip' END, CASE WHEN cookie='' THEN 'missing_value:cookie' END,
  CASE WHEN op_category NOT IN ('AUTH','READ','UPDATE') THEN 'invalid_value:op_category' END)"""


@query("s5_numeric_delta_rows", f"""WITH {GAP}, t AS (SELECT row_index, CASE WHEN k%17=0 THEN '' ELSE uid END AS uid, op_category,
    CASE WHEN k%9=0 THEN 'n/a' ELSE CAST(floor(delta_seconds) AS VARCHAR) END AS dt, CASE WHEN k%4=0 THEN '' ELSE CAST(k AS VARCHAR) END AS log_dt FROM gap)
  SELECT row_index, uid, op_category, try_cast(dt AS DOUBLE) AS dt_sec, try_cast(log_dt AS DOUBLE) AS log_dt FROM t
  WHERE try_cast(dt AS DOUBLE) IS NOT NULL AND uid <> '' AND op_category <> ''""")
def _(spark, sf):
    from ..sources.logs import numeric_deltas

    g = gaps(spark, sf)
    k = F.col("k")
    t = g.select(
        "row_index",
        F.when(k % 17 == 0, "").otherwise(F.col("uid")).alias("uid"),
        "op_category",
        F.when(k % 9 == 0, "n/a").otherwise(F.floor("delta_seconds").cast("string")).alias("dt_sec"),
        F.when(k % 4 == 0, "").otherwise(k.cast("string")).alias("log_dt"),
    )
    return numeric_deltas(t, delta="dt_sec", optional=["log_dt"])


@query("s9_source_manifest", """SELECT p AS source, count(*) AS row_count, CAST(sum(CAST(event_id AS HUGEINT)) AS BIGINT) AS id_sum FROM (
    SELECT event_id, 'part-' || CAST(event_id % 3 AS VARCHAR) AS p FROM events) GROUP BY p""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn(
        "source", F.concat(F.lit("part-"), (F.col("event_id") % 3).cast("string"))
    )
    manifest = source_manifest(e, "source", ["event_id", "event_type"])
    ids = e.groupBy("source").agg(F.sum("event_id").alias("id_sum"))
    return manifest.join(ids, "source").select("source", "row_count", "id_sum")


@query("s10_dataset_fingerprint", """WITH t AS (SELECT sha256(coalesce(length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR),'-') || coalesce(length(event_type) || ':' || event_type,'-') || coalesce(length(CAST(user_id AS VARCHAR)) || ':' || CAST(user_id AS VARCHAR),'-')) AS h FROM events)
  SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(h,1,8) AS BIGINT)) AS BIGINT) AS part1, CAST(sum(CAST('0x' || substr(h,9,8) AS BIGINT)) AS BIGINT) AS part2 FROM t""")
def _(spark, sf):
    return dataset_fingerprint(table(spark, sf, "events").select("user_id", "event_type", "event_id"))


@query("p1_row_contract", f"WITH {RAW} SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS rows FROM raw GROUP BY 1")
def _(spark, sf):
    return C.reject_counts(C.check_rows(raw_log(spark, sf)))


@query("p1_quarantine_rows", f"WITH {RAW} SELECT row_index, {_REASON} AS reason, uid AS raw_uid FROM raw WHERE {_REASON} IS NOT NULL")
def _(spark, sf):
    q = C.quarantine(C.check_rows(raw_log(spark, sf)))
    return q.select("row_index", "reason", F.col("raw")["uid"].alias("raw_uid"))


_P2_FORMS = """SELECT row_index, CASE row_index % 6
   WHEN 0 THEN CAST(CAST(floor(epoch_s) AS BIGINT) AS VARCHAR)
   WHEN 1 THEN strftime(to_timestamp(floor(epoch_s)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(k AS VARCHAR), 3, '0') || 'Z'
   WHEN 2 THEN strftime(to_timestamp(floor(epoch_s)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+0' || CAST(k % 10 AS VARCHAR) || ':30'
   WHEN 3 THEN '2024-02-' || lpad(CAST(k % 35 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(k % 27 AS VARCHAR), 2, '0') || ':00:00Z'
   WHEN 4 THEN '2024-01-05T10:00:00-' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || ':00'
   ELSE 'bad ' || CAST(k AS VARCHAR) END AS txt, k, epoch_s FROM ev"""


@query("p2_timestamp_parse", f"""WITH {EV}, t AS ({_P2_FORMS}) SELECT row_index, round(CASE
    WHEN row_index % 6 = 0 THEN floor(epoch_s) WHEN row_index % 6 = 1 THEN floor(epoch_s) + k / 1000.0
    WHEN row_index % 6 = 2 THEN floor(epoch_s) - ((k % 10) * 3600 + 1800)
    WHEN row_index % 6 = 3 AND k % 35 BETWEEN 1 AND 29 AND k % 27 <= 23 THEN epoch(CAST('2024-02-01' AS TIMESTAMP)) + (k % 35 - 1) * 86400 + (k % 27) * 3600
    WHEN row_index % 6 = 4 AND k % 30 <= 23 THEN epoch(CAST('2024-01-05 10:00:00' AS TIMESTAMP)) + (k % 30) * 3600 END, 6) AS epoch FROM t""")
def _(spark, sf):
    e = events(spark, sf)
    iso = F.date_format(F.timestamp_seconds(F.floor("epoch_s")), "yyyy-MM-dd'T'HH:mm:ss")

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    k, form = F.col("k"), F.col("row_index") % 6
    txt = (
        F.when(form == 0, F.floor("epoch_s").cast("string"))
        .when(form == 1, F.concat(iso, F.lit("."), F.lpad(k.cast("string"), 3, "0"), F.lit("Z")))
        .when(form == 2, F.concat(iso, F.lit("+0"), (k % 10).cast("string"), F.lit(":30")))
        .when(form == 3, F.concat(F.lit("2024-02-"), two(k % 35), F.lit("T"), two(k % 27), F.lit(":00:00Z")))
        .when(form == 4, F.concat(F.lit("2024-01-05T10:00:00-"), two(k % 30), F.lit(":00")))
        .otherwise(F.concat(F.lit("bad "), k.cast("string")))
    )
    return e.select("row_index", r6(parse_epoch(txt)).alias("epoch"))


@query("p3_timestamp_guess", f"""WITH {EV} SELECT row_index, CASE row_index % 3 WHEN 0 THEN floor(epoch_s * 1000) / 1000 WHEN 1 THEN floor(epoch_s)
   ELSE epoch(CAST('2024-03-01 00:00:00' AS TIMESTAMP)) + k END AS epoch FROM ev""")
def _(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    form = F.col("row_index") % 3
    iso = F.date_format(F.timestamp_seconds(k + F.lit(1709251200)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    txt = (
        F.when(form == 0, F.floor(F.col("epoch_s") * 1000).cast("string"))
        .when(form == 1, F.floor("epoch_s").cast("string"))
        .otherwise(iso)
    )
    return e.select("row_index", guess_epoch(txt).cast("double").alias("epoch"))


_TEMPLATE_OF_RAW = "CASE WHEN regexp_full_match(split_part(path,'/',2), '[A-Za-z0-9_-]{10,}') THEN '{token}' ELSE split_part(path,'/',2) END || '/{int}'"


@query("p4_canonical_columns", f"""WITH {RAW} SELECT row_index, uid,
   CASE WHEN session_id IN ('','nan','None','<NA>') THEN NULL ELSE session_id END AS session_id,
   coalesce(nullif(upper(trim(method)),''),'UNKNOWN') AS method, coalesce(nullif(upper(trim(op_category)),''),'UNKNOWN') AS op_category,
   coalesce(nullif(upper(trim(op_category)),''),'UNKNOWN') || '::' || coalesce(nullif(upper(trim(method)),''),'UNKNOWN') || '::' || {_TEMPLATE_OF_RAW} AS event,
   try_cast(status_code AS DOUBLE) AS latency_ms FROM raw""")
def _(spark, sf):
    raw = raw_log(spark, sf).withColumn("latency_ms", F.col("status_code"))
    return C.canonical(raw).select("row_index", "uid", "session_id", "method", "op_category", "event", "latency_ms")


@query("p5_column_findings", """SELECT * FROM (VALUES ('cookies','forbidden',(SELECT count(*) FROM events)),('status_code','unexpected',(SELECT count(*) FROM events)),
   ('row_index','unexpected',(SELECT count(*) FROM events)),('cookie','missing',(SELECT count(*) FROM events))) t(column_name, finding, rows_scanned)""")
def _(spark, sf):
    raw = raw_log(spark, sf).withColumnRenamed("cookie", "cookies")
    rows = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return C.column_findings(raw).withColumn("rows_scanned", rows)


_SEGMENT = """CASE WHEN regexp_full_match(s, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN '{uuid}'
  WHEN regexp_full_match(s, '[0-9]+') THEN '{int}' WHEN regexp_full_match(s, '(?i)[0-9a-f]{12,}') THEN '{hex}'
  WHEN regexp_full_match(s, '[A-Za-z0-9_-]{10,}') THEN '{token}'
  ELSE coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '[0-9]+', '{num}', 'g'), '[^a-z0-9{}]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), '{token}') END"""


@query("p6_path_template", f"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/Edit Page 12/' || md5(url)
   WHEN 2 THEN '/item_' || CAST(page_id AS VARCHAR) || '/%%/' || substr(md5(url),1,8) || '-ab12-cd34-ef56-' || substr(md5(url),1,12) ELSE ' ?q=1' END AS p FROM pages),
  c AS (SELECT page_id, p, regexp_replace(CASE WHEN contains(p, '://') THEN regexp_replace(trim(p), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') ELSE trim(p) END, '[?#].*$', '') AS l FROM u)
  SELECT page_id, p AS path, CASE WHEN len(list_filter(string_split(l,'/'), lambda x: trim(x) <> '')) = 0 THEN 'root'
    ELSE array_to_string(list_transform(list_filter(list_transform(string_split(l,'/'), lambda x: trim(x)), lambda x: x <> ''), lambda s: {_SEGMENT}), '/') END AS template FROM c""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    md = F.md5("url")
    path = (
        F.when(i % 4 == 0, F.col("url"))
        .when(i % 4 == 1, F.concat("url", F.lit("/Edit Page 12/"), md))
        .when(
            i % 4 == 2,
            F.concat(
                F.lit("/item_"), i.cast("string"), F.lit("/%%/"), F.substring(md, 1, 8),
                F.lit("-ab12-cd34-ef56-"), F.substring(md, 1, 12),
            ),
        )
        .otherwise(F.lit(" ?q=1"))
    )
    return p.select("page_id", path.alias("path")).withColumn("template", path_template(F.col("path")))


@query("p7_template_counts", f"""WITH {EV} SELECT op_category || '::' || method || '::' || event || '/{{int}}' AS template_id, count(*) AS n FROM ev GROUP BY 1""")
def _(spark, sf):
    e = events(spark, sf)
    t = e.select(template_id(F.col("op_category"), F.lower("method"), F.col("path")).alias("template_id"))
    return t.groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))


_NL = "({0} IS NULL OR trim({0}) = '' OR lower(trim({0})) = 'null')"


@query("p8_row_findings", f"""WITH {RAW}, f AS (SELECT row_index, unnest([
   CASE WHEN try_cast(trim(timestamp_utc) AS DOUBLE) IS NULL OR try_cast(trim(timestamp_utc) AS DOUBLE) < 0 THEN 'timestamp_utc' END,
   CASE WHEN coalesce(method,'') <> '' AND method NOT IN ('GET','POST','PUT','DELETE') THEN 'method' END,
   CASE WHEN coalesce(op_category,'') <> '' AND op_category NOT IN ('AUTH','READ','UPDATE') THEN 'op_category' END,
   CASE WHEN {_NL.format('uid')} THEN 'uid' END,
   CASE WHEN NOT {_NL.format('referer')} AND NOT regexp_matches(lower(referer), '^https?://') THEN 'referer' END,
   CASE WHEN {_NL.format('user_agent')} THEN 'user_agent' END,
   CASE WHEN list_max(list_transform(string_split(ip,'.'), lambda x: CAST(x AS INTEGER))) > 255 OR regexp_matches(ip, '[0-9]{{4}}') THEN 'ip' END,
   CASE WHEN {_NL.format('cookie')} THEN 'cookie' END,
   CASE WHEN try_cast(status_code AS DOUBLE) < 0 OR try_cast(status_code AS DOUBLE) <> floor(try_cast(status_code AS DOUBLE)) THEN 'status_code' END]) AS finding FROM raw)
  SELECT row_index, finding FROM f WHERE finding IS NOT NULL""")
def _(spark, sf):
    return C.row_findings(raw_log(spark, sf))


@query("p9_metadata_redact", f"""WITH {EV} SELECT row_index, (k % 5 <> 2) AS sensitive,
   CASE k % 5 WHEN 3 THEN '{{}}' WHEN 4 THEN '{{"a":{{"deep":[2,{{"ok":true}}],"n":' || CAST(k AS VARCHAR) || '}},"k":"' || CAST(k AS VARCHAR) || '"}}'
   ELSE '{{"k":"' || CAST(k AS VARCHAR) || '"}}' END AS redacted FROM ev""")
def _(spark, sf):
    e = events(spark, sf)
    k = F.col("k").cast("string")
    plain = F.concat(F.lit('{"k":"'), k, F.lit('"'))
    form = F.col("k") % 5
    nested = F.concat(
        plain, F.lit(',"a":{"Token":{"x":1},"n":'), k,
        F.lit(',"deep":[{"jwt":"x"},2,"eyJabcdefghijk.abcdefghijk",{"ok":true,"cookie":null}]}}'),
    )
    meta = (
        F.when(form == 0, F.concat(plain, F.lit(',"Authorization":"x"}')))
        .when(form == 1, F.concat(plain, F.lit(',"note":"Bearer aa.bb.cc"}')))
        .when(form == 3, F.concat(F.lit('{"jwt":"'), k, F.lit('"}')))
        .when(form == 4, nested)
        .otherwise(F.concat(plain, F.lit("}")))
    )
    return e.select("row_index", C.metadata_is_sensitive(meta).alias("sensitive"), C.redact_metadata(meta).alias("redacted"))


_IPAD = "from_hex('" + bytes(b ^ 0x36 for b in SECRET.ljust(64, b"\0")).hex() + "')"
_OPAD = "from_hex('" + bytes(b ^ 0x5C for b in SECRET.ljust(64, b"\0")).hex() + "')"


def _hmac_sql(message: str) -> str:
    return f"sha256({_OPAD} || from_hex(sha256({_IPAD} || encode({message}))))"


_B64 = "rtrim(translate(to_base64({}), '+/', '-_'), '=')"
_TOKEN_SQL = f"""tok0 AS (SELECT row_index, k, epoch_s, {_B64.format("encode('{\"alg\":\"HS256\",\"kid\":\"k' || CAST(k % 3 AS VARCHAR) || '\"}')")} || '.' ||
   {_B64.format("encode('{\"sub\":\"' || uid || '\",\"exp\":' || CAST(CAST(floor(epoch_s) AS BIGINT) AS VARCHAR) || ',\"iss\":\"i' || CAST(k % 4 AS VARCHAR) || '\",\"aud\":[\"web\",\"a' || CAST(k % 2 AS VARCHAR) || '\"]}')")} AS body FROM ev),
  tok AS (SELECT row_index, k, epoch_s, body || '.' || {_B64.format("from_hex(" + _hmac_sql("body") + ")")} || CASE WHEN k % 10 = 7 THEN 'x' ELSE '' END AS token FROM tok0)"""


@query("p10_token_uid", f"""WITH {EV}, {_TOKEN_SQL} SELECT row_index, CASE WHEN k % 10 <> 7 AND floor(epoch_s) + 30 > 1705000000 AND k % 4 < 3 AND k % 2 = 1
   THEN {_hmac_sql('token')} || ':k' || CAST(k % 3 AS VARCHAR) END AS pseudonym FROM tok""")
def _(spark, sf):
    e = events(spark, sf)
    k = F.col("k")

    def b64(c):
        return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/\r\n", "-_"), F.lit("="))

    head = b64(F.concat(F.lit('{"alg":"HS256","kid":"k'), (k % 3).cast("string"), F.lit('"}')))
    claims = F.concat(
        F.lit('{"sub":"'), "uid", F.lit('","exp":'), F.floor("epoch_s").cast("string"), F.lit(',"iss":"i'),
        (k % 4).cast("string"), F.lit('","aud":["web","a'), (k % 2).cast("string"), F.lit('"]}'),
    )
    body = F.concat_ws(".", head, b64(claims))
    e = e.withColumn("_body", body)
    sig = b64(F.unhex(hmac_sha256(SECRET, F.col("_body"))))
    token = F.concat(F.lit("Bearer "), "_body", F.lit("."), sig, F.when(k % 10 == 7, "x").otherwise(""))
    uid = C.token_uid(token, SECRET, now=1705000000, skew=30, issuers=["i0", "i1", "i2"], audiences=["web", "a1"])
    return e.select("row_index", uid.alias("pseudonym"))


@query("p11_session_key", f"""WITH {EV} SELECT row_index, {_hmac_sql("uid || '|' || CAST(CAST(floor(epoch_s) AS BIGINT) AS VARCHAR) || '|v1'")} AS session_key FROM ev""")
def _(spark, sf):
    e = events(spark, sf)
    return e.select("row_index", session_key(SECRET, F.col("uid"), F.col("epoch_s"), "v1").alias("session_key"))


@query("p12_log_delta", f"WITH {GAP} SELECT row_index, round(coalesce(delta_seconds,0.0),6)+0.0 AS dt, round(ln(greatest(coalesce(delta_seconds,0.0)+1e-6,1e-12)),6)+0.0 AS log_dt FROM gap")
def _(spark, sf):
    return C.log_delta(gaps(spark, sf)).select("row_index", r6("dt").alias("dt"), r6("log_dt").alias("log_dt"))


@query("p13_standardise", f"""WITH {GAP}, s AS (SELECT avg(value) mv, stddev_pop(value) sv, avg(coalesce(delta_seconds,0)) md, stddev_pop(coalesce(delta_seconds,0)) sd FROM gap)
  SELECT row_index, round((value-mv)/(sv+1e-8),6)+0.0 AS value, round((coalesce(delta_seconds,0)-md)/(sd+1e-8),6)+0.0 AS delta_seconds FROM gap, s""")
def _(spark, sf):
    z = C.standardise(gaps(spark, sf), ["value", "delta_seconds"])
    return z.select("row_index", r6("value").alias("value"), r6("delta_seconds").alias("delta_seconds"))


@query("p14_clip", f"WITH {EV} SELECT row_index, greatest(-5.0, least(5.0, (value-30)/4)) AS clipped FROM ev")
def _(spark, sf):
    return events(spark, sf).select("row_index", C.clip((F.col("value") - 30) / 4, 5).alias("clipped"))


@query("p15_utc_hour", f"WITH {EV} SELECT CAST(floor((epoch_s % 86400)/3600) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1")
def _(spark, sf):
    e = events(spark, sf).select(utc_hour(F.col("epoch_s")).alias("hour"))
    return e.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


@query("p16_priority_label", f"""WITH {EV} SELECT row_index, CASE WHEN k%11=0 OR k%6=1 OR k%13=5 THEN 'auth_failure' WHEN k%11=1 OR k%6 IN (1,2) THEN 'protocol_violation'
   WHEN k%11=2 OR k%5=0 THEN 'time_deviation' ELSE 'normal' END AS label FROM ev""")
def _(spark, sf):
    k = F.col("k")
    none = F.array().cast("array<string>")
    reasons = (
        F.when(k % 6 == 1, F.array(F.lit("disallowedTransition"), F.lit("TokenMismatch ")))
        .when(k % 6 == 2, F.array(F.lit("disallowedTransition")))
        .otherwise(none)
    )
    mark = (
        F.when(k % 11 == 0, "AuthenticationBypass").when(k % 11 == 1, " protocol_violation").when(k % 11 == 2, "timeDeviation")
    )
    status = F.when(k % 13 == 5, "Revoked").otherwise("valid")
    label = C.priority_label(mark, reasons, (k % 6).isin(1, 2), k % 5 == 0, status)
    return events(spark, sf).select("row_index", label.alias("label"))
