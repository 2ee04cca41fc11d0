"""WARC archives: written from pages by Spark's own writer, read back by boundary-chain verification.

Writing.  A record is one value of the text writer whose line separator is the blank line that ends a WARC record, so archives
land in any store that Spark can write, and a lost task leaves nothing behind.

Reading.  Archives are read in splits at every occurrence of the version line; a split gives the length of each piece, and sums over
the splits of a file give its place in the file.  A piece whose header names a content length is a candidate: it says where
its successor must start.  An occurrence of the version line inside a payload also looks like one, so candidates are only
believed if they can be reached from the start of their file by following successors.  A unit of a file follows its own
successors and says where a chain that enters it leaves it; pointer jumping over units doubles the stride in each round
and needs log2(units of a file) rounds.  A payload that holds the version line was cut in several
pieces and is put together again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwise.llm.common import durable_text
from gapwise.scale import durable, shared_folder

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
DIGEST = "sha1:"
#: records of one archive file, which bounds the rounds of pointer jumping
PER_FILE = 20_000
#: bytes of an archive whose record offsets one task follows
UNIT = 16 << 20
#: rows of a side that may be broadcast; beyond it the join is shuffled
LIGHT = 100_000


def octets(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the UTF-8 text: 40 hex digits in groups of five give four base-32 digits each."""
    hexed = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def one_line(text: Column) -> Column:
    """Header values must not hold line breaks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]", " ")


def plan_records(pages: DataFrame, id_col: str, payload_col: str, uri_col: str, min_bytes: int) -> DataFrame:
    """Pages with ``uid``, digest, length and the row that holds their payload (``refers``, ``first`` = its uid)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"),
    ).select("*", base32_sha1(F.col("payload")).alias("digest"), octets(F.col("payload")).alias("bytes"))
    # rows that repeat in id and payload are told apart by their number among equals; without such rows nothing is shuffled
    twice = rows.groupBy("digest", "id").count().where("count > 1").select(F.col("digest").alias("same"), F.col("id").alias("of_id"))
    if not twice.isEmpty():
        twice = durable(twice)
        on = (F.col("digest") == F.col("same")) & F.col("id").eqNullSafe(F.col("of_id"))
        equal = Window.partitionBy("digest", "id").orderBy("uri")
        again = rows.join(twice, on, "left_semi").withColumn("nth", F.row_number().over(equal) - 1)
        rows = rows.join(twice, on, "left_anti").withColumn("nth", F.lit(0)).unionByName(again)
    else:
        rows = rows.withColumn("nth", F.lit(0))
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("first"))
    groups = durable(groups.where("n > 1").select(F.col("digest").alias("of"), "first"))
    rows = rows.join(light(groups), F.col("digest") == F.col("of"), "left")
    revisit = F.col("of").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first")) & (F.col("nth") == 0))
    return rows.withColumn("revisit", revisit)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", min_bytes: int = 0) -> None:
    """One record per row: the payload, or a revisit record without one if an equal payload of at least ``min_bytes`` is kept elsewhere.

    Of equal payloads the row with the largest id is the response, and one of them if several rows share it.  A null payload is
    an empty one; a null id is less than any other; a null uri is empty.
    """
    rows = plan_records(pages, id_col, payload_col, uri_col, min_bytes)
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit("."), F.col("nth"), F.lit("."), F.col("digest"))
    head = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(VERSION),
        head("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        head("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        head("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        head("WARC-Target-URI", one_line(F.col("uri"))),
        head("WARC-Payload-Digest", F.concat(F.lit(DIGEST), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            head("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("none")), F.lit(".0."), F.col("digest"), F.lit(">"))),
        )).otherwise(F.lit("")),
        head("Content-Type", F.lit("text/html;charset=utf-8")),
        head("Content-Length", octets(body).cast("string")),
        F.lit("\r\n"), body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(path)


def _places(batches: Iterator) -> Iterator:
    """Add the bytes before each piece inside its split; the pieces of a split follow each other in one task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    split, before = None, 0
    for b in batches:
        size = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + len(VERSION)
        names, starts = b.column("file").to_pylist(), b.column("start").to_pylist()
        within = np.zeros(len(size), np.int64)
        for i, key in enumerate(zip(names, starts, strict=True)):
            before = before if key == split else 0
            split, within[i] = key, before
            before += int(size[i])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(within), pa.array(size)], [*b.schema.names, "within", "size"])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every version line: ``file``, ``at`` (offset of the version line), ``text`` (what follows it)."""
    lines = spark.read.option("lineSep", VERSION).text(path)
    split = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    # kept: offsets and text must come from one reading, another one might split the files elsewhere
    split = durable_text(split.mapInArrow(_places, "file string, start long, text string, within long, size long"))
    sums = split.groupBy("file", "start").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    sums = durable(sums.select(F.col("file").alias("f"), F.col("start").alias("s"), base.alias("base")))
    at = F.col("base") + F.col("within") - len(VERSION)
    # the first piece of a file is what precedes its first version line
    return split.join(light(sums), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))).select("file", at.alias("at"), "text").where("at >= 0")


def light(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it has at most ``LIGHT`` rows (of a few numbers and names), so that texts joined with it stay where they are."""
    return F.broadcast(df) if df.count() <= LIGHT else df


def _exits(links: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each entry of a unit first leaves the candidates of the unit."""
    links = links.sort_values("at", ascending=False)
    leave: dict[int, int] = {}
    for at, to in zip(links["at"].tolist(), links["next"].tolist()):
        leave[at] = leave.get(to, to)
    entry = links[links["entry"]]
    return pd.DataFrame({"file": entry["file"], "at": entry["at"], "next": [leave[at] for at in entry["at"].tolist()]})


def _chain(links: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a unit on the chains from its entries."""
    links = links.sort_values("at")
    on = set(links.loc[links["entry"], "at"].tolist())
    for at, to in zip(links["at"].tolist(), links["next"].tolist()):
        if at in on:
            on.add(to)
    return links.loc[links["at"].isin(on), ["file", "at"]]


def reachable(links: DataFrame, unit: int = UNIT) -> DataFrame:
    """Rows (``file``, ``at``) on the chain from offset 0 of each file; ``links`` has ``file``, ``at`` and a larger ``next``.

    Files are cut in units of ``unit`` bytes.  Where another unit's candidate points to is an entry of a unit; each unit
    resolves its entries to where their chains leave it, so the pointers that are jumped are one or a few a unit.
    """
    own = F.floor(F.col("at") / unit)
    links = durable(links.where("next > at").select("file", "at", "next", own.alias("unit")))
    outside = links.where(F.floor(F.col("next") / unit) != F.col("unit")).select("file", F.col("next").alias("at"))
    starts = links.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    entries = outside.unionByName(starts).distinct().withColumn("entry", F.lit(True))

    def with_entries(found: DataFrame) -> DataFrame:
        return links.join(light(found), ["file", "at"], "left").fillna({"entry": False}).groupBy("file", "unit")

    jump = durable(with_entries(durable(entries)).applyInPandas(_exits, "file string, at long, next long"))
    found = durable(starts)
    n = found.count()
    while True:
        # all that the entries found reach with one jump, then jumps of twice the length
        ahead = found.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        found = durable(found.union(ahead).distinct())
        now = found.count()
        if now == n:
            break
        n = now
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("later"))
        jump = durable(jump.join(far, ["file", "next"]).select("file", "at", F.col("later").alias("next")))
    return with_entries(found.withColumn("entry", F.lit(True))).applyInPandas(_chain, "file string, at long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``file``, ``at``, ``header`` (text), ``payload`` (text, whole).

    Records whose content runs past the end of their file, and all behind a broken one, are not reached and not returned.
    """
    cut = pieces(spark, path)
    header, body_at = F.substring_index("text", END, 1), F.instr("text", END)
    length = F.regexp_extract(header, r"(?i)(?:^|\r\n)Content-Length: *([0-9]{1,18})(?:\r\n|$)", 1)
    length = F.when((body_at > 0) & (length != ""), length).cast("long")
    places = durable(cut.select("file", "at", (F.col("at") + len(VERSION) + octets(header) + 2 * len(END) + length).alias("next")))
    real = durable(reachable(places.where("next IS NOT NULL")))
    # pieces that are no record belong to the payload of the last record before them; there are few
    inner = durable(places.select("file", "at").join(real, ["file", "at"], "left_anti"))
    whole = cut.join(light(inner), ["file", "at"], "left_anti")
    owner = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marks = real.withColumn("own", F.col("at")).unionByName(inner, allowMissingColumns=True)
    marks = marks.withColumn("own", F.last("own", True).over(owner)).join(inner, ["file", "at"], "left_semi")
    rest = cut.join(light(durable(marks)), ["file", "at"]).groupBy("file", F.col("own").alias("at")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: F.concat(F.lit(VERSION), x["text"])), "").alias("rest")
    )
    whole = whole.join(light(durable(rest)), ["file", "at"], "left")
    body = F.concat(F.substring("text", body_at + len(END), F.length("text")), F.coalesce("rest", F.lit("")))
    # a record is its content and the blank lines that end it
    out = whole.select("file", "at", header.alias("header"), length.alias("length"), body.alias("body"))
    out = out.withColumn("payload", F.substring("body", F.lit(1), F.length("body") - len(END)))
    return out.where(F.endswith("body", F.lit(END)) & (octets(F.col("payload")) == F.col("length"))).select("file", "at", "header", "payload")


def field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, one row per record: id, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``file``, ``at``.

    Length and digest are those of the payload read: a revisit takes them from the response that it names, and the digest must agree
    with the one in its own header, else it is null.  No rows give an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    path = f"{shared_folder(spark).rstrip('/')}/gapwise/{uuid.uuid4().hex}/warc"
    write_archives(pages, path, id_col, payload_col, uri_col, min_bytes)
    records = read_archives(spark, path)
    page = lambda text: F.nullif(F.regexp_extract(text, r"^<urn:page:(.*)\.[0-9]+\.[A-Z2-7]{32}>$", 1), F.lit("none")).cast(kind)
    got = durable(
        records.select(
            "file", "at", page(field("WARC-Record-ID")).alias("id"), field("WARC-Record-ID").alias("name"), field("WARC-Type").alias("type"),
            field("WARC-Refers-To").alias("target"), F.regexp_replace(field("WARC-Payload-Digest"), f"^{DIGEST}", "").alias("claimed"),
            octets(F.col("payload")).alias("bytes"), base32_sha1(F.col("payload")).alias("digest"),
        )
    )
    kept = got.where("type = 'response'").select(F.col("name").alias("target"), F.col("bytes").alias("b"), F.col("digest").alias("d"))
    back = got.where("type = 'revisit'")
    kept = kept.join(back.select("target").distinct(), "target", "left_semi")
    back = back.join(kept, "target", "left").withColumn("bytes", F.col("b")).withColumn("digest", F.col("d")).drop("b", "d")
    out = got.where("type <> 'revisit'").unionByName(back)
    return out.select(
        F.col("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.when(F.col("digest") == F.col("claimed"), F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", page(F.col("target"))).alias("refers_to"), "file", "at",
    )
