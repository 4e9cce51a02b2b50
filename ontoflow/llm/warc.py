"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing: a record is one row and the sink's line separator the blank lines that end it, so that any
Hadoop file system, the commit protocol and task retries are Spark's own business.

Reading: the text source splits the files at the magic line, in tasks over byte ranges. Each piece
behind a magic line is a candidate record: its header's Content-Length gives the offset of its
successor. A magic line inside a payload is a candidate too, so the offsets that tasks emit are
chained: within a byte range each candidate is led to the first offset that leaves the range, pointer
jumping over the ranges then finds the offset at which the chain from the file's start enters each
range, and only candidates on that chain are records. A payload without the magic line lies in one
piece; the pieces of the others, and only those, are read a second time and put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

MAGIC = "WARC/1.1\r\n"
_BLANK = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "
#: Fixed value: the standard's name of revisits by equal payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are four times 40 bits, each eight base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, a, 10), 16, 32), 8, "0") for a in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def records_of(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to, is_revisit.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest page_id
    is the response and the others revisit it; rows that repeat this page_id are responses too, and so
    are all rows where no page_id is known. A null payload is empty. Payloads are counted by digest
    before the join, so that one shared by many rows meets a single row.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("_sha1", F.sha1("payload"))
    first = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("_sha1").agg(F.max("page_id").alias("_of"), F.count("*").alias("_n")).where("_n > 1 AND _of IS NOT NULL").select("_sha1", "_of")
    # Written first: while it is small, the planner then sees its size and doesn't exchange the payloads.
    first = materialize(first, "warc-repeated")
    again = F.col("_of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_of"))
    return rows.join(first, "_sha1", "left").select("page_id", "url", "payload", "payload_bytes", base32_sha1(F.col("payload")).alias("payload_digest"), F.when(again, F.col("_of")).alias("refers_to"), again.alias("is_revisit"))


def record_text(page_id: Column, url: Column, payload: Column, size: Column, digest: Column, revisit: Column, refers_to: Column, date: str) -> Column:
    """A record's bytes without the last blank lines."""
    clean = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    http = F.concat(F.lit(_HTTP), size.cast("string"), F.lit(_BLANK))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), clean(page_id),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), clean(url),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), clean(refers_to), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(_BLANK), block,
    )


def write_warc(records: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the rows of ``records_of`` as archives in ``folder``, one for each partition.

    Every record has the date given, since pages have none. A null page_id or url is written empty, line
    ends in them become spaces; rows that repeat are written each, with the same record id. An empty table
    gives archives without a record.
    """
    c = F.col
    text = record_text(c("page_id"), c("url"), c("payload"), c("payload_bytes"), c("payload_digest"), c("is_revisit"), c("refers_to"), date)
    records.select(text.alias("value")).write.option("lineSep", _BLANK).text(folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between magic lines, with its file, byte range and a number that ascends in the range."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"),
    )


def _parsed(rows: DataFrame) -> DataFrame:
    """Header fields of each ``value`` and, where its block is whole, the payload's size and digest."""
    number = lambda c, name: F.expr(f"try_cast(regexp_extract({c}, '(?im)^{name}:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1) AS bigint)")
    field = lambda pattern: F.regexp_extract("head", "(?im)^" + pattern, 1)
    others = [c for c in rows.columns if c != "value"]
    rows = rows.select(*others, F.octet_length("value").cast("long").alias("n"), F.substring_index("value", _BLANK, 1).alias("head"), F.col("value").cast("binary").alias("data"))
    rows = rows.withColumn("head_n", F.octet_length("head").cast("long")).withColumn("length", number("head", "Content-Length"))
    # A record's bytes behind its magic line: header, blank line, block, and the blank lines that end it.
    rows = rows.withColumn("total", F.when(F.col("head_n") < F.col("n"), F.col("head_n") + F.col("length") + 8))
    # The file's last piece and those before a magic line all end with the blank lines.
    rows = rows.withColumn("whole", F.coalesce(F.col("total") <= F.col("n"), F.lit(False)))
    rows = rows.withColumn("body", F.when(F.col("whole"), F.expr("substring(data, cast(head_n + 5 AS int), cast(length AS int))")))
    rows = rows.withColumn("http", F.substring_index(F.col("body").cast("string"), _BLANK, 1))
    rows = rows.withColumn("payload", F.expr("substring(body, octet_length(http) + 5)"))
    return rows.select(
        *others, "n", "total", "whole",
        F.lower(field(r"WARC-Type:[ \t]*([A-Za-z]+)")).alias("record_type"),
        F.expr(r"try_cast(regexp_extract(head, '(?im)^WARC-Record-ID:[ \\t]*<urn:page:(-?[0-9]*)>', 1) AS bigint)").alias("page_id"),
        F.expr(r"try_cast(regexp_extract(head, '(?im)^WARC-Refers-To:[ \\t]*<urn:page:(-?[0-9]*)>', 1) AS bigint)").alias("refers_to"),
        field(r"WARC-Target-URI:[ \t]*(.*?)[ \t]*\r?$").alias("url"),
        field(r"WARC-Payload-Digest:[ \t]*sha1:([A-Z2-7]+)").alias("told_digest"),
        number("http", "Content-Length").alias("told_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def _lead_out(batches):
    """Of each byte range: every candidate's place, its successor and where its chain leaves the range."""
    import pandas as pd

    def done(rows):
        table = pd.concat(rows, ignore_index=True)
        after = (table.n + len(MAGIC)).cumsum()
        table["place"] = after - table.n - len(MAGIC)
        span = int(after.iloc[-1])
        places = table.place.tolist()
        at = {p: k for k, p in enumerate(places)}
        leaves: list = [None] * len(places)
        nexts = [None if pd.isna(t) else p + int(t) + len(MAGIC) for p, t in zip(places, table.total)]
        for k in range(len(places) - 1, -1, -1):
            if nexts[k] is None:
                continue
            follower = at.get(nexts[k])
            leaves[k] = leaves[follower] if follower is not None else nexts[k] if nexts[k] >= span else None
        table["span"] = span
        table["after"] = pd.array(nexts, "Int64")
        table["leaves"] = pd.array(leaves, "Int64")
        return table[["path", "block", "piece", "place", "after", "leaves", "span"]]

    held, key = [], None
    for batch in batches:
        for (path, block), part in batch.groupby(["path", "block"], sort=False):
            if key is not None and key != (path, block):
                yield done(held)
                held = []
            key = (path, block)
            held.append(part)
    if held:
        yield done(held)


def _follow(key, table):
    """Of one byte range: which record owns each piece, from the place at which the chain enters."""
    import pandas as pd

    table = table.sort_values("piece")
    base, target = int(table.base.iloc[0]), table.enters.iloc[0]
    target = None if pd.isna(target) else int(target) - base
    owner, own = None, []
    for place, after in zip(table.place.tolist(), table.after.tolist()):
        if target is not None and place == target:
            owner, target = base + place, None if pd.isna(after) else int(after)
        own.append(owner)
    return table.assign(at=table.place + base, owner=pd.array(own, "Int64"))[["path", "block", "piece", "at", "owner"]]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload read; a revisit's are what its record
    tells. A file that doesn't begin with the magic line has no records, and a chain ends where a
    header has no length or the successor isn't a candidate. Empty folders and files give no rows.
    """
    found = materialize(_parsed(_pieces(spark, folder)), "warc-candidates")
    ranges = found.select("path", "block", "piece", "n", "total").repartition("path", "block").sortWithinPartitions("path", "block", "piece")
    led = materialize(ranges.mapInPandas(_lead_out, "path string, block long, piece long, place long, after long, leaves long, span long"), "warc-chains")
    in_file = Window.partitionBy("path").orderBy("block")
    blocks = led.groupBy("path", "block").agg(F.first("span").alias("span")).withColumn("base", F.coalesce(F.sum("span").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = materialize(blocks, "warc-ranges")
    most = blocks.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    start = F.lit(len(MAGIC)).cast("long")
    enters = blocks.select("path").distinct().select("path", start.alias("enters"))
    if most > 1:
        placed = led.where("leaves IS NOT NULL").join(blocks.select("path", "block", "base"), ["path", "block"])
        jump = materialize(placed.select("path", (F.col("base") + F.col("place")).alias("a"), (F.col("base") + F.col("leaves")).alias("b")), "warc-jumps")
        for _ in range((most - 1).bit_length()):
            ahead = enters.join(jump, (enters.path == jump.path) & (enters.enters == jump.a)).select(enters.path, F.col("b").alias("enters"))
            enters = materialize(enters.union(ahead).distinct(), "warc-entries")
            far = jump.select("path", F.col("a").alias("b"), F.col("b").alias("c"))
            jump = materialize(jump.join(far, ["path", "b"]).select("path", "a", F.col("c").alias("b")), "warc-jumps")
    entry = enters.join(blocks, "path").where("enters >= base AND enters < base + span").groupBy("path", "block").agg(F.min("enters").alias("enters"))
    entry = blocks.join(entry, ["path", "block"], "left").select("path", "block", "base", "enters")
    owned = led.join(entry, ["path", "block"]).groupBy("path", "block").applyInPandas(_follow, "path string, block long, piece long, at long, owner long")
    owned = materialize(owned, "warc-owners")
    records = found.join(owned.where("at = owner").select("path", "piece", "owner"), ["path", "piece"])
    parts = records.where("NOT whole").select("path", "owner")
    if not parts.isEmpty():
        last = owned.groupBy("path", "block").agg(F.max("owner").alias("last"))
        carried = last.withColumn("carried", F.last("last", True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))).select("path", "block", "carried")
        every = owned.join(carried, ["path", "block"]).select("path", "piece", F.coalesce("owner", "carried").alias("owner"))
        wanted = every.join(parts, ["path", "owner"])
        joined = _pieces(spark, folder).join(wanted, ["path", "piece"]).groupBy("path", "owner").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda x: x["value"]), MAGIC).alias("value")
        )
        records = records.where("whole").select(*_RECORD).union(_parsed(joined).where("whole").select(*_RECORD))
    told = lambda c, t: F.when(F.col("record_type") == "revisit", F.col(t)).otherwise(F.col(c)).alias(c)
    return records.where("record_type IN ('response', 'revisit')").select("page_id", "url", told("payload_bytes", "told_bytes"), told("payload_digest", "told_digest"), "record_type", "refers_to")


_RECORD = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "told_bytes", "told_digest"]


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record, reads the archives back and returns what the records hold."""
    from .common import read, shared_dir

    folder = shared_dir(spark, "warc")
    write_warc(records_of(read(spark, sf_dir, "pages")), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the hexadecimal SHA-1, five bytes (ten digits) at a time.
_DIGITS = "list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1))"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html HAVING count(*) > 1)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
  array_to_string(flatten(list_transform([1, 11, 21, 31], lambda a: list_transform([('0x' || substr(h, a, 10))::BIGINT], lambda v: array_to_string({_DIGITS}, '')))), '') AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN m USING (html)
"""
