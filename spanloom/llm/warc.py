"""WARC archives: written as text, read back by verifying the chain of record boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import scratch_path, written

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits up to this many are sent to all tasks that write; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits give four characters."""
    hexed, out = F.sha1(data), []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*out)


def write_warc(df: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, min_revisit_bytes: int = 0) -> None:
    """Write one record a row to archives in the folder ``path``, one archive a task.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, the one with
    the smallest id is a response and the others revisit it; all smaller payloads
    are responses. A null payload is empty, a null URI is left out, line ends in a
    URI become spaces. A null id makes a response that names no id, and it is never
    revisited. Rows that repeat an id and payload are written alike. An empty table
    gives archives without records. Other columns of ``df`` don't matter.

    First records are found on digests, and only revisits are joined back: by broadcast
    while there are few (they are counted), so that no payload is shuffled; beyond
    that payloads are shuffled once, by id and digest.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(uri_col).cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long"))
    same = written(rows.where((F.col("size") >= min_revisit_bytes) & F.col("key").isNotNull()).select("key", F.sha1("body").alias("sha1")), "payload-digests")
    first = same.groupBy("sha1").agg(F.min("key").alias("first"))
    again = written(same.join(first, "sha1").where("key <> first").select("key", "sha1", "first").distinct(), "revisits")
    few = again.count() <= BROADCAST_ROWS
    if few:
        again = F.broadcast(again)
    rows = rows.withColumn("sha1", F.sha1("body")).join(again, ["key", "sha1"], "left")
    revisits = F.col("first").isNotNull()

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda column: F.concat(F.lit("<urn:record:"), column, F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    rows = rows.withColumn("http", http)
    block = F.when(revisits, F.col("http")).otherwise(F.concat("http", "body"))
    none = F.lit("")
    head = F.concat(
        line("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.coalesce("id", none))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]+", " ")), none),
        F.when(revisits, F.concat(line("WARC-Refers-To", urn(F.col("first").cast("string"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("body")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    text = rows.withColumn("block", block).select(F.concat(F.lit(MAGIC), head, F.lit("\r\n"), F.col("block")).alias("value"))
    text.write.option("lineSep", GAP).text(path)


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a record, from the bytes that follow its magic; payload fields are null if it is cut short."""
    head = F.substring_index(value, GAP, 1)
    field = lambda name, of=head: F.nullif(F.regexp_extract(of, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    length = F.try_to_number(F.regexp_extract(field("Content-Length"), r"^(\d{1,15})$", 1), F.lit("999999999999999")).cast("long")
    start = F.octet_length(head).cast("long") + len(GAP)
    has_head = F.octet_length(head) < F.octet_length(value)
    block = F.substring(value.cast("binary"), (start + 1).cast("int"), length.cast("int"))
    http = F.substring_index(block.cast("string"), GAP, 1)
    is_http = F.col("content_type").startswith("application/http")
    payload = F.when(is_http, F.substring(block, F.octet_length(http) + len(GAP) + 1, F.octet_length(block))).otherwise(block)
    whole = F.octet_length(value) >= start + length
    return {
        "record_type": F.when(has_head, field("WARC-Type")), "record_id": field("WARC-Record-ID"), "target_uri": field("WARC-Target-URI"),
        "refers_to": field("WARC-Refers-To"), "header_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        "content_type": F.coalesce(field("Content-Type"), F.lit("")), "start": start, "content_length": F.when(has_head, length),
        "whole": F.coalesce(has_head & whole, F.lit(False)),
        "stated_bytes": F.try_to_number(F.regexp_extract(field("Content-Length", http), r"^(\d{1,15})$", 1), F.lit("999999999999999")).cast("long"),
        "payload": F.when(whole, payload),
    }


def _fields(df: DataFrame, keep: list[str]) -> DataFrame:
    parsed = _parsed(F.col("value"))
    payload = parsed.pop("payload")
    df = df.withColumn("content_type", parsed.pop("content_type")).select(*keep, "content_type", *[c.alias(k) for k, c in parsed.items()], payload.alias("payload"))
    told = df["record_type"] != "revisit"
    return df.withColumns({"payload_bytes": F.when(told, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")), "payload_digest": F.when(told, sha1_base32(F.col("payload"))).otherwise(F.col("header_digest"))})


NARROW = ["record_type", "record_id", "target_uri", "refers_to", "content_type", "payload_bytes", "payload_digest"]


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the WARC archives below ``path``, which may hold the magic inside payloads.

    Columns: file, offset, record_type, record_id, target_uri, refers_to,
    content_type, payload_bytes, payload_digest (bare base32 SHA-1 of the payload
    read; for a revisit as its header says, its bytes as its HTTP header says) and,
    if asked for, payload (binary; empty for a revisit).

    Tasks read byte ranges split at the magic. Each fragment is a candidate record
    and emits its offset and, from its length field, its successor's. Fragments
    that follow each other without a gap, and that no other jump enters, form
    runs; pointer jumping over runs from each file's start keeps the reachable
    ones, in as many rounds as the logarithm of a file's runs. A record whose payload holds the magic
    is put together from its fragments. A file that doesn't start with the magic has
    no records; a broken chain ends its file's records there. A candidate without
    a valid length has no successor. Empty files give no rows.
    """
    scan = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value"
    )
    step = len(MAGIC)
    narrow = _fields(scan, ["file", "part", "at", F.octet_length("value").cast("long").alias("size")]).drop("payload", "stated_bytes", "header_digest")
    narrow = written(narrow, "fragments")

    here = Window.partitionBy("file", "part").orderBy("at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = narrow.groupBy("file", "part").agg(F.sum(F.col("size") + step).alias("bytes"))
    base = base.select("file", "part", F.coalesce(F.sum("bytes").over(parts), F.lit(0)).alias("base"))
    local = narrow.withColumn("local", F.coalesce(F.sum(F.col("size") + step).over(before), F.lit(0)))
    # a fragment's offset is that of the magic before it; the first of a file, before any magic, has a negative one
    found = local.join(base, ["file", "part"]).withColumn("offset", F.col("base") + F.col("local") - step).drop("base", "local")
    found = found.withColumn("next", F.col("offset") + step + F.col("start") + F.col("content_length") + len(GAP))
    found = written(found, "candidates")

    linked = found.where("offset >= 0").withColumns({"follower": F.lead("offset").over(here), "came": F.lag("next").over(here)})
    entered = linked.where("follower IS NULL OR next <> follower").select("file", F.col("next").alias("offset"), F.lit(True).alias("entered")).where("offset IS NOT NULL").distinct()
    linked = linked.join(entered, ["file", "offset"], "left")
    begins = F.coalesce(F.col("entered"), F.lit(False)) | F.col("came").isNull() | (F.col("came") != F.col("offset"))
    linked = written(linked.withColumn("run", F.sum(begins.cast("long")).over(here)), "runs")
    jump = linked.groupBy("file", "part", "run").agg(F.min("offset").alias("offset"), F.max_by("next", "offset").alias("next")).select("file", "offset", "next")
    jump = written(jump, "jumps")
    reached = written(jump.where("offset = 0").select("file", "offset"), "reached")
    count = reached.count()
    while True:
        on = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset")).where("offset IS NOT NULL")
        reached = written(reached.unionByName(on).distinct(), "reached")
        if (now := reached.count()) == count:
            break
        count = now
        ahead = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("further"))
        jump = written(jump.join(ahead, ["file", "next"]).select("file", "offset", F.col("further").alias("next")), "jumps")

    heads = linked.groupBy("file", "part", "run").agg(F.min("offset").alias("offset")).join(reached, ["file", "offset"], "left_semi").select("file", "part", "run")
    records = linked.join(heads, ["file", "part", "run"], "left_semi").where("content_length IS NOT NULL")
    records = written(records, "records")
    whole = records.where("whole").select("file", "offset", *NARROW, "part", "at")
    if payloads:
        text = _fields(scan, ["file", "part", "at"]).select("file", "part", "at", "payload")
        whole = whole.join(text, ["file", "part", "at"])
    made = ["file", "offset", *NARROW, *["payload"] * payloads]
    whole = whole.select(*made)
    if records.where("NOT whole").isEmpty():
        return whole
    return whole.unionByName(_reassembled(scan, found, records).select(*made))


def _reassembled(scan: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, from their fragments."""
    broken = records.where("NOT whole").select("file", F.col("offset").alias("owner"), F.col("next").alias("until"))
    real = found.join(records.select("file", "part", "at", F.col("offset").alias("own")), ["file", "part", "at"], "left")
    here = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = real.groupBy("file", "part").agg(F.max("own").alias("last"))
    carried = last.select("file", "part", F.max("last").over(parts).alias("carried"))
    owned = real.withColumn("owner", F.last("own", True).over(here)).join(carried, ["file", "part"]).withColumn("owner", F.coalesce("owner", "carried"))
    pieces = owned.join(broken, ["file", "owner"]).where("offset < until").select("file", "part", "at", "owner", "offset")
    pieces = written(pieces, "pieces")
    if pieces.count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    texts = scan.join(pieces, ["file", "part", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    value = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    return _fields(texts.select("file", F.col("owner").alias("offset"), value.alias("value")), ["file", "offset"]).where("whole")


def op4(spark, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back, and tell each page's payload."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, "page_id", "url", "html")
    number = lambda c: F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1).try_cast("long")
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_ALPHABET}', (((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
