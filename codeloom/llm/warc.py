"""WARC: a content-addressed archive of Parquet tables, and the original records rebuilt from it by joins.

``payloads`` keeps each distinct payload once under its SHA-256, with its SHA-1 in base32 and its length; ``records`` keeps
the exact header bytes of every record and the SHA-256 of its payload. A record is its header, its payload and two line
ends; :func:`reconstruct` joins the two tables and verifies length and digest. :func:`parse_records` reads a record from its
bytes alone: the header ends at the blank line, and ``Content-Length`` says where the payload ends. Line feeds and carriage
returns in a target URI are written as %0A and %0D, as a header line can't hold them.

Defined cases: a null payload is empty; of records with equal payloads of at least ``min_revisit_bytes`` the one with the
smallest id is the response (rows repeated under that very id are all responses), the others revisit it; a null id counts
as the largest; an empty table gives an empty archive; other columns of the input are ignored. Two payloads of one SHA-256
but other SHA-1 or length stop the job. Hot payloads: the digest table is reduced map-side, and joins on it may be split
by adaptive execution, as each side needs only one row of the payload's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import shared_folder, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LAST = (1 << 63) - 1
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def _header(kind: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda col: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("none")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce("target", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn("record_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("weak"))),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("first_id")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/octet-stream")),
        line("Content-Length", F.col("n_bytes").cast("string")),
        F.lit("\r\n"),
    )


def write_archive(df: DataFrame, path: str, record_id: str, target: str, payload: str, min_revisit_bytes: int = 0) -> None:
    """Writes ``path/records`` and ``path/payloads``."""
    keyed = df.select(F.col(record_id).alias("record_id"), F.col(target).alias("target"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumns(
        {"strong": F.sha2("payload", 256), "weak": sha1_base32(F.col("payload")), "n_bytes": F.octet_length("payload").cast("bigint"), "order": F.coalesce("record_id", F.lit(LAST))}
    )
    same = F.assert_true((F.min("weak") == F.max("weak")) & (F.min("n_bytes") == F.max("n_bytes")), F.lit("two payloads share a SHA-256"))
    # payloads travel once, one of each digest from every task
    stored = keyed.groupBy("strong").agg(
        F.min("order").alias("first_order"), F.min("record_id").alias("first_id"), F.min("weak").alias("weak"), F.min("n_bytes").alias("n_bytes"), F.min_by("payload", "order").alias("payload"), same.alias("checked")
    )
    stored.filter("checked is null").drop("checked").write.option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = df.sparkSession.read.parquet(f"{path}/payloads").select("strong", "first_order", "first_id")
    kind = F.when((F.col("n_bytes") >= min_revisit_bytes) & (F.col("order") != F.col("first_order")), F.lit("revisit")).otherwise(F.lit("response"))
    records = keyed.drop("payload").join(firsts, "strong").withColumn("header", _header(kind).cast("binary")).select("strong", "header")
    records.write.option("compression", "zstd").parquet(f"{path}/records")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every original record as bytes (``record``), verified against the store."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("strong")) & (F.octet_length("payload") == F.col("n_bytes"))
    payloads = payloads.withColumn("bad", F.assert_true(sound, F.lit("a stored payload fails its digest"))).filter("bad is null")
    return records.join(payloads, "strong").select(F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(df: DataFrame) -> DataFrame:
    """Header fields and payload of records, read from their bytes; a record that breaks off is an error."""
    # as Latin-1 a place in the text is a place in the bytes
    blank = F.locate("\r\n\r\n", F.decode("record", "ISO-8859-1"))
    rows = df.select("record", blank.alias("blank")).withColumn("head", F.substring("record", F.lit(1), F.col("blank") + 1).cast("string"))
    field = lambda name, what: F.regexp_extract("head", rf"\r\n{name}: {what}\r\n", 1)
    rows = rows.withColumn("n_bytes", field("Content-Length", "([0-9]+)").cast("int"))
    whole = (F.col("blank") > 0) & (F.col("blank") + 3 + F.col("n_bytes") + 4 == F.octet_length("record"))
    rows = rows.filter(F.assert_true(F.coalesce(whole, F.lit(False)), F.lit("a record breaks off")).isNull())
    rows = rows.withColumn("payload", F.substring("record", F.col("blank") + 4, F.col("n_bytes")))
    number = lambda col: F.when(col.rlike("^-?[0-9]+$"), col.cast("bigint"))
    return rows.select(
        number(field("WARC-Record-ID", r"<urn:page:([^>]*)>")).alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        number(field("WARC-Refers-To", r"<urn:page:([^>]*)>")).alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return parse_records(reconstruct(spark, path))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS hex FROM p
), f AS (
  SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex
)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (i // 8 * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (hex)
"""
