"""WARC records in a content-addressed archive: payload bytes once by digest, record headers apart, records by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The alphabet of base32 (RFC 4648) and the revisit profile of WARC/1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"


def base32(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits, five of which are four characters.

    ``digest`` stands in it 32 times, so it should be a stored or joined column, not an expression that hashes.
    """
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), id_.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> None:
    """Writes ``path``/payloads (sha256, sha1, n_bytes, first_id, payload: each payload once) and ``path``/headers (page_id, sha256, sha1, n_bytes, header: each record).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response,
    the others revisit it; smaller ones are all responses. Payloads are equal when SHA-256, SHA-1 (both as hex
    digits) and length agree, so a collision of one digest merges nothing. A null body is empty; CR and LF in a
    url, which would end its header line, are percent-encoded, all else stands as it is; a null url is an empty
    target; repeated ids give repeated records of one type; a null id is no payload's first unless all its ids are
    null. No pages give an empty archive; other columns are ignored. Copies are combined on the map side, so a
    payload that a third of all rows share is shuffled once a map task.
    """
    payload = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    # Digests without nulls: a join then adds no filter that would hash each payload once more.
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        payload.alias("payload"),
    ).select("page_id", "url", "payload", F.coalesce(F.sha2("payload", 256), F.lit("")).alias("sha256"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes"))
    key = ["sha256", "sha1", "n_bytes"]
    rows.groupBy(*key).agg(F.min("page_id").alias("first_id"), F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select(*key, "first_id")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:>"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.coalesce(_record_id(F.col("first_id")), F.lit("<urn:page:>"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
    )
    rows.drop("payload").join(firsts, key).select("page_id", *key, header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str, pattern: str) -> Column:
    """A header field's value. Lines end in CR LF, which no value holds; other line separators are part of a value."""
    return F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads with ``found``, the SHA-1; reading it fails where the bytes don't have the key's digests and length."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1")) & (F.length("payload") == F.col("n_bytes"))
    fails = F.raise_error(F.concat(F.lit("payload differs from its key: "), F.col("sha256"))).cast("string")
    return stored.withColumn("found", F.when(sound, F.col("sha1")).otherwise(fails))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, record binary (header, blank line, body, two line ends). Headers meet their payloads in a join; revisits, which have no body, don't."""
    headers = spark.read.parquet(f"{path}/headers").withColumn("revisit", _field("WARC-Type", r"(\w+)") == "revisit")
    key = ["sha256", "sha1", "n_bytes"]
    sound = _verified(spark, path).select(*key, F.when(F.col("found").isNotNull(), F.col("payload")).alias("payload"))
    full = headers.where(~F.col("revisit")).join(sound, key).select("page_id", "header", "payload")
    each = full.union(headers.where("revisit").select("page_id", "header", F.lit(b"").alias("payload")))
    return each.select("page_id", F.concat(F.encode("header", "UTF-8"), F.lit(END.encode()), "payload", F.lit(2 * END.encode())).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record from its header and its stored payload: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest come from the payload's bytes, hashed once for each payload however many records share it,
    before they meet the headers; so payloads themselves aren't shuffled. An archive whose bytes don't have the
    digests that their key and header state fails.
    """
    key = ["sha256", "sha1", "n_bytes"]
    stored = _verified(spark, path).select(*key, "found", F.length("payload").cast("long").alias("payload_bytes"))
    refers = _field("WARC-Refers-To", r"<urn:page:(-?\d*)>")
    headers = spark.read.parquet(f"{path}/headers").select(
        "page_id",
        *key,
        _field("WARC-Type", r"(\w+)").alias("record_type"),
        _field("WARC-Payload-Digest", r"sha1:(\w+)").alias("stated"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )
    named = headers.join(stored, key).select("page_id", "payload_bytes", base32(F.col("found")).alias("digest"), "stated", "record_type", "refers_to")
    fails = F.raise_error(F.concat(F.lit("header states another digest: "), F.col("stated"))).cast("string")
    return named.select("page_id", "payload_bytes", F.when(F.col("digest") == F.col("stated"), F.col("stated")).otherwise(fails).alias("payload_digest"), "record_type", "refers_to")
