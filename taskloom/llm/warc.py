"""Content-addressed WARC archive (operator 9).

Two stores: `payloads` keeps the bytes of each distinct payload once under its SHA-256 digest, and
`headers` keeps the exact header block of every record.  `records` joins the two and gives each original
record back byte for byte; `read_archive` parses such records and takes size and digest from the bytes that it finds in them.

A page whose payload (at least `least` bytes) another page with a smaller page_id has too becomes a
`revisit` record that refers to it; all other pages are `response` records.

Both stores are bucketed by digest, so that a payload is shuffled once, when its store is written, and the records are put together
without another exchange.  Rows that only have headers, like the revisits of a payload that a third of all pages share, meet the
few facts of their payload; those of payloads with more than `hot` rows do so by a broadcast (behind a check of its size), which leaves them where they are.

Rows: a null html is the empty payload; a null page_id never is what others refer to, and is a revisit if
a page with an id has the same payload; rows that repeat the smallest page_id of a payload are all responses; a url with line
breaks stands in the header with %0D and %0A, and as it is in base64 beside it; an empty table gives empty stores; columns other
than id, url and html are not read.  A record whose length or digest isn't that of its header raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, tasks_for, with_facts

LEAST, HOT = 100, 20_000
DATE = "2024-01-01T00:00:00Z"


def bucketed(df: DataFrame, name: str, n: int) -> DataFrame:
    """df as a table in the shared folder in n buckets by digest."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "digest").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = DATE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written to the shared folder."""
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    # digests and ids only; summed on the map side, so a payload that a third of the pages share is a row a task
    first = stored(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "warc-first")
    joined = with_facts(rows.drop("payload"), first, ["digest"], hot)
    revisit = (F.col("length") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # urls come from the open web: a line break in one must not start a new header line
    url = F.coalesce("url", F.lit(""))
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.when(url.rlike(r"[\r\n]"), F.concat(F.lit("X-Target-URI-Base64: "), F.replace(F.base64(F.encode(url, "UTF-8")), F.lit("\r\n"), F.lit("")))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("length")).cast("string")),
    ]
    headers = joined.select("page_id", "digest", revisit.alias("revisit"), F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("header"))
    # by digest and id, so that the rows of a very frequent payload are dealt over many tasks
    keep = rows.select("digest", F.col("page_id").alias("first"), "payload")
    once = keep.join(first.where("first is not null").select("digest", "first"), ["digest", "first"]).dropDuplicates(["digest", "first"]).select("digest", "payload")
    nameless = first.where("first is null").select("digest")
    rest = keep.where("first is null").join(nameless, "digest").dropDuplicates(["digest"]).select("digest", "payload")
    n = tasks_for(pages)
    return bucketed(headers, "warc_headers", n), bucketed(once.unionByName(rest), "warc_payloads", n)


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each record from the stores: page_id, digest, header, payload (the full one, of a revisit too), record (header,
    content block and the two line ends, as it stands in a WARC file) and digest_ok."""
    rows = headers.join(payloads, "digest")
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return rows.select("page_id", "digest", "header", "payload", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"), (F.sha2("payload", 256) == F.col("digest")).alias("digest_ok"))


def header_field(name: str, rest: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: {rest}\r\n", 1), F.lit(""))


def parsed(records_: DataFrame) -> DataFrame:
    """header, block (the content), of records (record: bytes); a record of another length than its header tells raises."""
    # header lines have no line end inside, so the first empty line ends the header
    rows = records_.select("record", F.concat(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1), F.lit("\r\n\r\n")).alias("header"))
    rows = rows.withColumns({"_at": F.octet_length("header"), "_size": header_field("Content-Length", "([0-9]+)").cast("int")})
    whole = F.col("header").startswith("WARC/1.1\r\n") & (F.octet_length("record") == F.col("_at") + F.col("_size") + 4) & (F.expr("substring(record, _at + _size + 1, 4)") == F.lit(b"\r\n\r\n"))
    block = F.when(whole, F.expr("substring(record, _at + 1, _size)")).otherwise(F.raise_error(F.lit("broken WARC record")).cast("binary"))
    return rows.select("header", block.alias("block"))


def fields_of(rows: DataFrame) -> DataFrame:
    """rows with page_id, digest, record_type, refers_to of their header."""
    return rows.withColumns({
        "page_id": header_field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long"), "digest": header_field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})"),
        "record_type": header_field("WARC-Type", "([a-z]+)"), "refers_to": header_field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long"),
    })


def read_archive(headers: DataFrame, payloads: DataFrame, *, hot: int = HOT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    Response records are put together, parsed, and their content is held against the digest in the header; a revisit's payload is that of
    the response with its digest, of which only size and digest go on to it."""
    responses = fields_of(parsed(records(headers.where("not revisit"), payloads)))
    found = F.sha2("block", 256)
    checked = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("payload of another digest than "), "digest")).cast("string"))
    responses = stored(responses.select("page_id", "digest", F.octet_length("block").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to"), "warc-responses")
    revisits = fields_of(headers.where("revisit").select("header")).drop("header")
    counts = revisits.groupBy("digest").agg(F.count("*").alias("n"))
    facts = stored(responses.select("digest", "payload_bytes", "payload_digest").join(counts, "digest").dropDuplicates(["digest"]), "warc-facts")
    return responses.drop("digest").unionByName(with_facts(revisits, facts, ["digest"], hot).drop("digest", "n"))
