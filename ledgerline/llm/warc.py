"""WARC archives: write pages with revisit records, and read them back by boundary-chain verification.

Archives are written and read by Spark's text source, so any store that Spark
reaches will do.  Reading splits a file at every ``WARC/1.1`` line, in byte
ranges that go to different tasks; each piece is a candidate record, whose
header gives the offset at which its successor must start.  A payload may
hold such lines too.  Pointer jumping from offset 0 of each file marks the
candidates that the chain of successors reaches, in log2(records) rounds; the
others belong to the payload of the record before them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialise

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
ID_PREFIX = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, five hex digits, are four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_digest(html_col: str) -> Column:
    """SHA-256 of the payload: with the id it tells which rows are revisits."""
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary"), 256))


def revisits(pages: DataFrame, id_col: str, html_col: str, least: int) -> DataFrame:
    """(rev_id, rev_digest, refers_to), once each, of the payloads that a page with a smaller id has too."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    slim = materialise(pages.filter(F.col(f"`{id_col}`").isNotNull()).filter(F.length(payload) >= least)
                       .select(F.col(f"`{id_col}`").alias("rev_id"), payload_digest(html_col).alias("rev_digest")), "payloads")
    first = (slim.groupBy("rev_digest").agg(F.min("rev_id").alias("refers_to"), F.max("rev_id").alias("last"))
             .filter("last > refers_to").drop("last"))
    out = materialise(slim.join(materialise(first, "repeated"), "rev_digest").filter("rev_id > refers_to")
                      .select("rev_id", "rev_digest", "refers_to").distinct(), "revisits")
    discard(slim)
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          least: int = 0) -> None:
    """One record per page into the archives of folder ``path``.

    A payload of at least ``least`` bytes that a page with a smaller id has too
    is written once, by the page with the smallest id (ties: by each of them);
    the others are revisit records.  Rows that share an id are pages each, judged by
    their own payload.  Null payloads are empty; pages with a null
    id are responses; line breaks in a url become spaces.
    """
    seen = revisits(pages, id_col, html_col, least)
    rev, ref, digest = (free_name(pages, c) for c in ("rev_id", "refers_to", "rev_digest"))
    own = free_name(pages, "own_digest")
    seen = seen.withColumnsRenamed({"rev_id": rev, "refers_to": ref, "rev_digest": digest})
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"[\r\n]", " ")
    again = F.col(ref).isNotNull()
    name = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col(f"`{id_col}`")),
        F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(html.cast("binary")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col(ref)))).otherwise(F.lit("")),
        F.when(again, F.concat(F.lit("\r\nX-Payload-Bytes: "), F.octet_length(html).cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.when(again, F.lit(0)).otherwise(F.octet_length(html)).cast("string"),
        F.lit(BLANK), F.when(again, F.lit("")).otherwise(html))
    (pages.withColumn(own, payload_digest(html_col))
     .join(seen, (F.col(f"`{id_col}`") == F.col(rev)) & (F.col(own) == F.col(digest)), "left")
     .select(record.alias("value")).write.option("lineSep", BLANK).text(path))


def header_field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\r\n){name}: *([^\r\n]*)", 1)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): each piece of the archives between two ``WARC/1.1`` lines, numbered within its byte range.

    ``file`` is a hash of the path, so that what is joined by it stays slim.
    """
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("value")))


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, block, place, offset, end, next): candidate records with their offsets and that of their successor.

    A byte range's task adds up the bytes of its pieces; one total per range
    gives the ranges their start within the file.  ``next`` is null where a
    piece has no header with a Content-Length.
    """
    text = F.col("value").cast("string")
    cut = F.instr(text, BLANK)
    slim = pieces.select("file", "block", "place", F.octet_length("value").cast("long").alias("bytes"),
                         F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).alias("head"))
    length = header_field("Content-Length")
    slim = materialise(slim.select(
        "file", "block", "place", "bytes",
        F.when(length.rlike(r"^\d{1,18}$"),
               F.octet_length("head") + 2 * len(BLANK) + length.try_cast("long")).alias("needs")), "pieces")
    magic = len(MAGIC)
    within = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = slim.groupBy("file", "block").agg(F.sum(F.col("bytes") + magic).alias("total"))
    ranges = ranges.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = (slim.withColumn("at", F.coalesce(F.sum(F.col("bytes") + magic).over(within), F.lit(0)))
              .join(ranges, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at") - magic))
    # what stands before a file's first line of the kind has a negative offset, and no chain leads there
    out = materialise(placed.select(
        "file", "block", "place", "offset", (F.col("offset") + magic + F.col("bytes")).alias("end"),
        (F.col("offset") + magic + F.col("needs")).alias("next")), "candidates")
    discard(slim)
    return out


def exits_of_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each candidate's chain leaves its byte range."""
    out: dict[int, int] = {}
    for offset, nxt in sorted(zip(pdf["offset"], pdf["next"], strict=True), reverse=True):
        out[offset] = out.get(nxt, nxt)
    pdf["exit"] = pdf["offset"].map(out)
    return pdf[["file", "block", "offset", "exit"]]


def reached_in_range(key, pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a byte range that lie on a chain from one of its entries."""
    step, seen = dict(zip(pdf["offset"], pdf["next"], strict=True)), set()
    for at in entries["offset"]:
        while at in step and at not in seen:
            seen.add(at)
            at = step[at]
    return pd.DataFrame({"file": key[0], "reached": sorted(seen)})


def reachable(chain: DataFrame) -> DataFrame:
    """(file, reached): offsets on the chain that starts at offset 0 of each file.

    Each byte range first joins its own links, so that pointer jumping is over
    the few offsets at which chains enter a range: log2(ranges) rounds.
    """
    links = chain.filter("next IS NOT NULL").select("file", "block", "offset", "next")
    exits = materialise(links.groupBy("file", "block").applyInPandas(
        exits_of_range, "file long, block long, offset long, exit long"), "exits")
    entered = exits.select("file", F.col("exit").alias("offset")).distinct()
    nodes = materialise(exits.join(entered, ["file", "offset"], "left_semi").unionByName(exits.filter("offset = 0"))
                        .distinct(), "nodes")
    jump = nodes.select("file", F.col("offset").alias("from"), F.col("exit").alias("to"))
    reached, n = nodes.filter("offset = 0").select("file", "offset"), -1
    scratch = []
    while True:
        found = reached.join(jump, (reached["file"] == jump["file"]) & (reached["offset"] == jump["from"])).select(
            reached["file"], F.col("to").alias("offset"))
        reached = materialise(reached.unionByName(found).distinct(), "reached")
        scratch.append(reached)
        n, was = reached.count(), n
        if n == was:
            break
        far = jump.select("file", F.col("from").alias("to"), F.col("to").alias("far"))
        jump = materialise(jump.join(far, ["file", "to"]).select("file", "from", F.col("far").alias("to")), "jump")
        scratch.append(jump)
    entries = materialise(nodes.join(reached, ["file", "offset"], "left_semi").select("file", "block", "offset"), "entries")
    out = materialise(links.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(
        reached_in_range, "file long, reached long"), "chain")
    discard(exits, nodes, entries, *scratch)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives of folder ``path``: record_id, record_type, url, refers_to, digest, payload_bytes, payload.

    ``payload_bytes`` is that of the full payload, ``payload`` what the record
    itself holds.  A record that does not end where a record or the file's end
    follows is damaged: it is left out, with what comes after it in its file.
    """
    # stored once: byte ranges follow the number of live cores, so a second scan could number the pieces otherwise
    pieces = materialise(pieces_of(spark, path), "archive-pieces")
    chain = candidates(pieces)
    on_chain = reachable(chain)
    ends = chain.groupBy("file").agg(F.max("end").alias("file_end"))
    # offsets on the chain grow with the archives: never a broadcast, also where they are still few
    chain = chain.hint("merge").join(on_chain, (chain["file"] == on_chain["file"]) & (chain["offset"] == on_chain["reached"]), "left").select(
        chain["*"], "reached").join(ends, "file")
    chain = materialise(chain, "linked")
    # within each byte range, and from range to range by one row a range
    inside = Window.partitionBy("file", "block").orderBy("offset")
    across = Window.partitionBy("file").orderBy("block")
    ranges = chain.groupBy("file", "block").agg(F.max("reached").alias("last"), F.min_by("reached", "offset").alias("first")).select(
        "file", "block", F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("owner_before"),
        F.lead("first").over(across).alias("first_after"))
    chain = (chain.withColumn("owner", F.last("reached", ignorenulls=True).over(inside))
             .withColumn("follower", F.lead("reached").over(inside)).withColumn("more", F.lead("offset").over(inside))
             .join(ranges, ["file", "block"])
             .withColumn("owner", F.coalesce("owner", "owner_before"))
             .withColumn("follower", F.when(F.col("more").isNull(), F.col("first_after")).otherwise(F.col("follower"))))
    # a whole record of one piece: the next piece starts where it ends, and is on the chain too
    plain = F.col("reached").isNotNull() & (F.col("next") == F.col("end")) & (
        F.col("follower").isNotNull() | (F.col("end") == F.col("file_end")))
    odd = materialise(chain.filter(~F.coalesce(plain, F.lit(False))).select("file", "block", "place", "offset", "owner", "next"), "odd")
    keys = ["file", "block", "place"]
    one = pieces.join(odd.select(*keys), keys, "left_anti").select("value")
    # records that hold such lines: their pieces together, which the chain's next offset must end
    parts = F.sort_array(F.collect_list(F.struct("offset", "value", "next")))        # the pieces of one record
    many = (pieces.join(odd.filter("owner IS NOT NULL"), keys).groupBy("file", "owner").agg(parts.alias("parts"))
            .select(F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0))["value"],
                                lambda a, p: F.concat(a, F.lit(MAGIC).cast("binary"), p["value"])).alias("value"),
                    (F.get("parts", F.lit(0))["next"] - F.col("owner") - len(MAGIC)).alias("needs"))
            .filter(F.octet_length("value") == F.col("needs")).select("value"))
    text = F.col("value").cast("string")
    out = one.unionByName(many).withColumn("head", F.substr(text, F.lit(1), F.instr(text, BLANK) - 1))
    length = header_field("Content-Length").try_cast("long")
    start = F.octet_length("head") + len(BLANK) + 1
    field = lambda name: F.nullif(header_field(name), F.lit(""))
    return out.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"),
        header_field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("digest"),
        F.coalesce(field("X-Payload-Bytes").try_cast("long"), length).alias("payload_bytes"),
        F.substr(F.col("value"), start, length.cast("int")).alias("payload"))
