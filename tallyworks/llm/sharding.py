"""Proportional stratified interleaving of rows into shards, in DataFrame operations only.

Rows of a source are put in a seeded shuffle order and get a fractional rank (r - 1 + u) / n within it, where u is a
digest of the source's name as a number below one: the rows of a source are evenly apart, and sources of one row
each, however many, are spread over the whole sequence. All rows sorted by fractional rank are a sequence in which every stretch has the sources' mixture, and that
sequence is cut into equal runs of rows. Neither ranking is one big window: rows are counted in buckets
of the sort key, the counts are summed up over the buckets (a bounded table), and ranks are taken within
buckets, which hold a bounded share of even the largest source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the shuffle order of each source, and of the fractional rank. Prefix sums read this many rows.
BUCKETS = 1 << 14


def _ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``name``: the 0-based rank of each row in its group by (bucket, order); ``__of``: the group's rows."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("__of"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    ranked = rows.join(offsets, [*group, "__bucket"])
    return ranked.withColumn(name, F.col("__before") + F.row_number().over(inside) - 1).drop("__bucket", "__before")


def start(stratum: Column) -> Column:
    """Where between its neighbours a source's rows stand: a double from 0 to 1 that only its name decides."""
    return (F.conv(F.substring(F.md5(stratum.cast("binary")), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row.

    Texts may be of any length: only their sizes and checksums are shuffled. An empty table gives an empty result. A null source is a stratum of its own, a null text has no bytes (size 1), rows with the same id or
    the same text are separate rows, and ties beyond id, size and checksum are between equal results.
    Shards differ by one row at most; fewer rows than shards leave the last ones empty.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("__stratum"),
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(data, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("__key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary")))
    first = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    ties = [F.col("__key"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    rows = _ranked(rows, ["__stratum"], F.shiftright(first * F.lit(BUCKETS), 32), ties, "__rank")
    rows = rows.withColumn("__share", (F.col("__rank") + start(F.col("__stratum"))) / F.col("__of")).drop("__of", "__rank")
    bucket = F.floor(F.col("__share") * BUCKETS)
    rows = _ranked(rows.withColumn("__all", F.lit(0)), ["__all"], bucket, [F.col("__share"), F.col("__stratum"), *ties], "__at")
    shard = F.expr(f"CAST((__at * {shards}) DIV __of AS INT)")
    begins = F.expr(f"(((__at * {shards}) DIV __of) * __of + {shards} - 1) DIV {shards}")
    return rows.select("doc_id", "source", "size", "text_crc32", shard.alias("shard"), (F.col("__at") - begins).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    rows = interleave(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
