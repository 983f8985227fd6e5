"""Prefix tries of conversations: which prefixes are shared, by how many, and what sharing them saves.

Conversations become sequences of turn digests. Distinct sequences are sorted over ranges, so a sequence adds the nodes that lie
deeper than what it has in common with the one before it: that gives every node its preorder place. The end of its subtree is the
place of the last sequence below it. With these intervals, leaves and savings of all subtrees are differences of prefix sums, which are
worked out in buckets of places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read_table

#: Bytes of a turn's digest, the front of a SHA-256: two of 10^12 different turns have the same with a chance of 10^-15.
WIDTH = 16
#: Bytes of a node's key, likewise.
KEY = 16
#: Prefix sums are worked out in so many buckets of places at most, each with so many places at least.
BUCKETS, BUCKET_ROWS = 4096, 1024
#: Parents with more children are broadcast (at most one in so many nodes has that many).
MANY_CHILDREN = 100_000
#: Ids of a list that one task puts together; longer lists are hashed piece by piece.
PIECE = 2048


def turn_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (digest, bytes) of each conversation's turns, in order.

    ``turns`` has conv_id, turn, role, text and any other columns. Null turns come first, equal turns are ordered by their digests, repeated rows
    count as often as they occur; null roles and texts are empty. Rows without a conv_id belong to no conversation. A text of
    any length becomes 16 bytes before anything is shuffled; a conversation is one row of 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart.
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").isNotNull().alias("has"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences in order: adds how many turns each has in common with the one before it in its partition (-1: it is the first)."""
    last = None
    for b in batches:
        shared = []
        for path in b.column("path").to_pylist():
            if last is None:
                shared.append(-1)
            else:
                most = min(len(path), len(last)) // WIDTH
                lo = 0
                while lo < most and path[lo * WIDTH : (lo + 1) * WIDTH] == last[lo * WIDTH : (lo + 1) * WIDTH]:
                    lo += 1
                shared.append(lo)
            last = path
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared, pa.int32())], names=[*b.schema.names, "shared"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence and depth: the node's key, its parent's key, its place if this sequence adds it, the sequence's place."""
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("place", pa.int64()), ("end", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("bytes", pa.int64())])
    for b in batches:
        out: list[list] = [[] for _ in schema]
        for path, sizes, shared, before, conv, n in zip(*(b.column(c).to_pylist() for c in ("path", "sizes", "shared", "before", "conv_id", "n_convs")), strict=True):
            depth = len(path) // WIDTH
            end = before + depth - shared
            chain = hashlib.sha256()
            key = None
            for d in range(depth + 1):
                if d:
                    chain.update(path[(d - 1) * WIDTH : d * WIDTH])
                parent, key = key, chain.digest()[:KEY]
                for column, x in zip(out, (key, parent, d, before + d - shared if d > shared else None, end, conv, n, sizes[d - 1] if d else 0), strict=True):
                    column.append(x)
            if len(out[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                out = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _ordered(sequences: DataFrame) -> DataFrame:
    """Distinct sequences with the members' smallest id and number, ``shared`` and ``before``: the places that come before a sequence's own."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    paths = sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    distinct = paths.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("sizes").alias("sizes"))
    ranged = distinct.repartitionByRange("path").sortWithinPartitions("path")
    laid = checkpoint(ranged.mapInArrow(_lay_out, "path binary, conv_id long, n_convs long, sizes array<long>, shared int").withColumns({"pid": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    # One row a partition: the turns that its first sequence has in common with the last one before, and the places that come before it.
    turns = (F.octet_length("path") / WIDTH).cast("int")
    edges = laid.groupBy("pid").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.sum(F.when(F.col("shared") >= 0, turns - F.col("shared")).otherwise(turns)).alias("places"))
    order = Window.partitionBy(F.lit(0)).orderBy("pid")
    edges = edges.withColumn("previous", F.lag("last").over(order))
    piece = lambda c: F.transform(F.sequence(F.lit(1), (F.octet_length(c) / WIDTH).cast("int"), F.lit(1)), lambda k: F.substring(F.col(c), (k - 1) * WIDTH + 1, F.lit(WIDTH)))
    pieces = lambda c: F.when(F.octet_length(c) > 0, piece(c)).otherwise(F.array().cast("array<binary>"))
    # Where they part; nulls pad the shorter one.
    parts = F.array_position(F.zip_with(pieces("previous"), pieces("first"), lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    edges = edges.withColumn("common", F.when(F.col("previous").isNull(), 0).when(parts == 0, F.least(F.size(pieces("previous")), F.size(pieces("first")))).otherwise(parts - 1).cast("int"))
    # The root has place 1; the first sequence's turns come after it.
    starts = edges.select("pid", "common", (1 + F.coalesce(F.sum(F.col("places") - F.col("common")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    rows = laid.join(F.broadcast(starts), "pid").withColumn("shared", F.when(F.col("shared") < 0, F.col("common")).otherwise(F.col("shared")))
    own = F.coalesce(F.sum(turns - F.col("shared")).over(Window.partitionBy("pid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("path", "sizes", "conv_id", "n_convs", "shared", (F.col("start") + own).alias("before"))


def _ends(sequences: DataFrame) -> DataFrame:
    """(end_key, ends_sha256): the digest of the ids of the conversations that are a sequence as a whole, in ascending order.

    Ids are put together by pieces of at most some thousand; a sequence with more pieces has them hashed in order as a stream, so none is in memory.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = sequences.select(F.unhex(F.sha2(path, 256)).alias("long_key"), "conv_id").select(F.substring("long_key", 1, KEY).alias("end_key"), "conv_id")
    counts = rows.groupBy("end_key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    # The keys with many ids are at most one in PIECE of all conversations; few texts are that frequent, so AQE broadcasts them or deals them out.
    many = counts.where(F.col("n") > PIECE)
    joined = lambda ids: F.array_join(F.transform(F.array_sort(F.collect_list(ids)), lambda x: x.cast("string")), ",")
    few = rows.join(many, "end_key", "left_anti").groupBy("end_key").agg(F.sha2(joined("conv_id"), 256).alias("ends_sha256"))
    width = F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / PIECE))
    pieces = rows.join(many, "end_key").groupBy("end_key", F.floor((F.col("conv_id") - F.col("low")) / width).alias("piece")).agg(joined("conv_id").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = chain = None
        schema = pa.schema([("end_key", pa.binary()), ("ends_sha256", pa.string())])
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([chain.hexdigest()])], schema=schema)
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if chain is not None:
                        yield row()
                    key, chain = k, hashlib.sha256(ids.encode())
                else:
                    chain.update(b"," + ids.encode())
        if chain is not None:
            yield row()

    whole = pieces.repartition("end_key").sortWithinPartitions("end_key", "piece").mapInArrow(digests, "end_key binary, ends_sha256 string")
    return few.unionByName(whole)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), turns being an array of (digest, bytes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the interval of its subtree as place and end.

    conv_id is the smallest of those that begin with the node's turns. Repeated conversations are members as often as they occur. No conversations: no
    nodes, not even the root. Ties in order don't exist among different sequences. A prefix that all conversations share is one row: counts,
    smallest ids and subtree ends are gathered with partial aggregation.
    """
    nodes = _ordered(sequences).mapInArrow(_nodes, "key binary, parent binary, depth long, place long, end long, conv_id long, n_convs long, bytes long")
    gathered = nodes.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.coalesce(F.min("place"), F.lit(1)).alias("place"), F.max("end").alias("end"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("bytes").alias("bytes"),
    )
    gathered = checkpoint(gathered)
    last = gathered.agg(F.max("place")).first()[0]
    width = max(BUCKET_ROWS, -(-(last or 1) // BUCKETS))
    bucket = F.floor((F.col("place") - 1) / width)
    own = gathered.select("key", "place", "end", bucket.alias("bucket"), (F.col("place") == F.col("end")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = own.groupBy("bucket").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows, or one for BUCKET_ROWS places
    totals = totals.select("bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("leaf", "saved")))
    upto = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = own.join(F.broadcast(totals), "bucket").select("key", "place", "end", "leaf", "saved", *((F.col(f"{c}_before") + F.sum(c).over(upto)).alias(f"{c}_sum") for c in ("leaf", "saved")))
    tops = sums.select("key", "end", *((F.col(f"{c}_sum") - F.col(c)).alias(f"{c}_top") for c in ("leaf", "saved")))
    ends = sums.select(F.col("place").alias("end"), *(F.col(f"{c}_sum") for c in ("leaf", "saved")))
    spans = tops.join(ends, "end").select("key", (F.col("leaf_sum") - F.col("leaf_top")).alias("n_leaves"), (F.col("saved_sum") - F.col("saved_top")).alias("saved_tokens"))
    children = gathered.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "key")
    all_nodes = gathered.join(spans, "key").join(children, "key", "left").join(_ends(sequences).withColumnRenamed("end_key", "key"), "key", "left")
    all_nodes = checkpoint(all_nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # Each child needs its parent's conv_id. A parent of very many children is one of few, so those go to all tasks.
    many = max(MANY_CHILDREN, (last or 1) // MANY_CHILDREN)
    ids = all_nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = ids.where(F.col("n_children") > many).select("parent", F.col("parent_conv_id").alias("large_conv_id"))
    found = all_nodes.join(F.broadcast(large), "parent", "left")
    rest = found.where("large_conv_id IS NULL").join(ids.where(F.col("n_children") <= many).drop("n_children"), "parent", "left")
    out = rest.unionByName(found.where("large_conv_id IS NOT NULL").withColumn("parent_conv_id", F.col("large_conv_id")))
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "place", "end")


def rebuilt(sequences: DataFrame, base: Column, head: Column) -> DataFrame:
    """Conversations whose first ``head`` turns are those of conversation ``base`` (fewer if it has fewer, none if there is none); their own follow from there on."""
    rows = sequences.select("conv_id", "turns", base.alias("base"), head.cast("int").alias("head"))
    # A base that is a conversation of its own needs no other one.
    others = rows.where("base <> conv_id").join(sequences.select(F.col("conv_id").alias("base"), F.col("turns").alias("front")), "base", "left")
    none = F.slice("turns", 1, 0)
    front = F.coalesce(F.slice("front", F.lit(1), F.col("head")), none)
    rest = F.when(F.size("turns") > F.col("head"), F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))).otherwise(none)
    return rows.where("base = conv_id").select("conv_id", "turns").unionByName(others.select("conv_id", F.concat(front, rest).alias("turns")))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of ``conversations``, each rebuilt on the first turns of its group of five."""
    convs = checkpoint(turn_sequences(read_table(spark, sf_dir, "conversations")))
    id_ = F.col("conv_id")
    sequences = checkpoint(rebuilt(convs, id_ - id_ % 5, F.crc32(id_.cast("string")) % 9))
    return prefix_trie(sequences).drop("place", "end")


#: crc32 as a table of 256 values, made by its rule, and a fold over a text's bytes.
_CRC = """crc_steps AS (SELECT i, 0 AS step, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_steps WHERE step = 8)"""

OP13_SQL = f"""WITH RECURSIVE {_CRC}, turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), joined AS (
  SELECT c.conv_id, t.d, 0 AS part, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.d <= c.h
  UNION ALL SELECT c.conv_id, t.d, 1, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.d > c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, bytes, list(digest) OVER (PARTITION BY conv_id ORDER BY part, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, d)
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs
), steps AS (SELECT conv_id, depth, bytes, sha256(array_to_string(path, ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(path[:-2], ',')) END AS up FROM rebuilt
), lasts AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id
), nodes AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM steps GROUP BY node
), children AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), ends AS (SELECT s.node, string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) AS ids FROM steps s JOIN lasts l ON s.conv_id = l.conv_id AND s.depth = l.depth GROUP BY s.node
), sums AS (
  SELECT s.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n LEFT JOIN children c ON c.node = n.node JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.up LEFT JOIN children c ON c.node = n.node LEFT JOIN ends e ON e.node = n.node JOIN sums ON sums.node = n.node"""
