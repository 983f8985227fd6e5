"""Samples, frozen splits and their fingerprints. Orders come from digests, so every engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .examples import example_key

REQUIRED = ("question", "answer")


def check_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def check_source(df: DataFrame, rows: int = 2) -> DataFrame:
    if check_columns(df).limit(rows).count() < rows:
        raise ValueError(f"a source split needs {rows} rows or more")
    return df


def seeded(seed: int, key: Column) -> Column:
    """A digest that orders rows by a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sample(df: DataFrame, size: int | None, seed: int, key: str) -> DataFrame:
    """``size`` rows in seeded order, or all if there are fewer (None: all). A top-k, no full sort."""
    if size is None:
        return df
    if size <= 0:
        raise ValueError("a sample needs a positive size")
    return df.orderBy(seeded(seed, F.col(key)), key).limit(size)


def assign(df: DataFrame, fraction: float, seed: int, key: str, parts: int = 4096) -> DataFrame:
    """Adds split: the first ceil(fraction * rows) in seeded order are validation, all others train.

    Ranks are taken within buckets of the digest and added to the buckets' sums, so no task sorts all rows.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    rows = df.withColumn("__order", seeded(seed, F.col(key)))
    rows = rows.withColumn("__bucket", F.shiftright(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * parts, 32))
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    all_rows = Window.partitionBy(F.lit(0))  # `parts` rows at most
    before = all_rows.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(all_rows).alias("__total"))
    inside = Window.partitionBy("__bucket").orderBy("__order", key)
    ranked = rows.join(F.broadcast(counts), "__bucket").withColumn("__at", F.col("__before") + F.row_number().over(inside))
    return ranked.withColumn("split", F.when(F.col("__at") <= F.ceil(F.lit(fraction) * F.col("__total")), "validation").otherwise("train")).select(*df.columns, "split")


#: Rows of a group that ``ordered_hash`` takes (64 characters each, in one row).
ORDERED_ROWS = 10_000_000


def ordered_hash(df: DataFrame, order: str, *by: str, limit: int = ORDERED_ROWS) -> DataFrame:
    """SHA-256 over the rows' keys in order, for each group. One row of a split's size is built, as the digest demands:
    groups of more than ``limit`` rows are refused before that; ``part_hash`` is for these."""
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > limit:
        raise ValueError(f"a group of {most} rows is too large for an ordered digest (at most {limit}): use part_hash")
    keys = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), example_key(F.col("question"), F.col("answer")).alias("k"))))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(keys, lambda x: x["k"]), ""), 256).alias("digest"))


def part_hash(df: DataFrame, order: str, *by: str, parts: int = 4096, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A fingerprint of any size of split: rows and the digest of ``parts`` digests, each over the ordered rows of one part.

    A row's part comes from its order key, so any partitioning gives the same digest; a task holds one part of a
    group, 64 characters a row. Other than ``ordered_hash`` it depends on ``parts``.
    """
    key = F.sha2(F.to_json(F.struct(F.col(order), *(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    part = F.pmod(F.conv(F.substring(F.sha2(F.coalesce(F.col(order).cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("long"), F.lit(parts)).alias("__part")
    rows = df.select(*by, part, F.struct(F.col(order).alias("o"), key.alias("k")).alias("__row"))
    inner = rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("__row")), lambda r: r["k"]), ""), 256).alias("__digest"))
    every = F.array_sort(F.collect_list(F.struct("__part", "__digest")))  # `parts` at most
    outer = F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["__part"].cast("string"), x["__digest"])), ";")
    return inner.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.sha2(outer, 256).alias("digest"))


def _range_of(key: Column, cuts: list[Column], low: int = 0) -> Column:
    """How many of the ascending ``cuts`` are at most ``key``, by halving: a row is compared with log2 of them."""
    if not cuts:
        return F.lit(low)
    half = len(cuts) // 2
    return F.when(key >= cuts[half], _range_of(key, cuts[half + 1 :], low + half + 1)).otherwise(_range_of(key, cuts[:half], low))


def _cuts(df: DataFrame, order: str, parts: int) -> list[Column]:
    """Ascending cuts of ``order`` into about ``parts`` ranges, from a bounded sample: the 16 * ``parts`` rows of the smallest digests of their keys."""
    picked = df.select(F.col(order).alias("o")).where("o IS NOT NULL").orderBy(F.xxhash64("o"), "o").limit(16 * parts)
    values = sorted({r.o for r in picked.collect()})  # 16 * parts keys at most
    cuts = sorted({values[len(values) * k // parts] for k in range(1, parts)}) if values else []
    return [F.lit(c).cast(df.schema[order].dataType) for c in cuts]


def sum_before(df: DataFrame, order: str, value: str, *by: str, parts: int = 256) -> DataFrame:
    """Adds __before: the sum of ``value`` over the rows of the same group whose ``order`` is less (0 if there are none).

    Ranges of ``order`` are summed up first, and only what lies in a row's own range is summed by a window, so no task has a whole group.
    """
    rows = df.withColumn("__range", _range_of(F.col(order), _cuts(df, order, parts)))
    sums = rows.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    lower = Window.partitionBy(*by, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows a group
    sums = sums.select(*(F.col(b).alias(f"__by{k}") for k, b in enumerate(by)), F.col("__range").alias("__to"), F.coalesce(F.sum("__sum").over(lower), F.lit(0)).alias("__lower"))
    same = F.col("__range") == F.col("__to")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    inside = Window.partitionBy(*by, "__range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, same).withColumn("__before", F.col("__lower") + F.col("__in")).select(*df.columns, "__before")


def ranked(df: DataFrame, order: str, *by: str, parts: int = 256) -> DataFrame:
    """Adds __rank, from 0, by ``order`` within each group (ties in any order); no task sorts a whole group.

    Cuts of a bounded sample (the 16 * ``parts`` rows of the smallest digests of their keys) deal rows into ranges; ranges
    are counted, and ranks are taken within a range of a group. Null keys come first.
    """
    rows = df.withColumn("__range", _range_of(F.col(order), _cuts(df, order, parts)))
    counts = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows a group
    counts = counts.select(*(F.col(b).alias(f"__by{k}") for k, b in enumerate(by)), F.col("__range").alias("__to"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__to")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order))
    return rows.withColumn("__in", inside).join(counts, same).withColumn("__rank", F.col("__before") + F.col("__in") - 1).select(*df.columns, "__rank")


def content_hash(df: DataFrame, order: str, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """SHA-256 over length-prefixed canonical JSON of the rows in order (8 bytes of length each), for samples of bounded size."""
    json = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(json)), 16, "0")), F.encode(json, "UTF-8"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(framed).alias("x"))))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.unhex(F.array_join(F.transform(rows, lambda r: r["x"]), "")), 256).alias("digest"))


def overlaps(df: DataFrame) -> DataFrame:
    """(left, right, n): how many different examples two splits share; pairs that share none are left out."""
    keys = df.select("split", example_key(F.col("question"), F.col("answer")).alias("key")).distinct()
    other = keys.withColumnRenamed("split", "right")
    return keys.withColumnRenamed("split", "left").join(other, "key").where("left < right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def check_disjoint(df: DataFrame) -> None:
    found = overlaps(df).collect()  # one row for each pair of splits
    if found:
        raise ValueError("splits share examples: " + ", ".join(f"{r.left} and {r.right}: {r.n}" for r in found))


def evaluation_samples(df: DataFrame, size: int = 300, seed: int = 42, key: str = "example_id") -> dict[str, tuple[DataFrame, DataFrame]]:
    """For train and validation: a fixed sample and its fingerprint."""
    out = {}
    for split in ("train", "validation"):
        rows = sample(df.where(F.col("split") == split), size, seed, key)
        out[split] = (rows, content_hash(rows, key))
    return out


def check_tokenized(df: DataFrame, splits: tuple[str, ...] = ("train", "validation"), required: tuple[str, ...] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    check_columns(df, ("split", *required))
    have = {r.split for r in df.where(F.col("split").isin(*splits)).select("split").distinct().collect()}  # the required ones at most
    if empty := [s for s in splits if s not in have]:
        raise ValueError(f"splits without rows: {empty}")
    return df
