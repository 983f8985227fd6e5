"""Work that must not grow with what the rows repeat, or with how files are laid out."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyworks.functions.memo import Memory
from tallyworks.operators import examples
from tallyworks.plans import qa, worded

KIND = pa.struct([("n", pa.int64()), ("t", pa.list_(pa.string()))])


def test_memory_makes_equal_rows_once_and_forgets_when_full():
    for room in (10, 100, 1 << 20):
        made = []
        memory = Memory(lambda x: made.append(x) or {"n": len(x or ""), "t": [x, x]}, KIND, room)  # noqa: B023
        for batch in ([], ["a", "bb", "a"], ["bb", None, "bb"], ["c" * 70000, "d"], ["d", "a", None], []):
            keys = [(x,) for x in batch]
            got = memory(keys, lambda at, keys=keys: [keys[k] for k in at]).to_pylist()
            assert got == [{"n": len(x or ""), "t": [x, x]} for x in batch]
        assert memory.size <= room + 1000
        if room > 100:
            assert len(made) == 6 and made.count("d") == 2  # the batch with a very long text isn't kept


def test_rows_with_equal_texts_are_made_once_in_a_task(spark, tmp_path):
    log = tmp_path / "calls"

    def one(t, s):
        with open(log, "a") as f:
            f.write("x")
        return {"shown": f"{t} {s}"}

    rows = spark.range(0, 5000, 1, 1).select("id", F.concat(F.lit("q"), F.col("id") % 7).alias("t"), F.when(F.col("id") % 7 != 3, F.struct((F.col("id") % 7).alias("k"), F.lit(None).cast("int").alias("z"))).alias("s"))
    expected = {k: f"q{k % 7} " + ("None" if k % 7 == 3 else str({"k": k % 7, "z": None})) for k in range(5000)}
    for inputs in (["t", "t"], ["t", "s"]):
        log.write_text("")
        got = {r.id: r.shown for r in examples.with_rows(rows, inputs, "shown string", one).collect()}
        assert got == (expected if inputs[1] == "s" else {k: f"q{k % 7} q{k % 7}" for k in range(5000)})
        assert len(log.read_text()) == 7


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    pq.write_table(pa.table({"o_orderkey": range(40_000)}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"p_partkey": range(40_000)}), tmp_path / "part.parquet")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        for rows in (qa.derive(spark, str(tmp_path)), worded.derive(spark, str(tmp_path))):
            assert spark.read.parquet(str(tmp_path / "orders.parquet")).rdd.getNumPartitions() > 4
            sizes = rows.groupBy(F.spark_partition_id()).count().toPandas()["count"]
            assert len(sizes) == 4 and sizes.max() < 16_000
        places = qa.derive(spark, str(tmp_path)).select("question", "answer", F.spark_partition_id().alias("p")).distinct()
        assert places.groupBy("question", "answer").count().where("count > 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_more_rows_are_more_tasks(spark):
    assert qa.partitions(spark.range(10)) == 4
    assert qa.partitions(spark.range(10 * qa.ROWS_A_TASK + 1)) == 11


def test_islands_with_equal_spans_equal_brute_force(spark):
    """Spans that are there twice, at the start of an island and inside one, in groups that many tasks share."""
    from random import Random

    from tallyworks.functions import scan

    random = Random(5)
    spans = [(k % 300, s, s + random.randrange(8)) for k in range(9000) for s in [random.randrange(120)]]
    spans += [x for x in spans if random.random() < 0.3]
    random.shuffle(spans)
    expected = []
    for g in range(300):
        own = sorted((s, e) for k, s, e in spans if k == g and e > s)
        merged: list[list[int]] = []
        for s, e in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expected += [(g, s, e) for s, e in merged]
    rows = spark.createDataFrame(spans, "g long, start long, end long").repartition(7)
    assert sorted(map(tuple, scan.merge_spans(rows, "g").collect())) == sorted(expected)


def test_equal_texts_count_by_weights(spark):
    """Figures of different texts, counted as often as they are there, are those of all rows; none are those of no rows."""
    from tallyworks.operators import audit, evaluation

    rows = qa.texts(spark.range(90).selectExpr("id % 9 + 3 AS a", "id % 5 + 2 AS b", "id % 3 + 1 AS c", "id % 15 AS k")).withColumn("generated_text", F.col("answer"))
    for some in (rows, rows.limit(0)):
        for inputs, whole, weighed in (
            (("question", "answer"), lambda df: audit.sums(audit.audit(df)), lambda df: audit.sums(audit.audit(df), "times")),
            (("generated_text", "reference"), lambda df: evaluation.sums(evaluation.score(df)), lambda df: evaluation.sums(evaluation.score(df), weight="times")),
        ):
            texts = examples.counted(some, *inputs)
            a, b = whole(some), weighed(texts)
            assert texts.count() == some.select(*inputs).distinct().count() and a.dtypes == b.dtypes
            a, b = a.first().asDict(), b.first().asDict()
            assert all(x == b[c] or abs(x - b[c]) < 1e-9 * abs(x) for c, x in a.items())


def test_features_are_made_once_for_equal_texts(spark, tmp_path):
    from tallyworks import queries

    pq.write_table(pa.table({"o_orderkey": [k % 40 for k in range(4000)]}), tmp_path / "orders.parquet")
    sizes = []
    got = queries._of_texts(spark, str(tmp_path), lambda tokens: sizes.append(tokens.count()) or tokens.withColumn("made", F.size("offsets")))
    assert sizes == [40] and got.count() == 4000 and got.select("example_id", "made").distinct().count() == 40
