import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import calculation, question
from tallyworks.operators import audit, evaluation, examples, features, hashtree, lineage, objective, splits
from tallyworks.plans import recipes, worded
from tallyworks.sources import frozen, pinned, shared

#: Questions with number words, and the values that are in them.
WORDED = (
    ("seventeen ducks and ninety-nine geese", "17 99"), ("two hundred and five of three million forty", "205 3000040"), ("the twenty-first of 30", "30"), ("one hundredth of five point two", ""),
    ("a quarter of it", "1/4"), ("three quarters of 8", "3/4 8"), ("four quarters in a purse", "4"), ("two and a half dozen", "5/2 12"), ("half a dozen", "6"), ("twice a day, once per week", "2 1"),
    ("a couple of owls and a triple jump", "2 3"), ("time-and-a-half for 1,250", "3/2 1250"), ("2 and one-third cups of 7/8", "7/3 7/8"), ("the third day", ""), ("five sixths", "5/6"), ("-4 and .5", "-4 1/2"),
)


@pytest.mark.parametrize("text,values", WORDED)
def test_number_words(text, values):
    assert " ".join(str(f.value) for f in question.numbers(text)) == values


def test_recipe_tables(spark):
    got = {r.recipe: sorted(r.losses) for r in recipes.plans(spark).collect()}
    assert got == {r: sorted(x) for r, x in recipes.RECIPES.items()}


def analyzed(spark, rows):
    return examples.analyze(spark.createDataFrame(rows, "example_id long, question string, answer string"))


DEEP = [
    (1, "4 and 5", "<<((1+2)*(3-4)-5)*(6+7)=-104>> <<2*(-3)+1=-5>> no <<5=5>> <<8/2=4>>"), (2, None, None), (3, "a third of 9", "<<1/3=1/3>> <<9*(1/3)=3>> <<3+1=4>> <<4-2/6=11/3>>"), (4, "2/4 of 2/4", "<<2/4=.5>> <<1/2+.5=1>> <<+2/4+1=1.5>>"),
]


def test_walks_are_pre_orders(spark):
    rows = analyzed(spark, DEEP)
    got = {}
    for r in sorted(lineage.pre_order(rows, "example_id").collect(), key=lambda r: (r.example_id, r.step, r.place)):
        got.setdefault((r.example_id, r.step), []).append((r.depth, r.op or r.value))
    want = {}
    for r in rows.collect():
        for s in r.steps:

            def walk(k, depth, out, nodes=s.nodes):
                out.append((depth, nodes[k].op or nodes[k].value))
                for c in nodes[k].args:
                    walk(c, depth + 1, out)
                return out

            if s.nodes:
                want[(r.example_id, s["index"])] = walk(len(s.nodes) - 1, 0, [])
    assert got == want and max(len(v) for v in want.values()) > 8


def test_joins_find_what_the_pass_over_rows_finds(spark, sf_dir):
    rows = spark.createDataFrame(DEEP, "example_id long, question string, answer string").unionByName(worded.derive(spark, sf_dir).select((F.col("example_id") + 10).alias("example_id"), "question", "answer"))
    by_joins = lineage.provenance(lineage.with_trees(rows)).groupBy("example_id", "step", "kind", "ref", F.size("candidates").alias("c")).count()
    nodes = examples.analyze(rows).select("example_id", F.explode("steps").alias("s")).select("example_id", F.col("s.index").alias("step"), F.explode("s.nodes").alias("x"))
    by_rows = nodes.groupBy("example_id", "step", "x.kind", "x.ref", F.size("x.candidates").alias("c")).count()
    assert {tuple(r) for r in by_joins.collect()} == {tuple(r) for r in by_rows.collect()}


def test_long_and_branching_lineage(spark):
    chain = [(1, k, k - 1) for k in range(1, 70)] + [(2, 3, 0), (2, 3, 1), (2, 1, 0)]
    got = {(r.example_id, r.step, r.rests_on): r.length for r in lineage.closure(spark.createDataFrame(chain, "example_id long, step int, dependency int")).collect()}
    assert got == {(1, a, b): a - b for a in range(70) for b in range(a)} | {(2, 3, 0): 2, (2, 3, 1): 1, (2, 1, 0): 1}
    with pytest.raises(ValueError):
        lineage.closure(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "example_id long, step int, dependency int"), rounds=4)


def test_hash_trees_open_only_what_differs(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("example_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    other = rows.where("example_id <> 7").withColumn("digest", F.when(F.col("example_id") == 1234, "x").otherwise(F.col("digest"))).unionByName(spark.createDataFrame([(5000, "y")], rows.schema))
    for name, x in (("a", rows.repartition(5)), ("b", other), ("c", rows.repartition(2))):
        hashtree.write_tree(x, f"{tmp_path}/{name}")
    a, b, c = (f"{tmp_path}/{x}" for x in "abc")
    assert {r.example_id for r in hashtree.tree_differences(spark, a, b).collect()} == {7, 1234, 5000}
    parts = hashtree.different_parts(spark, a, b)
    assert len(parts) <= 3 and hashtree.different_parts(spark, a, c) == [] and hashtree.tree_differences(spark, a, c).count() == 0
    # Of 256 parts, three at most are read.
    read = spark.read.parquet(f"{a}/rows").where(F.col("part").isin(parts))
    assert len(read.inputFiles()) > 200 and read.select("_metadata.file_path").distinct().count() <= 3


def test_pinned_tables(spark, tmp_path):
    table, pins = str(tmp_path / "t"), str(tmp_path / "pins")
    spark.createDataFrame([(k, "q", "a") for k in range(6)], "example_id long, question string, answer string").repartition(3).write.parquet(table)
    assert pinned.pin(spark, table, pins, "r1").count() == 3
    assert frozen.load_source(spark, table, manifest=pins, revision="r1").count() == 6
    with pytest.raises(Exception, match="(?i)exist"):
        pinned.pin(spark, table, pins, "r1")
    first = sorted((tmp_path / "t").glob("part*"))[0]
    for checksum in (tmp_path / "t").glob(".*.crc"):
        checksum.unlink()
    first.write_bytes(first.read_bytes()[:-1] + b"?")
    with pytest.raises(ValueError, match=f"{first.name} was changed"):
        pinned.read_pinned(spark, table, pins, "r1")
    first.unlink()
    (tmp_path / "t" / "new.parquet").write_bytes(b"PAR1")
    with pytest.raises(ValueError, match="new.parquet was added.*was removed"):
        pinned.read_pinned(spark, table, pins, "r1")


def test_reports_and_prompts_on_sparks_file_systems(spark, tmp_path):
    at = f"file://{tmp_path}/report.json"
    frozen.write_report(spark, {"n": 1}, at)
    frozen.write_report(spark, {"ü": 2}, at)
    assert shared.read_text(spark, at) == '{\n  "ü": 2\n}\n' and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.json"]
    with pytest.raises(Exception):  # noqa: B017
        frozen.prompt(spark, f"file://{tmp_path}/none")
    (tmp_path / "blank").write_text(" \n")
    with pytest.raises(ValueError, match="empty"):
        frozen.prompt(spark, str(tmp_path / "blank"))


def test_means_start_anew_at_each_log(spark):
    steps = [(r, k, float(k), 1.0) for r in ("a", None) for k in range(1, 500)]
    logs = [("a", 10), ("a", 300), ("a", 300), (None, 499)]
    frames = spark.createDataFrame(steps, "run string, step long, numerator double, denominator double").repartition(5), spark.createDataFrame(logs, "run string, step long")
    got = {(r.run, r.step): r.loss for r in objective.logged_means(*frames, "run").collect()}
    assert got == {("a", 10): 5.5, ("a", 300): 155.5, (None, 499): 250.0}
    with pytest.raises(Exception, match="finite and positive"):
        objective.logged_means(frames[0].where("step > 300"), frames[1], "run").collect()


def test_weights_must_be_finite_and_positive(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1.0, 0.0, 2.0])], "labels array<int>, weights array<double>")
    with pytest.raises(Exception, match="finite and positive"):
        rows.select(objective.language_tokens(F.col("labels"), F.col("weights"))).collect()


def test_selected_metrics_tokenized_splits_and_fixed_samples(spark):
    names = [evaluation.HEADLINES[1], "other"]
    assert evaluation.select_metrics(spark.createDataFrame([(0.5, 1)], names)).columns == names[:1]
    rows = spark.createDataFrame([(k, "train" if k % 3 else "validation", "q", str(k), [1], [1], [1]) for k in range(30)], "example_id long, split string, question string, answer string, input_ids array<int>, attention_mask array<int>, labels array<int>")
    assert splits.check_tokenized(rows) is rows
    with pytest.raises(ValueError, match="validation"):
        splits.check_tokenized(rows.where("split = 'train'"))
    with pytest.raises(ValueError):
        splits.check_tokenized(rows.drop("labels"))
    one, two = (splits.evaluation_samples(x, 5) for x in (rows, rows.repartition(7)))
    assert set(one) == {"train", "validation"}
    for s in one:
        assert one[s][0].count() == 5 and one[s][1].first() == two[s][1].first() and {r.split for r in one[s][0].collect()} == {s}


def test_audit_tells_of_scales_beyond_doubles_and_most_candidates(spark):
    rows = analyzed(spark, DEEP)
    s = audit.summary(audit.metrics(rows)).first()
    assert s.target_scales_all_finite and s.max_candidates_per_operand == max(len(n.candidates) for r in rows.collect() for t in r.steps for n in t.nodes)
    huge = rows.withColumn("steps", F.transform("steps", lambda s: s.withField("target_scale", F.lit(None).cast("double"))))
    assert not audit.summary(audit.metrics(huge)).first().target_scales_all_finite


def test_features_of_steady_and_unsteady_offsets_agree(spark):
    text = "So <<1+1=2>>2 and\n then <<2*3=6>>."
    steps = examples.analyze(spark.createDataFrame([(1, "", text)], "example_id long, question string, answer string"))
    chars = features.character_tokens(steps, "answer").withColumn("labels", F.col("input_ids"))
    doubled = chars.withColumn("offsets", F.flatten(F.transform("offsets", lambda o: F.array(o, o.withField("end", o["start"])))))  # an empty token after each: not steady
    doubled = doubled.withColumn("labels", F.transform("offsets", lambda o, i: i))
    a, b = (features.build(x, ["token_loss_weights", "step_positions", "step_mask"], 3.0).first() for x in (chars, doubled))
    assert a.step_mask == b.step_mask and [2 * p + 1 for p in a.step_positions if p] == [p for p in b.step_positions if p] and sum(a.token_loss_weights) + len(text) == sum(b.token_loss_weights)
    gap = chars.withColumn("offsets", F.filter("offsets", lambda o: o["start"] != 8)).withColumn("labels", F.slice("labels", 2, 999))
    assert features.build(gap, ["step_mask"]).first().step_mask == [False, True]


def test_features_take_time_in_proportion_to_the_text(spark):
    def took(n):
        answer = "".join(f"<<{k}+1={k + 1}>> and " for k in range(n))
        rows = examples.analyze(spark.createDataFrame([(1, "", answer)] * 4, "example_id long, question string, answer string").repartition(1)).withColumn("steps", F.transform("steps", lambda s: s))
        rows = shared.checkpoint(features.character_tokens(rows, "answer").withColumn("labels", F.col("input_ids")))
        begun = time.perf_counter()
        features.build(rows, ["token_loss_weights", *features.STEP_FEATURES]).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    took(50)
    small, large = took(600), took(2400)
    assert large < 8 * max(small, 0.4)


def test_provenance_parts_are_exact():
    assert calculation._written_parts("2/4", Fraction(1, 2)) == (2, 4) and calculation._written_parts("a half", Fraction(1, 2)) == (1, 2)
