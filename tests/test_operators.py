import json

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import scan
from tallyworks.operators import audit, evaluation, examples, features, objective, splits, tokenization
from tallyworks.plans import recipes
from tallyworks.sources import frozen, tracking
from tallyworks.streaming import scoring


def test_frozen_splits(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k}", f"a{k}") for k in range(40)], "example_id long, question string, answer string")
    test = rows.withColumn("question", F.concat("question", F.lit("t")))
    path = str(tmp_path / "frozen")
    manifest = {r.split: r for r in frozen.freeze(rows, test, path).collect()}
    assert {k: r.rows for k, r in manifest.items()} == {"train": 34, "validation": 6, "test": 40}
    big = frozen.freeze(rows, test, str(tmp_path / "parts"), source="s", revision="r1", digest_parts=4).collect()
    assert {(r.split, r.rows) for r in big} == {(k, r.rows) for k, r in manifest.items()} and {(r.source, r.revision, r.digest_parts) for r in big} == {("s", "r1", 4)}
    with pytest.raises(Exception, match="(?i)exists"):
        frozen.freeze(rows, test, path)
    with pytest.raises(ValueError, match="part_hash"):
        splits.ordered_hash(rows, "example_id", limit=39)
    assert splits.ordered_hash(rows.limit(0), "example_id").first().rows == 0
    assert frozen.load_split(spark, path, "validation", 99).count() == 6 and frozen.load_split(spark, path, "train", 5).count() == 5
    with pytest.raises(ValueError, match="unknown"):
        frozen.load_split(spark, path, "other")
    with pytest.raises(ValueError, match="share"):
        frozen.freeze(rows, rows, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="missing"):
        splits.check_source(rows.drop("answer"))
    with pytest.raises(ValueError):
        splits.sample(rows, 0, 1, "example_id")
    with pytest.raises(ValueError):
        splits.assign(rows, 1.0, 1, "example_id")


def test_native_scan_equals_python(spark):
    from tallyworks.functions.grammar import ANNOTATION, formulas

    texts = ["", "a <<1+1=2>> b <<x=\n3>>", "𝒳 <<é = 4 = 5 >>\n", "<<unclosed\n more", "<<>><<=>>", "tail <<1=1>>\n<<2"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, r["index"]): r for r in scan.annotations(df, "t", "id").collect()}
    for k, t in enumerate(texts):
        for j, (m, f) in enumerate(zip(ANNOTATION.finditer(t), formulas(t), strict=True)):
            r = got.pop((k, j))
            assert (r.raw, r.start, r.end, r.claimed_text) == (m[0], *m.span(), f.claimed_text), t
    assert not got


def test_span_deletion_and_places(spark):
    df = spark.createDataFrame([("0123456789", [(1, 3), (5, 6)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(scan.delete_spans(F.col("t"), F.col("s"))).first()[0] == "0346789"
    assert spark.range(1).select(scan.mend_blanks(F.lit("<<a>>b <<c>><<d>> ."))).first()[0] == "<<a>> b <<c>>\n<<d>>."
    assert [r[0] for r in spark.createDataFrame([("1.50",), ("3",), ("1/2",), ("1,000.5",)], "t string").select(scan.decimal_places(F.col("t"))).collect()] == [2, 0, None, 1]


def test_scoring_and_streaming(spark, tmp_path):
    rows = [("q", "#### 5", "<<2+3=5>>\n#### 5"), ("q", "#### 5", None), ("q", "5", "it is 5")]
    df = spark.createDataFrame(rows, "question string, reference string, generated_text string")
    got = evaluation.score(df).orderBy("prediction_source").collect()
    assert [(r.correct, r.strict_correct, r.final_answer_error) for r in got] == [(False, False, 2.0), (True, False, 0.0), (True, True, 0.0)]
    df.write.parquet(str(tmp_path / "in"))
    q = scoring.score_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="reference"):
        evaluation.score(df.withColumn("reference", F.lit("none"))).collect()
    with pytest.raises(ValueError):
        evaluation.require_rows(df.limit(0))
    assert json.loads(json.dumps(evaluation.protocol("p")))["scoring"]["supported_operators"][-1] == "//"


def test_history_json_and_metrics(spark):
    rec = spark.createDataFrame([(0, "train", 1, 1.0), (0, "train", 0, 2.0), (1, "train", 5, 3.0), (2, "train", 9, float("nan"))], "epoch int, split string, global_step int, x double")
    assert sorted(tuple(r)[:3] for r in evaluation.evaluation_history(rec, 2).collect()) == [(0, "train", 0), (2, "train", 9)]
    assert [r.x for r in evaluation.json_safe(rec.where("epoch = 2")).collect()] == [None]


def test_audit_and_gate(spark):
    df = spark.createDataFrame([(1, "There are 4 and 3.", "<<4=4>>4 <<4*3=12>> <<12*12=144>>\n#### 144"), (2, None, None)], "example_id long, question string, answer string")
    rows = audit.audit(df).cache()
    one = rows.where("example_id = 1").first()
    assert (one.math_steps, one.repeated_previous_results, one.final_step_identified, one.fully_resolved_and_executable, one.reference_edges) == (2, 1, True, True, 1)
    s = audit.summary(rows).first()
    assert (s.examples, s.examples_without_math_steps, s.examples_all_math_steps_valid, s.examples_program_matches_graph) == (2, 1, 1, 2)
    audit.gate(rows)
    with pytest.raises(ValueError):
        audit.gate(rows.limit(0))


def test_features_of_characters(spark):
    answer = "A line\nso <<1/2=.5>> and <<3+4=7>>\n#### 7"
    df = examples.analyze(spark.createDataFrame([(1, "1/2 or 3", answer)], "example_id long, question string, answer string"))
    df = features.character_tokens(df, "answer").withColumn("labels", F.col("input_ids"))
    r = features.build(df, list(features.STEP_FEATURES)).first()
    assert r.step_positions == [6, answer.index(" and")] and r.step_mask == [True, True] and r.step_targets == [0.5, 7.0] and r.step_target_scales == [1.0, 7.0]
    cut = df.withColumns({c: F.slice(c, 1, 15) for c in ("offsets", "labels")})
    assert features.build(cut, ["step_mask"]).first().step_mask == [False, False]
    w = features.build(df.withColumn("labels", F.transform("labels", lambda x: F.when(x < 3, -100).otherwise(x))), ["token_loss_weights"], 3.5).first().token_loss_weights
    assert w[:4] == [0.0, 0.0, 0.0, 1.0] and w[answer.index("<<")] == 3.5 and w[answer.index(" and")] == 1.0
    with pytest.raises(ValueError):
        features.build(df, ["nothing"])
    with pytest.raises(ValueError):
        features.build(df, ["token_loss_weights"], 0)
    assert df.select(features.offsets_valid(F.col("offsets"), F.col("input_ids"))).first()[0]
    assert spark.range(1).select(features.completion_labels(F.array(F.lit(1), F.lit(2)), F.array(*map(F.lit, (1, 2, 3))))).first()[0] == [-100, -100, 3]


def test_batches(spark):
    rows = [(k, list(range(k + 1)), [1] * (k + 1), [5] * (k + 1), [True] * (k % 2)) for k in range(5)]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, attention_mask array<int>, labels array<int>, step_mask array<boolean>")
    got = features.collate(features.number_batches(df, 2, "id", False), 9).orderBy("id").collect()
    assert got[0].input_ids == [0] + [9] * 7 and got[0].labels == [5] + [-100] * 7 and got[0].step_mask == [False] and got[1].step_mask == [True] and got[4].step_mask == []
    assert features.number_batches(df, 2, "id", True).count() == 4


def test_losses(spark):
    df = spark.createDataFrame([([[0.0, 1.0], [2.0, 0.0], [0.0, 0.0]], [0, 1, -100], [1.0, 3.0, 5.0])], "logits array<array<double>>, labels array<int>, weights array<double>")
    r = objective.language_loss(df, weighted=True).first()
    assert r.denominator == 3.0 and r.numerator == pytest.approx(3 * 0.3132616875)
    assert objective.language_loss(df).first().denominator == 1.0
    with pytest.raises(Exception, match="positive"):
        objective.mean_losses(df.select(F.lit(0.0).alias("numerator"), F.lit(0.0).alias("denominator"))).collect()
    values = spark.createDataFrame([("language", 2.0), ("result", 3.0)], "loss string, value double")
    assert objective.objective(values, recipes.losses(spark)).first().objective == 5.0


def test_recipes():
    assert recipes.plan(" a2 ")["features"] == ["token_loss_weights"] and recipes.plan("A1")["math_token_weight"] == 1.0
    for bad, error in (("A0", ValueError), ("A9", ValueError), ("A4", NotImplementedError)):
        with pytest.raises(error):
            recipes.plan(bad, require_implemented=True)
    with pytest.raises(ValueError):
        recipes.plan("A2", math_token_weight=True)


def test_training_rows_and_prompt(spark, tmp_path):
    df = spark.createDataFrame([(" q ", "Has 2 + 2 = <<2+2=4>>4.\n#### 4 ")], "question string, answer string")
    r = examples.training_examples(df, "sys").first()
    assert [t.content for t in r.prompt] == ["sys", "q"] and r.completion[0].content == "Has <<2+2=4>>.\n#### 4"
    with pytest.raises(Exception, match="must not be empty"):
        examples.training_examples(df.withColumn("answer", F.lit(" ")), "sys").collect()
    (tmp_path / "p").write_text("hi\n")
    assert frozen.prompt(spark, str(tmp_path / "p"))[0] == "hi" and frozen.positive("3") == 3
    with pytest.raises(ValueError):
        frozen.positive("inf", float)


def test_tokenized_examples(spark):
    df = spark.createDataFrame([("train", "q", "A <<1+1=2>>\n#### 2"), ("test", "", "")], "split string, question string, answer string")
    chat = examples.training_examples(df.where("split = 'train'"), "s").unionByName(df.where("split = 'test'"), allowMissingColumns=True)
    r = tokenization.prepare(chat).first()
    head = "<system>s</system><user>q</user><assistant>"
    assert r.answer_start == len(head) and r.labels[: len(head)] == [-100] * len(head) and r.labels[len(head)] == len(head) and r.attention_mask == [1] * len(r.input_ids)
    with pytest.raises(Exception, match="no token"):
        tokenization.prepare(chat, longest=5).collect()
    import public_tokenizers

    ids = tokenization.prepare(chat, tokenization.from_file(public_tokenizers.path("byte_bpe_50k.json"))).first()
    assert ids.labels[-1] == ids.input_ids[-1] != -100 and ids.offsets[-1].end == len(head) + len("A <<1+1=2>>\n#### 2</assistant>")


def test_tracking(spark):
    seen = []
    tracker = type("T", (), {"log": lambda self, m, step: seen.append((step, m))})()
    df = spark.createDataFrame([(1.5, True, float("inf"))], "x double, b boolean, y double")
    tracking.for_each_batch(tracker, lambda d: d)(df, 7)
    assert seen == [(7, {"x": 1.5})]
    clock = iter([0.0, 2.0]).__next__
    assert tracking.Progress(10, clock).add(4) == {"completed_percent": 40.0, "examples_per_second": 2.0, "eta_seconds": 3.0}
    assert evaluation.evaluate(spark.createDataFrame([("q", "1", "1")], "question string, reference string, generated_text string"), "p")[1].first().correct_final_answers == 1


def test_ranks_and_part_digests(spark):
    rows = spark.createDataFrame([(k * 37 % 1000, f"g{k % 3}" if k % 7 else None, f"q{k}", "a") for k in range(1000)] + [(None, "g0", "q", None)], "id int, g string, question string, answer string")
    got = splits.ranked(rows, "id", "g", parts=16).collect()
    assert len(got) == 1001
    for g in ("g0", "g1", "g2", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["__rank"])
        assert [r["__rank"] for r in mine] == list(range(len(mine))) and [r.id or -1 for r in mine] == sorted(r.id or -1 for r in mine)
    assert [r["__rank"] for r in splits.ranked(rows.where("id IS NOT NULL"), "id", parts=16).orderBy("id").collect()] == list(range(1000))
    assert splits.ranked(rows.limit(0), "id").count() == 0
    by_name = splits.ranked(rows.where("answer IS NOT NULL"), "question", parts=8).orderBy("question").collect()
    assert [r["__rank"] for r in by_name] == list(range(1000))
    one = splits.part_hash(rows, "id", parts=8).first()
    assert one.rows == 1001 and one == splits.part_hash(rows.repartition(7), "id", parts=8).first()
    changed = rows.withColumn("answer", F.when(F.col("id") == 5, "b").otherwise(F.col("answer")))
    assert splits.part_hash(changed, "id", parts=8).first().digest != one.digest


def test_percentiles_of_scales(spark):
    import math
    import random

    values = sorted([random.Random(3).choice([1.0, 2.5, 1e300, 7.0]) if k % 2 else 1.0 + k / 64 for k in range(501)])
    rows = spark.createDataFrame([([(v,)],) for v in values] + [([(None,)],)], "steps array<struct<target_scale:double>>")
    got = audit.scale_percentiles(rows, (0.5, 0.9, 0.99)).first()
    assert list(got) == [values[math.ceil(p * 501) - 1] for p in (0.5, 0.9, 0.99)]
    assert list(audit.scale_percentiles(rows.limit(0)).first()) == [None] * 3


def test_many_annotations_take_linear_time(spark):
    from time import perf_counter

    def seconds(n):
        begin = perf_counter()
        got = spark.range(1).select(scan.matches(F.repeat(F.lit("ab <<1+1=2>>"), n), scan.ANNOTATION).alias("m")).selectExpr("size(m) AS n", "m[size(m) - 1] AS z").first()
        assert got.n == n and (got.z.start, got.z.end) == (12 * n - 9, 12 * n)
        return perf_counter() - begin

    seconds(200)
    assert seconds(20000) < 10 + 4 * seconds(10000)


def test_errors_of_records_and_results(spark):
    from tallyworks.functions import calculation
    from tallyworks.functions.question import numbers

    found = numbers("There are 4 and 3.")
    with pytest.raises(ValueError, match="twice"):
        calculation.Provenance("There are 4 and 3.", [*found, found[0]])
    assert calculation.agreement([(1, None), (2, None)], [(1, None), (3, None)]) == [True, False]
    with pytest.raises(ValueError):
        calculation.agreement([(1, None)], [])
    rows = examples.analyze(spark.createDataFrame([(1, "4 and 3", "<<4*3=12>> <<12-4=8>>")], "example_id long, question string, answer string"))
    assert audit.invariant_violations(rows).count() == 0
    a = audit.result_hashes(rows)
    audit.require_same(a, a)
    with pytest.raises(ValueError, match=r"1 analyses differ, the first of \[1\]"):
        audit.require_same(a, a.withColumn("digest", F.lit("x")))
    assert audit.throughput(rows)["examples"] == 1
    tokens = features.character_tokens(rows, "answer").withColumn("labels", F.col("input_ids"))
    with pytest.raises(Exception, match="ordered span"):
        features.build(tokens.withColumn("offsets", F.reverse("offsets")), ["step_mask"]).collect()


def test_objective_report_and_schedule(spark):
    losses = spark.createDataFrame([("language", 2.0), ("result", 3.0)], "loss string, value double")
    r = objective.objective_report(losses, recipes.losses(spark)).first()
    assert r.objective == 5.0 and r.losses == {"language": 2.0, "result": 3.0}
    with pytest.raises(Exception, match="positive"):
        objective.evaluation_normalizers(spark.createDataFrame([(0.0,)], "denominator double")).collect()
    assert list(spark.range(1).select(objective.epoch_number(F.lit(1.2)), objective.epoch_number(F.lit(1.2), True)).first()) == [1, 2]


def test_tokenizer_markers():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(ValueError, match="lacks"):
        tokenization.check_markers(path, ("<no marker>",))
    first = tokenization._library(path).id_to_token(40)
    assert tokenization.check_markers(path, (first,)) == {first: 40}


def test_programs_survive_their_records(spark):
    text = "There are 4 and 3, and 1/2 of 9 crates."
    rows = [(1, text, "<<4*3=12>> <<12-4=8>> <<8/0=1>> <<1/2*8=4>> <<4=4>>\n#### 4"), (2, None, None)]
    got = examples.analyze(spark.createDataFrame(rows, "example_id long, question string, answer string"))
    assert examples.check_programs(got).where("size(issues) > 0").count() == 0
    bad = got.withColumn("steps", F.transform("steps", lambda s, i: F.when(i == 1, s.withField("actions", F.slice(s["actions"], 1, 0))).otherwise(s)))
    codes = {i.code for r in examples.check_programs(bad).collect() for i in r.issues}
    assert {"action_count_mismatch", "action_sequence_mismatch", "dependency_mismatch"} <= codes
