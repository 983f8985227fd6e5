import json
import time

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import calculation, grammar, question, tables
from tallyworks.operators import audit, evaluation
from tallyworks.plans.qa import derive
from tallyworks.sources import frozen, progress, runs, shared, tracking
from tallyworks.streaming import totals

TEXTS = ["", None, "<<1+1=2>> <<3", "a dozen of 2 1/2 <<8/0=1>>#### 7", "<<1/3=.33>>" * 2000, "<<" * 50, "ß <<2*(-3)=-6>> 𝟙 1,000"]


def test_table_functions_equal_the_row_functions(spark):
    tables.register(spark)
    tables.register(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, TEXTS[3]])], "id int, t string").withColumns({c: F.lit(c) for c in ("step", "value", "raw")})
    got = spark.sql("SELECT id, a.* FROM {rows}, LATERAL annotations(t) AS a", rows=rows).collect()
    want = [(k, n, f.raw, f.start, f.end, f.expression, f.claimed, f.shown, f.parsed, f.executed, f.correct, f.error) for k, t in enumerate([*TEXTS, TEXTS[3]]) for n, f in enumerate(grammar.formulas(t))]
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want and len(want) > 2000
    got = spark.sql("SELECT id, n.* FROM {rows}, LATERAL question_numbers(t) AS n", rows=rows).collect()
    assert sorted(tuple(r)[:2] + (r.start, r.end, r.value) for r in got) == [(k, n, f.start, f.end, str(f.value)) for k, t in enumerate([*TEXTS, TEXTS[3]]) for n, f in enumerate(question.numbers(t))]
    got = spark.sql("SELECT id, s.* FROM {rows}, LATERAL math_steps(t, t) AS s", rows=rows.where("id IN (1, 3, 6)")).collect()
    want = [(k, s["index"], s["target"], s["dependencies"]) for k in (1, 3, 6) for s in calculation.record(TEXTS[k], TEXTS[k])["steps"]]
    assert sorted((r.id, r.step, r.target, r.rests_on) for r in got) == want
    assert spark.sql("SELECT a.* FROM {rows}, LATERAL annotations(t) AS a", rows=rows.limit(0)).count() == 0


def test_scalar_functions_stay_native(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "x 5 <<2+2=4>>4 y #### 1,200 "), (2, None), (3, "")], "id int, t string")
    got = spark.sql("SELECT id, marked_text(t) AS m, standalone_text(t) AS s, annotation_texts(t) AS a FROM {rows}", rows=rows)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "1,200", "1,200", ["<<2+2=4>>"]), (2, None, None, None), (3, None, None, [])]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def answers(spark, sf_dir):
    return derive(spark, sf_dir).select("example_id", "question", "answer", F.col("answer").alias("generated_text"), "reference")


def figures(df):
    (row,) = df.collect()
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.asDict().items()}


def test_merged_sums_equal_the_sums_of_all(spark, sf_dir):
    audited, scored = audit.audit(answers(spark, sf_dir)), evaluation.score(answers(spark, sf_dir))
    parts = lambda f, rows: f(rows.where("example_id % 3 = 0")).unionByName(f(rows.where("example_id % 3 > 0"))).unionByName(f(rows.limit(0)))
    assert figures(audit.rates(audit.merge(parts(audit.sums, audited)))) == figures(audit.summary(audited))
    assert figures(evaluation.rates(evaluation.merge(parts(evaluation.sums, scored)))) == figures(evaluation.summarize(scored))
    none = audit.summary(audited.limit(0)).first()
    assert none.examples == 0 and none.provenance_complete_rate is None and evaluation.summarize(scored.limit(0)).first().total == 0


def test_replayed_and_failed_batches_count_once(spark, sf_dir, tmp_path):
    rows = answers(spark, sf_dir)
    rows.repartition(7).write.parquet(f"{tmp_path}/feed")
    fails = [3, 3, 5]

    class Breaks(totals.Totals):
        def __call__(self, df, number):
            if number in fails:
                fails.remove(number)
                if len(fails) % 2:  # one fault comes after the commit, the others before it
                    super().__call__(df, number)
                raise OSError("lost")
            super().__call__(df, number)

    kept = Breaks(f"{tmp_path}/figures", lambda df: evaluation.sums(evaluation.score(df)), evaluation.merge, fold_every=3)
    faults = 0
    for _ in range(4):
        try:
            totals.run(spark, f"{tmp_path}/feed", rows.schema, kept, f"{tmp_path}/checkpoint", files=1)
        except Exception as e:  # noqa: BLE001
            assert "lost" in str(e)
            faults += 1
    assert faults == 3 and not fails
    want = figures(evaluation.summarize(evaluation.score(rows)))
    assert figures(evaluation.rates(kept.read(spark))) == want
    assert "upto-5" in shared.names(spark, f"{tmp_path}/figures")
    for number in (0, 4, 6):
        kept(rows, number)  # batches that are folded or committed
    kept.fold(spark)
    kept.fold(spark)
    assert [n for n in shared.names(spark, f"{tmp_path}/figures") if n != "making"] == ["upto-6"]
    assert figures(evaluation.rates(kept.read(spark))) == want
    with pytest.raises(ValueError, match="no committed batch"):
        totals.Totals(f"{tmp_path}/none", lambda df: df, lambda df: df).read(spark)


def test_runs(spark, tmp_path):
    ticks = iter(range(100))
    registry = runs.Registry(spark, f"{tmp_path}/runs", lambda: float(next(ticks)))
    assert registry.states().count() == 0 and registry.metrics().count() == 0
    one = registry.start("one", seed=42, name="ß")
    with pytest.raises(ValueError, match="has started"):
        registry.start("one")
    with pytest.raises(ValueError, match="can't be"):
        registry.start("../x")
    one.log({"loss": 1.5, "bad": float("nan"), "flag": True, "n": 3}, 10)
    with pytest.raises(ValueError, match="logged step 10"):
        one.log({"loss": 2.0}, 10)
    two = registry.start("two")
    with pytest.raises(ArithmeticError), two:
        1 / 0  # noqa: B018
    with registry.start("three") as three:
        three.finish({"accuracy": 0.5})
    registry.start("four")
    one.finish()
    for end in (one.finish, lambda: one.fail("late")):
        with pytest.raises(ValueError, match="has ended"):
            end()
    with pytest.raises(ValueError, match="has ended"):
        one.log({"loss": 1.0}, 11)
    with pytest.raises(ValueError, match="another writer"):
        runs.Run(spark, f"{tmp_path}/runs", "four", "someone", time.time).finish()
    with pytest.raises(ValueError, match="no start"):
        runs.Run(spark, f"{tmp_path}/runs", "five", "someone", time.time).finish()
    got = {r.run: r for r in registry.states().collect()}
    assert {k: r.state for k, r in got.items()} == {"one": "finished", "two": "failed", "three": "finished", "four": "running"}
    assert json.loads(got["one"].config) == {"name": "ß", "seed": 42} and got["one"].started_at < got["one"].ended_at and got["four"].ended_at is None
    assert got["three"].summary == {"accuracy": 0.5} and got["two"].error.startswith("ZeroDivisionError")
    assert sorted(map(tuple, registry.metrics().collect())) == [("one", 10, "loss", 1.5), ("one", 10, "n", 3.0)]
    tracking.log_report(spark.createDataFrame([(0.25,)], "accuracy double"), registry.start("six"), 7)
    assert registry.metrics().where("run = 'six'").first().value == 0.25


def test_progress_of_a_stream(spark, sf_dir, tmp_path):
    rows = answers(spark, sf_dir).select("example_id")
    rows.repartition(4).write.parquet(f"{tmp_path}/feed")
    total, said = rows.count(), []
    listener = progress.StreamProgress("counted", tracking.Progress(total), said.append)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
        stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if len(said) == 4:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [s["batch"] for s in said] == [0, 1, 2, 3] and said[-1]["completed_percent"] == 100 and said[0]["eta_seconds"] > 0


def test_progress_of_a_job(spark):
    said = []
    with progress.watched(spark, said.append, 0.05) as group:
        slow = F.udf(lambda x: time.sleep(0.05) or x, "long")
        assert spark.range(0, 40, 1, 20).select(slow("id").alias("x")).where("x >= 0").count() == 40
    assert said[-1]["completed"] == said[-1]["known"] >= 20 and said[-1]["running"] == 0
    assert any(0 < s["completed"] < s["known"] for s in said[:-1])
    spark.range(10).count()
    assert progress.job_tasks(spark, group) == said[-1]  # jobs started afterwards are outside


def test_log_lines_are_committed_together(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ß\n", float("nan")), (2, None, 0.5), (2, None, 0.5)], "step long, b string, a double").repartition(3)
    frozen.write_lines(rows, "metrics", f"{tmp_path}/log")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/log").collect())
    assert lines == ['{"a":0.5,"b":null,"event":"metrics","step":2}'] * 2 + ['{"a":null,"b":"ß\\n","event":"metrics","step":1}']
    broken = spark.range(0, 100, 1, 8).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("step"))
    with pytest.raises(Exception, match="broken"):
        frozen.write_lines(broken, "metrics", f"{tmp_path}/lost")
    assert [n for n in shared.names(spark, f"{tmp_path}/lost") if not n.startswith((".", "_temporary"))] == []
    with pytest.raises(ValueError, match="own field"):
        frozen.write_lines(spark.range(1).withColumn("event", F.lit(1)), "x", f"{tmp_path}/own")
