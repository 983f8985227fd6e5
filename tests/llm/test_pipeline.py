import pytest

import corpus_pipeline
from tallyworks.llm.common import read_table

from . import test_copies, test_decontamination, test_pii, test_quality


def test_stages_and_run(spark, sf_dir):
    first = docs = read_table(spark, sf_dir, "documents")
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    want = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k == 0:
            want = {d: t for d, t in want.items() if not test_quality.brute(t)[-1]}
        elif k == 1:
            want = {d: want[d] for d in test_copies.brute(want.items())}
        elif k == 2:
            want = {d: t for d, t in want.items() if not test_decontamination.brute(t, items)[-1]}
        elif k == 3:
            assert all((r.text == want[r.doc_id]) == ("[" not in r.text) and r.n_chars == len(r.text) for r in docs.collect())
            assert not any(test_pii.brute(r.text) for r in docs.collect())
        if k < 4:
            assert docs.columns == first.columns, name
            assert {r.doc_id for r in docs.collect()} == set(want), name
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(want)


def test_odd_rows_names_and_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from .fixtures import documents, frame

    long = " ".join(f"word{k}" for k in range(9000)) + " mail a@b.org"
    rows = [*documents(), (None, long[:3000], "en", "s", 1), (700, long, "en", "s", 1), (700, long[:500], "de", "s", 1), (701, long, None, None, None), (701, long, None, None, None)]
    for k, some in enumerate((rows, [])):
        path = tmp_path / str(k)
        df = frame(spark, some).withColumns({c: F.lit(c) for c in ("__text", "row", "raw", "id", "item_id", "a.b")})
        df.write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(700, 1, None), (None, 0, 0)][: 2 - 2 * k], "doc_id long, quality long, toxic long").write.parquet(str(path / "labels.parquet"))
        spark.createDataFrame([(1, "two words"), (2, None)][: 2 - 2 * k], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
        packed = corpus_pipeline.run(spark, str(path)).collect()
        want = {(-1 if r[0] is None else r[0]): r[1] for r in reversed(some) if not test_quality.brute(r[1])[-1]}
        if some:
            assert {-1, 700} <= {-1 if r.doc_id is None else r.doc_id for r in packed} <= set(want)
            assert sum(r.doc_id == 700 and r.piece == 0 for r in packed) == 2 and not any(r.doc_id == 701 for r in packed)
        else:
            assert packed == []
    docs = spark.read.parquet(str(tmp_path / "0" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path / "0"))
        assert out.columns == docs.columns and out.where("__text <> '__text' OR raw <> 'raw' OR `a.b` <> 'a.b'").count() == 0, name


def test_a_failed_stage_leaves_nothing_behind(spark, sf_dir, monkeypatch):
    import os

    from tallyworks.llm.common import shared_dir

    def fails(spark, docs, sf_dir):
        assert docs.count() == 7
        raise ValueError("as planned")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("some", lambda spark, docs, sf_dir: docs.limit(7)), ("fails", fails)])
    with pytest.raises(ValueError, match="as planned"):
        corpus_pipeline.run(spark, sf_dir)
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("pipeline-")]
