import tiktoken
from pyspark.sql import functions as F

from tallyworks.llm import rollups as R

from .fixtures import documents, frame


def deltas(spark, rows):
    return spark.createDataFrame(rows, R.SCHEMA)


def totals(r):
    return sorted(tuple(x) for x in r.totals().select(*R.KEYS, *R.SUMS).collect())


def test_signed_idempotent_batches(spark, tmp_path):
    r = R.TokenRollup(spark, str(tmp_path / "state"))
    assert r.totals().count() == 0
    assert r.commit("a/1", deltas(spark, [("s", "en", "v1", 1, 10, 50), ("s", "en", "v1", 1, 5, 20), ("t", None, "v1", 1, 1, 1)]))
    assert not r.commit("a/1", deltas(spark, [("s", "en", "v1", 9, 9, 9)]))
    assert r.commit("b", deltas(spark, [("s", "en", "v1", -1, -5, -20), ("t", None, "v1", -1, -1, -1)]))
    assert totals(r) == [("s", "en", "v1", 1, 10, 50)]
    r.fold()
    r.fold()
    assert not r.commit("b", deltas(spark, [("s", "en", "v1", 9, 9, 9)]))
    assert r.commit("c", deltas(spark, [("s", "en", "v1", 0, 7, 0)]))
    r.fold()
    assert totals(r) == [("s", "en", "v1", 1, 17, 50)]
    assert totals(R.TokenRollup(spark, str(tmp_path / "state"))) == [("s", "en", "v1", 1, 17, 50)]


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    r = R.TokenRollup(spark, str(tmp_path / "state"))
    r.commit("x", deltas(spark, [("s", "en", "v1", 1, 10, 50)]))
    next(tmp_path.rglob("_SUCCESS")).unlink()
    assert totals(r) == []
    assert r.commit("x", deltas(spark, [("s", "en", "v1", 1, 11, 50)])) and totals(r) == [("s", "en", "v1", 1, 11, 50)]


def encoding():
    import public_tokenizers

    return R._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_counts(spark, monkeypatch):
    rows = documents()
    got = {r.doc_id: r.n_tokens for r in R.count_tokens(frame(spark, rows)).collect()}
    assert isinstance(encoding(), tiktoken.Encoding)
    assert got == {r[0]: len(encoding().encode_ordinary(r[1] or "")) for r in rows}
    monkeypatch.setattr(R, "ENCODED", 20)
    assert all(R._count(encoding(), r[1] or "") == got[r[0]] for r in rows)


def test_query(spark, sf_dir):
    from tallyworks.llm.common import read_table

    rows, seen, want = sorted(read_table(spark, sf_dir, "documents").collect(), key=lambda r: r.doc_id), set(), {}
    for r in rows:
        if r.text in seen:
            continue
        seen.add(r.text)
        n = want.setdefault((r.source, r.lang, "byte_bpe_50k"), [0, 0, 0])
        for k, v in enumerate((1, len(encoding().encode_ordinary(r.text)) + 1, len(r.text.encode()))):
            n[k] += v
    assert {tuple(x[:3]): list(x[3:]) for x in R.op7_rollups(spark, sf_dir).select(*R.KEYS, *R.SUMS).collect()} == want


def test_empty_table_odd_rows_and_names(spark, tmp_path):
    rows = [*documents(), (None, "one", "en", "s0", 3), (None, None, None, None, None)]
    own = ["part", "first", "digest", "version", "n_bytes", "__text"]
    for k, some in enumerate(([], rows)):
        path = tmp_path / str(k)
        frame(spark, some).withColumns({c: F.lit(c) for c in own}).write.parquet(str(path / "documents.parquet"))
        got = {tuple(r[c] for c in R.KEYS): [r[c] for c in R.SUMS] for r in R.op7_rollups(spark, str(path)).collect()}
        want, seen = {}, {}
        for d, text, lang, source, _ in some:
            if d is not None:
                seen[text or ""] = min(d, seen.get(text or "", d))
        for d, text, lang, source, _ in some:
            if d is None or seen[text or ""] == d:
                n = want.setdefault((source, lang, "byte_bpe_50k"), [0, 0, 0])
                for j, v in enumerate((1, len(encoding().encode_ordinary(text or "")) + 1, len((text or "").encode()))):
                    n[j] += v
        assert got == want
    assert not list(tmp_path.rglob("rollup-*"))
    assert R.count_tokens(frame(spark, rows)).columns == [*frame(spark, rows).columns, "n_tokens"]


def test_folds_that_stopped_halfway(spark, tmp_path):
    r = R.TokenRollup(spark, str(tmp_path / "state"))
    r.commit("a", deltas(spark, [("s", "en", "v1", 1, 10, 50)]))
    import shutil

    shutil.copytree(tmp_path / "state" / r._name("a"), tmp_path / "kept")
    r.fold()
    shutil.copytree(tmp_path / "kept", tmp_path / "state" / r._name("a"))  # as if it had not been removed
    assert totals(r) == [("s", "en", "v1", 1, 10, 50)] and not r.commit("a", deltas(spark, [("s", "en", "v1", 9, 9, 9)]))
