import random

import pytest

import corpus_pipeline
from tallyworks.llm import simhash as S

from .fixtures import documents, frame


def brute(rows):
    """Ids that stay under five-word Jaccard >= 0.8, copies of copies included."""
    sets = {}
    for d, text, *_ in rows:
        ws = (text or "").encode().lower().split()
        sets[d] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return sorted(set(root.values()))


def edited(seed=4, n=40, length=200):
    """Texts with copies that have 1 to 6 changed words: similarities on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        ws = [f"w{rng.randrange(3000)}" for _ in range(length)]
        rows.append((10 * k, " ".join(ws), "en", "s", 0))
        for c in range(1, 7):
            copy = list(ws)
            for at in rng.sample(range(5, length - 5), c):
                copy[at] = f"changed{rng.randrange(3000)}"
            rows.append((10 * k + c, " ".join(copy), "en", "s", 0))
    return rows


def test_stage_keeps_what_the_rule_keeps(spark):
    rows = edited()
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute(rows)
    assert got.columns == frame(spark, rows).columns


@pytest.mark.parametrize("tile,broadcast", [(S.GROUP_BYTES, S.BROADCAST_ROWS), (4000, 0)])
def test_odd_texts_against_brute_force(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(S, "GROUP_BYTES", tile)
    monkeypatch.setattr(S, "BROADCAST_ROWS", broadcast)
    rows = documents()
    got = S.deduplicate_copies(frame(spark, [*rows, (None, "two words", "en", "s", 9)])).select("doc_id").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == brute(rows) and sum(r.doc_id is None for r in got) == 1
    assert S.deduplicate_copies(frame(spark, [])).count() == 0


def test_stage_on_documents(spark, sf_dir):
    from tallyworks.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_large_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(S, "TILE", 8)
    rng, rows = random.Random(9), []
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    for k in range(120):  # copies of one text with two changed words each: most pairs reach 0.8, not all
        copy = list(base)
        for at in rng.sample(range(150), 2):
            copy[at] = f"changed{rng.randrange(3000)}"
        rows.append((k, " ".join(copy), "en", "s", 0))
    rows += edited(6, 3)
    assert len({r[0] for r in rows}) < len(rows)  # ids with two texts
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = S.near_copies(frame(spark, rows)).collect()
    assert sorted({r.component_id for r in got}) == brute(rows) and len(got) == len(rows)


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (3, a), (7, b.upper()), (2, c), (2, b + " more"), (None, a), (9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS id", "3 AS raw", "4 AS key", "5 AS __text", "6 AS `a.b`")
    got = S.deduplicate_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.row, r["a.b"]) for r in got.collect() if r.text is not None) == sorted([(0, a, 1, 6), (3, a, 1, 6), (2, c, 1, 6), (2, b + " more", 1, 6)])
    assert [r.doc_id for r in got.collect() if r.text is None] == [9]
    kept = S.deduplicate(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == sorted([(0, a), (2, c), (2, b + " more"), (3, a), (5, b)])
    assert [(r.doc_id, r.text) for r in kept if not r.text] == [(9, None)]


def test_bits_of_wide_fingerprints():
    import numpy as np

    found = np.random.default_rng(3).integers(0, 1 << 63, 1000, dtype=np.uint64)
    own = S.mixed(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    want = [int(2 * sum(int(x) >> p & 1 for x in S.mixed(found ^ w)) > 1000) for w in own for p in range(64)]
    assert S.wide_bits(found, 3).tolist() == want and not S.wide_bits(found[:0], 3).any()


def test_tables_find_nearly_all_pairs():
    """Of random pairs of sets at 0.8, the share that no table brings together, or that the sifting drops."""
    import numpy as np

    rng, (tables, bits), missed, n = np.random.default_rng(7), S.table_plan(10_000), 0, 400
    for _ in range(n):
        one = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        two = np.concatenate([one[:160], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])  # 160 of 200: 0.8
        x, y = (S.wide_bits(np.unique(s), S.SIFT + -(-tables * bits // 64)) for s in (one, two))
        differ = (x != y)[64 * S.SIFT : 64 * S.SIFT + tables * bits].reshape(tables, bits)
        missed += differ.any(1).all() or (x != y)[: 64 * S.SIFT].sum() > S.sift_radius()
    assert missed / n <= 0.02
