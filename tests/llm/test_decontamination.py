import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import decontamination as D

from .fixtures import documents, frame

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items):
    ws, hit, found = re.findall(WORD, lower(text)), set(), set()
    for item, t in items:
        iw = re.findall(WORD, lower(t))
        n = min(10, len(iw))
        wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1) if n else ():
            if tuple(ws[k : k + n]) in wins:
                found.add(str(item))
                hit |= set(range(k, k + n))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables(spark):
    rows = documents()
    text = next(r[1] for r in rows if r[0] == 300)
    items = [(1, text.upper()), (20, "two, WORDS!"), (3, " ".join(text.split()[:10])), (4, ""), (5, None), (None, text), (3, "ünd--né"), (7, "nothing like this is in there at all, not one of its windows")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_both_ways_against_brute_force(spark, limit):
    rows, items, bench = tables(spark)
    known = [i for i in items if i[0] is not None and i[1]]
    got = D.scan(frame(spark, rows), bench, limit=limit).collect()
    want = {r[0]: brute(r[1], known) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id


def test_removal(spark):
    rows, items, bench = tables(spark)
    df = frame(spark, rows)
    dirty = {r.doc_id for r in D.scan(df, bench).where("contaminated").collect()}
    assert {r.doc_id for r in D.decontaminate(df, bench).collect()} == {r[0] for r in rows} - dirty and dirty
    cut = D.decontaminate(df, bench, spans=True)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert {r.doc_id: r.text for r in cut.collect()}[5] == ""
    assert D.cut(b"A two words, B", __import__("numpy").array([False, True, True, False])) == b"A , B"


def test_query_on_documents(spark, sf_dir):
    from tallyworks.llm.common import read_table

    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}
    for r in D.op5_decontamination(spark, sf_dir).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items)


def test_empty_tables(spark):
    _, _, bench = tables(spark)
    assert D.scan(frame(spark, []), bench).count() == 0
    assert D.scan(frame(spark, documents()), bench.limit(0)).where("contaminated").count() == 0


def test_blocks_and_segments_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 7)
    rows, items, bench = tables(spark)
    known = [i for i in items if i[0] is not None and i[1]]
    df = frame(spark, rows).withColumns({c: F.lit(c) for c in ("__key", "__spans", "___items")})
    want = {r[0]: brute(r[1], known) for r in rows}
    for limit in (1 << 20, 40):
        got = D.scan(df, bench, limit=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id
            assert (r["__key"], r["__spans"], r["___items"]) == ("__key", "__spans", "___items")


def test_equal_hashes_of_different_words():
    class Weak(D.WindowSet):
        def _hash(self, h, n):
            return super()._hash(h, n) % D.np.uint64(2)

    rows = documents()
    items = [("1", rows[20][1] or ""), ("2", "two words"), ("3", "one")]
    weak = Weak([(i, D.normal_words(t.encode())) for i, t in items])
    for r in rows[:40]:
        ws = D.normal_words((r[1] or "").encode())
        if len(ws) < 500:
            mask, found = weak.scan(ws)
            assert (0 if mask is None else int(mask.sum()), len(found)) == brute(r[1], items)[1:3]


def test_memory_of_a_full_block():
    """A set of as many windows as are broadcast at once takes under 300 MB; measured at a sixteenth of it."""
    import tracemalloc

    rng = D.np.random.default_rng(2)
    n = D.WINDOWS // 16
    parts = [(str(k), [b"word%d" % x for x in rng.integers(0, 50_000, D.SEGMENT)]) for k in range(n // D.SEGMENT)]
    tracemalloc.start()
    found = D.WindowSet(parts)
    now = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sum(len(x[1]) for x in found.by_length) > 0.9 * n and now * 16 < 300 << 20


def test_columns_with_the_operators_own_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "some words of a clean text")], "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("__hit_cleaned", "__hit_contaminated", "__hit_n_hit", "n_words")})
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    (left,) = D.decontaminate(docs, bench).collect()
    assert left.doc_id == 2 and left["__hit_cleaned"] == left["__hit_contaminated"] == left.n_words == "mine"
    cut = {r.doc_id: r for r in D.decontaminate(docs, bench, spans=True).collect()}
    assert cut[1].text.strip() == "" and cut[2].text == "some words of a clean text" and cut[1]["__hit_cleaned"] == "mine"


def test_sets_are_told_apart_by_name_and_not_by_address():
    class Sent:
        value = ("a", [("1", b"x y")])

    D._window_set(Sent, 10)
    Sent.value = ("b", [("2", b"z")])
    assert D._window_set(Sent, 10).hits([b"z"])[1] == {"2"}


def test_bytes_bound_a_block_too(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"{'w' * 200}{k} of item {k}") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"see {'w' * 200}{k} of item {k} here") for k in range(0, 60)], "doc_id long, text string")
    want = sorted((r.doc_id, r.n_hit, r.contaminated) for r in D.scan(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in D.scan(docs, bench).collect()) == want and sum(x[2] for x in want) == 40
