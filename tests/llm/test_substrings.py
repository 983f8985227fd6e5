import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import substrings as S

from .fixtures import documents, frame


def brute(rows, width=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, ws in words:
        for k in range(len(ws) - width + 1):
            if d is not None:
                g = tuple(ws[k : k + width])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, ws in words:
        gone = {j for k in range(len(ws) - width + 1) if d is not None and first[tuple(ws[k : k + width])] < d for j in range(k, k + width)}
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((-1 if d is None else d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shape(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "SHARD_BYTES", 1000)
    rows = [*documents(seed, 120), (None, documents(seed)[9][1], None, None, None), (100, "again " * 20, None, None, None)]
    got = shape(S.remove_repeats(frame(spark, rows)))
    assert got == brute([r[:2] for r in rows])
    assert sum(r[2] for r in got) > 1000


def test_on_documents(spark, sf_dir):
    from tallyworks.llm.common import read_table

    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").collect()]
    assert shape(S.op10_substrings(spark, sf_dir)) == brute(rows)


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    h, d = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)), rng.integers(-(1 << 62), 1 << 62, 1000)
    a, b = S._unpack(S._pack(h, d), 2)
    assert (a == h).all() and (b == d).all()


def test_small_gathers(spark, monkeypatch):
    rows = documents(4, 60)
    batches = frame(spark, rows, clash=False).where("doc_id IS NOT NULL").select("doc_id", "text").toArrow().to_batches()
    monkeypatch.setattr(S, "GATHER", 50)
    sent = list(S._windows(iter(batches), 5, 5, 13, S.window_hashes))
    assert sum(b.num_rows for b in sent) > 5


def test_empty(spark):
    assert S.remove_repeats(frame(spark, [])).count() == 0


def test_shards_as_spark_deals_them(spark):
    ids = [0, 1, -1, 7, 2**62, -(2**63), 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(13)).alias("s")).collect()
    assert [r.s for r in got] == S.shard_of(np.array([r.i for r in got]), 13).tolist()


def weak_hashes(words, width):
    """Seven values for all windows: nearly every hash stands for different words."""
    return S.window_hashes(words, width) % np.uint64(7) << np.uint64(61)


def no_hashes(words, width):
    return np.zeros(max(0, len(words) - width + 1), np.uint64)


@pytest.mark.parametrize("hasher", [weak_hashes, no_hashes])
def test_colliding_hashes_change_nothing(spark, monkeypatch, hasher):
    monkeypatch.setattr(S, "SHARD_BYTES", 4000)
    monkeypatch.setattr(S, "LOST_AT_ONCE", 3)
    rows = documents(5, 60)
    assert shape(S.remove_repeats(frame(spark, rows), hasher=hasher)) == brute([r[:2] for r in rows])


def test_several_shuffles_and_branches(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 1000)
    monkeypatch.setattr(S, "FANOUT", 3)
    rows = documents(6, 120) + [(1000 + k, " ".join(f"same{j}" for j in range(30)) + f" own{k}", None, None, None) for k in range(200)]
    assert len(S.levels(60)) == 4
    assert shape(S.remove_repeats(frame(spark, rows))) == brute([r[:2] for r in rows])


def test_debts_make_a_tree(monkeypatch):
    monkeypatch.setattr(S, "BRANCHES", 2)
    h, d, debts = S.settle(np.full(8, 5, np.uint64), np.array([9, 3, 1, 4, 1, 5, 2, 6]), 1 << 20)
    assert (h.tolist(), d.tolist()) == ([5], [1])
    assert sorted(debts[1].tolist()) == [1, 1, 2, 2, 3, 3]


def test_part_of_a_passage_is_found_with_other_neighbours():
    words = [f"w{k}".encode() for k in range(60)]
    automaton = S.PassageAutomaton({b" ".join(words): 1})
    for a in range(0, 48):
        doc = [b"x", *words[a : a + 13], b"y"]
        assert automaton.covered(doc, 2).tolist() == [False, *[True] * 13, False] and not automaton.covered(doc, 1).any()
        assert not automaton.covered([b"x", *words[a : a + 12], b"y"], 2).any()


def test_automaton_reads_only_stretches_that_can_hold_a_block():
    """Documents of words that passages have, too, in other orders, aren't streamed through the automaton; what repeats is found at any place."""
    from random import Random

    random = Random(3)
    words = [b"w%d" % k for k in range(50)]
    passages = {b" ".join(random.choices(words, k=random.randrange(13, 60))): k for k in range(40)}
    automaton = S.PassageAutomaton(passages)
    read = []

    class Counted:
        def __init__(self, machine):
            self.machine = machine

        def iter(self, numbers):
            read.append(len(numbers))
            return self.machine.iter(numbers)

    automaton.machine = Counted(automaton.machine)
    for _ in range(300):
        ws = random.choices(words, k=200)
        for passage in random.sample(sorted(passages), 2):
            own = passage.split()
            begin = random.randrange(len(own))
            at = random.randrange(200)
            ws[at:at] = own[begin : begin + random.randrange(8, 40)]
        doc = random.choice((5, 20, 100))
        windows = {tuple(p.split()[k : k + 13]) for p, owner in passages.items() if owner < doc for k in range(len(p.split()) - 12)}
        expected = [False] * len(ws)
        for k in range(len(ws) - 12):
            if tuple(ws[k : k + 13]) in windows:
                expected[k : k + 13] = [True] * 13
        assert automaton.covered(ws, doc).tolist() == expected
    assert sum(read) < 300 * 100  # of some 230 words each
    assert S.PassageAutomaton({}).covered(words, 5).sum() == 0 and automaton.covered([], 5).sum() == 0
