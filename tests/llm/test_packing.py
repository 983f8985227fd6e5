import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyworks.llm import packing as P

from .fixtures import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Don't STOP; it's 12,345 o'clock!", "Ünd né ciónes ÀÉ œuvre Œ ß ×÷ µ ª º", "İI ǅ ﬁ é ä  nb sp\x1cx \x85y", "<|endoftext|> a<|startoftext|>b <| x", "日本語 текст 𝒳 👍🏽 ​", "", "x" * 5000, "..!!??--", "'s 're 'LL don''t"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library, monkeypatch, spark, sf_dir):
    from tallyworks.llm.common import read_table

    own = P.WordTokenizer(PATH)
    monkeypatch.setattr(P, "KEPT_WORDS", 50)
    for t in [*TEXTS, *(r.text for r in read_table(spark, sf_dir, "documents").collect())]:
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]


def check(rows, texts, library, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in parts] == [(k, a, len(ids[a : a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in parts)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq)


def test_pieces_and_places(spark, library):
    rows = [*((r[0], r[1]) for r in documents()), *((1000 + k, t) for k, t in enumerate(TEXTS))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = P.pack(df, capacity=256, open_bins=8).collect()
    n = check(got, dict(rows), library, 256)
    assert n <= 1.1 * -(-sum(r.length for r in got) // 256) + 1


def test_query_is_tight(spark, sf_dir, library):
    from tallyworks.llm.common import read_table

    got = P.op3_packing(spark, sf_dir).collect()
    n = check(got, {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}, library, 4096)
    assert n <= 1.03 * -(-sum(r.length for r in got) // 4096) + 1


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    b = P.BestFit(10, open_bins=2)
    assert [b.add(s) for s in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)] and b.closed == [1, 0]
    b = P.BestFit(10, open_bins=2)
    [b.add(s) for s in (6, 8, 7)]
    assert b.closed == [1] and sorted(b.rest()) == [(0, 6), (2, 7)]


def test_empty_and_null_ids(spark):
    assert P.pack(frame(spark, [])).count() == 0
    got = P.pack(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).collect()
    assert sorted(r.length for r in got) == [1, 2] and len({r.sequence_id for r in got}) == 1


def test_known_words_take_no_step_of_python(library):
    import sys

    own, words = P.WordTokenizer(PATH), [f"wort{k}," for k in range(1000)]
    text = " ".join(words * 10).encode()
    first, steps = own.encode(text), []
    old = sys.gettrace()
    sys.settrace(lambda frame, event, arg: lambda *_: steps.append(1))
    try:
        again = own.encode(text)
    finally:
        sys.settrace(old)
    assert again == first and len(steps) < 50
    assert np.frombuffer(first, "<u4").tolist() == library.encode(text.decode(), add_special_tokens=False).ids


def test_words_of_letters_and_marks_equal_the_library(library, monkeypatch):
    import random

    monkeypatch.setattr(P, "KEPT_WORDS", 50)
    monkeypatch.setattr(P, "KEPT_PARTS", 20)
    own, rng = P.WordTokenizer(PATH), random.Random(5)
    letters = ["a", "B", "st", "LL", "'s", "'", "''", "é", "ß", "Ü", "ÿ", "7", "_", ",", "$$$", "<", "|", "-", "µ", "ǅ", "x"]
    for _ in range(20_000):
        w = "".join(rng.choices(letters, k=rng.randint(1, 6)))
        assert np.frombuffer(own.encode(w.encode()), "<u4").tolist() == library.encode(w, add_special_tokens=False).ids, w
