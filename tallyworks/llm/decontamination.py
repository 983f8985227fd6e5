"""Benchmark decontamination: a broadcast hash set of normalised item windows, scanned over token windows.

Item texts are cut into segments of a bounded length. Their windows are hashed, and the sorted hashes are broadcast
with the items' words, ``WINDOWS`` windows at most (some 30 bytes each, words included). A task hashes each
document's windows with numpy, looks them up, and verifies hits word by word; the words inside verified windows are
marked. More windows than that are dealt into blocks, each scanned over all documents in a pass of its own, and the
hits of all passes are put together. Nothing but hits is shuffled in either case.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, numbered

WINDOW = 10
#: Item windows that are broadcast at once, at most.
WINDOWS = 4 << 20
#: Bytes of the words that are broadcast at once.
BLOCK_BYTES = 256 << 20
#: Windows of a segment of an item.
SEGMENT = 4096
#: Lower-cases A-Z and blanks what isn't a word character [^\x00-\x2F\x3A-\x60\x7B-\x7F].
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, cleaned string"


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def item_windows(ws: list[bytes], width: int = WINDOW) -> Iterator[list[bytes]]:
    """Windows of ``width`` words; an item of fewer words, but not none, is one window."""
    if ws:
        for k in range(max(1, len(ws) - width + 1)):
            yield ws[k : k + width]


class WindowSet:
    """Sorted hashes of item windows, with the items' words for verification.

    Windows of one length are arrays: hash, segment, and where in the segment's words the window stands.
    """

    def __init__(self, segments: list[tuple[str, list[bytes]]], width: int = WINDOW) -> None:
        self.width = width
        self.items = [item for item, _ in segments]
        self.texts = [b" ".join(ws) for _, ws in segments]
        rng = np.random.default_rng(20)
        self.factors = rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for number, (_, ws) in enumerate(segments):
            n = min(width, len(ws))
            if n:
                h = self._hash(word_hashes(ws), n)
                begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in ws])])
                parts.setdefault(n, []).append((h, np.full(len(h), number, np.int32), np.stack([begins[: len(h)], begins[n : n + len(h)] - 1]).astype(np.int32)))
        self.by_length = []
        for n, found in sorted(parts.items()):
            h, number, span = (np.concatenate([f[k] for f in found], axis=-1) for k in range(3))
            order = np.argsort(h, kind="stable")
            self.by_length.append((n, h[order], number[order], span[:, order]))

    def _hash(self, h: np.ndarray, n: int) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * self.factors[k]
        return out ^ (out >> np.uint64(29))

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """((start, width) of occurring windows, items that have them)."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.by_length or len(ws) < self.by_length[0][0]:
            return spans, items
        words = word_hashes(ws)
        for n, hashes, numbers, places in self.by_length:
            if len(ws) < n:
                break
            own = self._hash(words, n)
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            for k in (hashes[at] == own).nonzero()[0].tolist():
                text, found = b" ".join(ws[k : k + n]), False
                for x in range(int(at[k]), len(hashes)):
                    if hashes[x] != own[k]:
                        break
                    if self.texts[numbers[x]][places[0, x] : places[1, x]] == text:
                        found = True
                        items.add(self.items[numbers[x]])
                if found:
                    spans.append((k, n))
        return spans, items

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """(mask of hit words or None, items with occurring windows)."""
        spans, items = self.hits(ws)
        return marked(len(ws), spans), items


def word_hashes(ws: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def marked(n: int, spans: list[tuple[int, int]]) -> np.ndarray | None:
    if not spans:
        return None
    marks = np.zeros(n + 1, np.int32)
    for at, width in spans:
        marks[at] += 1
        marks[at + width] -= 1
    return np.cumsum(marks[:-1]) > 0


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and what stands between two of them."""
    out, last, before = [], 0, False
    for k, m in enumerate(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)):
        if hit[k]:
            if not before:
                out.append(text[last : m.start()])
            last = m.end()
        before = bool(hit[k])
    return b"".join([*out, text[last:]])


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _row(ws: list[bytes], mask: np.ndarray | None, items: set[str], text: bytes | None) -> tuple:
    n_hit = 0 if mask is None else int(mask.sum())
    cleaned = text if not n_hit or text is None else cut(text, mask)
    return len(ws), n_hit, len(items), _digest(items), n_hit > 0, None if cleaned is None else cleaned.decode("utf-8", "replace")


def segments(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, segment, n, words): items' normal words in segments that together have every window, checkpointed.

    Items (item_id, text) with a null id or text, or without words, are left out; repeated rows count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ws = normal_words(text)
                for at in range(0, max(1, len(ws) - width + 1) if ws else 0, SEGMENT):
                    part = ws[at : at + SEGMENT + width - 1]
                    rows.append((item, at, max(1, len(part) - width + 1), b" ".join(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["item_id", "segment", "n", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return checkpoint(items.mapInArrow(run, "item_id string, segment long, n long, words binary").dropDuplicates(["item_id", "words"]))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, prefix: str = "", limit: int = WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, cleaned (each after ``prefix``).

    ``cleaned`` is the text without hit spans. Null and blank texts have no words; long ones are scanned whole by one
    task; repeated rows and ids are rows like any other; empty tables give an empty result, or one without hits.
    Items are those of ``segments``. Columns of ``docs`` that have a result's name are replaced, all others may have
    any names. Up to ``limit`` windows are broadcast at once; with more, there is a pass for each block of them.
    """
    pairs = [(prefix + n, t) for n, t in (x.split() for x in RESULT.split(", "))]
    base = docs.drop(*(n for n, _ in pairs))
    place = base.columns.index(text)
    schema = base.limit(0).withColumns({n: F.lit(None).cast(t) for n, t in pairs}).schema
    parts = segments(benchmark, width)
    total, size, most = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)), F.count(F.lit(1))).first()
    load = max(total / max(limit, 1), size / BLOCK_BYTES)  # of the number of windows and of the bytes of their words, what is nearer to its bound
    blocks = 1 if load <= 1 else min(most, math.ceil(2 * load))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def block(k: int):
        """Segments of a block, broadcast; ``limit`` windows, about."""
        rows = parts.where(F.pmod(F.xxhash64("item_id", "segment"), F.lit(blocks)) == k).collect()
        # A name of its own: an address may be that of an older block in a worker that is used again.
        return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, bytes(r.words)) for r in rows]))

    def written(batch: pa.RecordBatch, columns: list, rows: list[tuple]) -> pa.RecordBatch:
        made = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=schema.names)

    if blocks == 1:
        sent = block(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _window_set(sent, width)
            for b in batches:
                rows = []
                for t in b.column(place).cast(pa.binary()).to_pylist():
                    ws = normal_words(t)
                    rows.append(_row(ws, *found.scan(ws), t))
                yield written(b, b.columns, rows)

        return numbered(base).mapInArrow(run, schema)

    p = fresh(base)
    keyed = base.withColumn(f"{p}key", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    texts = keyed.select(F.col(f"{p}key").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def pass_over(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _window_set(sent, width)
            for b in batches:
                rows = []
                for key, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    spans, items = found.hits(normal_words(t))
                    if spans:
                        rows.append((key, [x for s in spans for x in s], sorted(items)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())))], names=["key", "spans", "items"])

        # Equal texts have equal hits: one row of each key and block.
        found = checkpoint(texts.mapInArrow(run, "key string, spans array<bigint>, items array<string>").dropDuplicates(["key"]))
        sent.unpersist()
        return found

    hits = reduce(DataFrame.unionByName, (pass_over(block(k)) for k in range(blocks)))
    hits = hits.groupBy(F.col("key").alias(f"{p}key")).agg(F.flatten(F.collect_list("spans")).alias(f"{p}spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias(f"{p}items"))
    joined = keyed.join(hits, f"{p}key", "left").select(*(F.col(f"`{c}`") for c in base.columns), f"{p}spans", f"{p}items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans, items in zip(b.column(place).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                ws, spans = normal_words(t), spans or []
                rows.append(_row(ws, marked(len(ws), list(zip(spans[::2], spans[1::2], strict=True))), set(items or ()), t))
            yield written(b, b.columns[:-2], rows)

    return numbered(joined).mapInArrow(finish, schema)


_BUILT: dict[tuple[str, int], WindowSet] = {}


def _window_set(sent, width: int) -> WindowSet:
    """The set of a broadcast block, built once in each worker; only the last one is kept."""
    name, rows = sent.value
    key = (name, width)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WindowSet([(item, words.split()) for item, words in rows], width)
    return _BUILT[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` without contaminated rows, or with ``spans`` without the hit spans of their texts. Columns may have any names; see ``scan``."""
    own = fresh(docs) + "hit_"
    found = scan(docs, benchmark, text, prefix=own)
    if spans:
        return found.withColumn(text, F.col(f"{own}cleaned")).select(*(F.col(f"`{n}`") for n in docs.columns))
    return found.where(~F.col(f"{own}contaminated")).select(*(F.col(f"`{n}`") for n in docs.columns))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0
), b AS (
  SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM s)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT d.doc_id, d.w, l.n, unnest(range(1, greatest(len(d.w) - l.n + 2, 1))) AS k FROM d, (SELECT DISTINCT n FROM b) l
), h AS (
  SELECT p.doc_id, p.k, p.n, b.item FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM p) p JOIN b ON p.n = b.n AND p.s = b.s
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
