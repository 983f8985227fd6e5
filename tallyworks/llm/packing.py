"""Best-fit packing of token sequences with bounded space.

A partition tokenizes its documents and packs the pieces as they come: open bins hang in a bitset keyed by
free space, a piece goes to the open bin with the least free space that takes it, and when too many bins
are open the fullest closes. Bins still open at a partition's end are packed once more, as whole items,
in the same way, so partitions don't cost half-empty bins.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

CAPACITY = 4096
#: Bins that a packer keeps open.
OPEN_BINS = 1024
#: Left-over bins that one task of the second packing takes.
LEFT_PER_TASK = 200_000
#: Distinct words and word parts whose ids a task keeps (some 100 and 170 bytes each, under 200 MB); they go when it ends, so idle workers hold none.
KEPT_WORDS, KEPT_PARTS = 900_000, 500_000
#: Words that the quick way takes: printable ASCII, and the Latin letters that NFC leaves alone and that lower-case one by one.
QUICK = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


class Kept(dict):
    """Packed ids by key, made as they are asked for; ``most`` at a time."""

    def __init__(self, most: int, made: Callable) -> None:
        self.most, self.made = most, made

    def __missing__(self, key) -> bytes:
        out = self.made(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = out
        return out


def part_ids(tokenize: Callable) -> Callable[[str], bytes]:
    """Ids of a word part by a model over the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: printable bytes stand for themselves,
    rest = [b for b in range(256) if b not in plain]  # the others for characters from 256 on
    alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def made(part: str) -> bytes:
        ids = [t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    return made


def word_ids(tokenizer, part: Callable[[str], bytes]) -> Callable[[bytes], bytes]:
    """Ids of a word by those of its parts, or by the library. Letters alone are one part, and ASCII marks after ASCII letters another."""

    def made(w: bytes) -> bytes:
        letters = w.rstrip(MARKS)
        if letters.isalpha():
            out = part(letters.lower().decode())
            return out if len(letters) == len(w) else out + part(w[len(letters) :].decode())
        text = w.decode("utf-8", "replace")
        if QUICK(text):
            text = text.lower()
            return part(text) if text.isalpha() else b"".join(map(part, PARTS(text)))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return made


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Ids by a tokenizer whose words end at blanks, with the ids of words kept; texts with special tokens go to the library whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        part = Kept(KEPT_PARTS, part_ids(self.tokenizer.model.tokenize))
        self.word = Kept(KEPT_WORDS, word_ids(self.tokenizer, part.__getitem__)).__getitem__

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if b"<|" in text:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.word, text.split()))


class BestFit:
    """Bounded-space online best-fit. ``add`` gives (bin, offset); bins that close go to ``closed``, in order."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.free_bits = 0  # bit f: some open bin has f free
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        stack = self.at[free]
        b = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return b

    def add(self, size: int) -> tuple[int, int]:
        fitting = self.free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left == 0:
            self.closed.append(b)
        else:
            self.at.setdefault(left, []).append(b)
            self.free_bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self.closed.append(self._take((self.free_bits & -self.free_bits).bit_length() - 1))
        return b, self.capacity - free

    def rest(self) -> list[tuple[int, int]]:
        """(bin, fill) of the bins that are still open."""
        return [(b, self.capacity - free) for free, stack in self.at.items() for b in stack]


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, bins = WordTokenizer(path).encode, BestFit(capacity, open_bins)
    first, end = TaskContext.get().partitionId() << 36, np.array([end_id], "<u4").tobytes()
    held: dict[int, list[tuple]] = {}
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids = encode(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                n = len(part) // 4
                to, offset = bins.add(n)
                held.setdefault(to, []).append((doc, piece, at // 4, n, zlib.crc32(part), first + to, offset))
            for c in bins.closed:
                out += [(*r, 0) for r in held.pop(c)]
            bins.closed.clear()
        yield _batch(out)
    yield _batch((*r, fill) for to, fill in bins.rest() for r in held[to])


def _merge(batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """(bin, into, base): whole bins packed into bins; ``into`` is named after the first bin that went in."""
    bins, named = BestFit(capacity, open_bins), {}
    for b in batches:
        rows = []
        for one, fill in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            to, base = bins.add(fill)
            rows.append((one, named.setdefault(to, one), base))
        for c in bins.closed:
            named.pop(c, None)
        bins.closed.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["bin", "into", "base"])


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", doc_id: str = "doc_id",
    capacity: int = CAPACITY, end_id: int = 1, open_bins: int = OPEN_BINS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Each row, a null or blank text and a null or repeated id included, is its own document of at least the
    end id. Only documents over ``capacity`` are cut. The tokenizer's file must be at ``tokenizer_path`` on
    every executor (the installed public vocabulary if not given). Other columns aren't read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = checkpoint(rows.mapInArrow(lambda it: _pack(it, tokenizer_path, end_id, capacity, open_bins), SCHEMA))
    left = packed.where("fill > 0").where("offset = 0").select("bin", "fill")
    tasks = max(1, -(-left.count() // LEFT_PER_TASK))
    order = F.xxhash64("bin")
    merged = left.repartition(tasks, "bin").sortWithinPartitions(F.desc("fill"), order).mapInArrow(lambda it: _merge(it, capacity, open_bins), "bin long, into long, base long")
    again = packed.where("fill > 0").join(merged, "bin")
    done = packed.where("fill = 0").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return done.unionByName(again.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset")))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return pack(read_table(spark, sf_dir, "documents"))
