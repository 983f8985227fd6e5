"""Repeated passages across documents: recurring windows, passages of their owners, sharded automata.

1. Every document's windows of ``WINDOW`` words are hashed (64 bits) with numpy. A map task settles what the
   documents that it has gathered share among themselves, and sends only the smallest id of each window, delta
   coded and compressed, to hash buckets. So however many documents share a window, its bucket gets one id from
   each gathering.
2. A bucket finds the windows that two or more ids have. Ids of one window form a tree of ``BRANCHES`` branches
   in ascending order: the parent, a smaller id, owes the passage to the shard of the child. So no owner has
   to serve more than a bounded number of others, however often a window recurs.
3. A shard of documents turns what its owners owe into passages: their words, in the longest runs of such windows
   for a shard that asked. Passages travel as words, to every shard that holds documents which may repeat them.
4. A shard compiles the passages that came into an Aho-Corasick automaton over word numbers, whose keys are the
   passages' aligned blocks of seven words (each window of 13 contains one), and streams all its documents through
   it. Where a block occurs, the match is extended word by word; 13 equal words or more are removed if the
   passage's owner is smaller than the document. So nothing is removed that words don't confirm.
5. Windows whose hash came with a passage, but whose words are in none, have a hash that different words share. Their
   documents are grouped by the words themselves, and stage 4 runs again with the passages that this adds.

Documents are dealt by hashes of ids into shards of a bounded size, so a source or passage that many documents
share is spread over all of them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_bytes

WINDOW = 13
#: Windows that a map task gathers before it sends them off; bounds its memory.
GATHER = 1 << 20
#: Bytes of text of a document shard, and of the text whose windows share a hash bucket.
SHARD_BYTES = 5 << 20
#: Buckets that one shuffle cuts a range of hashes into, so that what a gathering sends to each stays large.
FANOUT = 2048
#: Ids that one smaller id owes a window to.
BRANCHES = 64
#: Bits of a hash that tell which blocks of words can be an automaton's keys (a byte for each value, in each shard's task).
SEEN_BITS = 22
#: Hashes that are looked for at once where different words share them (8 bytes each, broadcast).
LOST_AT_ONCE = 1 << 20

Hasher = Callable[[np.ndarray, int], np.ndarray]


def split_words(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of UTF-8 text."""
    return (text or b"").split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


class Vocabulary(dict):
    """Numbers of words, from 0 as they come, and the words' 64-bit hashes."""

    def __init__(self) -> None:
        import xxhash

        self.digest, self.found = xxhash.xxh64_intdigest, array("Q")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.found)
        self.found.append(self.digest(word))
        return n

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.found, np.uint64)[numbers] if len(numbers) else np.zeros(0, np.uint64)


def window_hashes(h: np.ndarray, width: int = WINDOW, seed: int = 97) -> np.ndarray:
    """64-bit hash of each window of ``width`` consecutive words, from the words' hashes."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    h = h ^ (h >> np.uint64(29))
    odd = np.random.default_rng(seed).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out += h[k : len(h) - width + 1 + k] * odd[k]
    out ^= out >> np.uint64(32)  # the last step spreads the good high bits over the low ones
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """What ``pmod(xxhash64(id), shards)`` gives in Spark for longs: XXH64 of eight bytes, seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = (np.uint64(50) + p5) ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))).view(np.int64) % shards).astype(np.int32)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, the first one ascending; bytes of equal weight stand together, compressed."""
    import zstandard

    first = columns[0].astype(np.uint64)
    parts = [np.diff(first, prepend=np.uint64(0)), *(c.astype(np.int64).view(np.uint64) for c in columns[1:])]
    planes = b"".join(np.ascontiguousarray(p.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = len(flat) // (8 * n)
    cols = [np.ascontiguousarray(p.reshape(8, width).T).view("<u8").reshape(-1) for p in flat.reshape(n, -1)]
    return [np.cumsum(cols[0], dtype=np.uint64), *(c.view(np.int64) for c in cols[1:])]


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        if b > a:
            yield int(keys[a]), int(a), int(b)


def settle(hashes: np.ndarray, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, their smallest ids, debts): a debt is a column (window, owner, shard that needs the owner's words)."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])  # repeats within a document count once
    hashes, ids = hashes[new], ids[new]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    begin = np.flatnonzero(first)[np.cumsum(first) - 1]
    child = np.flatnonzero(~first)
    parent = begin[child] + (child - begin[child] - 1) // BRANCHES
    debts = np.stack([hashes[child].view(np.int64), ids[parent], shard_of(ids[child], shards).astype(np.int64)])
    again = np.zeros(len(child), bool)
    again[1:] = (debts[:, 1:] == debts[:, :-1]).all(axis=0)
    return hashes[first], ids[first], debts[:, ~again]


def _debts(columns: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """(shard of the owner, blob) of debts."""
    h, o, to = columns
    at = shard_of(o, shards)
    order = np.lexsort((h.view(np.uint64), at))
    h, o, to, at = h[order].view(np.uint64), o[order], to[order], at[order]
    return [(s, _pack(h[a:b], o[a:b], to[a:b])) for s, a, b in _runs(at)]


def _rows(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[name, "blob"])


class Gathering:
    """Windows and ids of one task, sent off in parts: smallest ids to buckets 0 and up, debts to -1 - shard."""

    def __init__(self, buckets: int, shards: int) -> None:
        self.buckets, self.shards, self.held = buckets, shards, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        if len(hashes):
            self.parts.append((hashes, ids))
            self.held += len(hashes)

    def send(self) -> pa.RecordBatch:
        h, d, debts = settle(*(np.concatenate([p[k] for p in self.parts]) for k in (0, 1)), self.shards)
        self.parts, self.held = [], 0
        at = ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        rows = [(k, _pack(h[a:b], d[a:b])) for k, a, b in _runs(at)]
        return _rows([*rows, *((-1 - s, blob) for s, blob in _debts(debts, self.shards))], "bucket")


def _windows(batches: Iterator[pa.RecordBatch], buckets: int, shards: int, width: int, hasher: Hasher) -> Iterator[pa.RecordBatch]:
    found = Gathering(buckets, shards)
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            h = hasher(word_hashes(split_words(text.as_py())), width)
            found.add(h, np.full(len(h), doc, np.int64))
            if found.held >= GATHER:
                yield found.send()
    if found.held:
        yield found.send()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, some blobs) of rows sorted by bucket, each batch by itself."""
    for b in batches:
        keys, blobs = b.column(0).to_numpy(), b.column(1).to_pylist()
        for key, a, z in _runs(keys):
            yield key, blobs[a:z]


def _refine(batches: Iterator[pa.RecordBatch], buckets: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Gathers what a range of hashes got and deals it out to finer buckets; debts go on as they are."""
    found, last = Gathering(buckets, shards), None
    for key, blobs in _by_bucket(batches):
        if key < 0:
            yield _rows([(key, blob) for blob in blobs], "bucket")
            continue
        if found.held and (key != last or found.held >= GATHER):
            yield found.send()
        last = key
        for blob in blobs:
            found.add(*_unpack(blob, 2))
            if found.held >= GATHER:
                yield found.send()
    if found.held:
        yield found.send()


def _confirm(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Debts of each bucket's windows to the owners' shards; debts made before go on as they are."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    made: list[np.ndarray] = []
    last = None

    def close() -> None:
        if parts:
            made.append(settle(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)), shards)[2])
            parts.clear()

    def send() -> pa.RecordBatch:
        rows = _debts(np.concatenate(made, axis=1), shards)
        made.clear()
        return _rows(rows, "shard")

    for key, blobs in _by_bucket(batches):
        if key < 0:
            yield _rows([(-1 - key, blob) for blob in blobs], "shard")
            continue
        if key != last:
            close()
            last = key
            if sum(m.shape[1] for m in made) >= GATHER:
                yield send()
        parts.extend(tuple(_unpack(blob, 2)) for blob in blobs)
    close()
    if made:
        yield send()


def levels(buckets: int) -> list[int]:
    """Bucket counts of the shuffles, one after the other.

    >>> levels(100), levels(FANOUT * 3)
    ([100], [2048, 6144])
    """
    out, n = [], FANOUT
    while n < buckets:
        out.append(n)
        n *= FANOUT
    return [*out, buckets]


def owed(docs: pa.Table, debts: pa.Table, width: int, hasher: Hasher) -> Iterator[tuple[int, int, bytes]]:
    """(shard, owner, words) of the passages that the owners among ``docs`` owe."""
    if not debts.num_rows:
        return
    columns = [_unpack(b, 3) for b in debts["blob"].to_pylist()]
    h, o, to = (np.concatenate([c[k] for c in columns]) for k in range(3))
    order = np.lexsort((to, o))
    h, o, to = h[order], o[order], to[order]
    by_owner = {owner: (a, b) for owner, a, b in _runs(o)}
    for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()), strict=True):
        if doc not in by_owner:
            continue
        a, b = by_owner[doc]
        ws = split_words(text.as_py())
        own = hasher(word_hashes(ws), width)
        by_hash = np.argsort(own, kind="stable")
        ranked = own[by_hash]
        for shard, x, y in _runs(to[a:b]):
            wanted = np.unique(h[a + x : a + y])
            low, high = np.searchsorted(ranked, wanted), np.searchsorted(ranked, wanted, "right")
            at = np.sort(np.concatenate([by_hash[i:j] for i, j in zip(low, high, strict=True)])) if len(own) else by_hash
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                if len(run):
                    yield shard, doc, b" ".join(ws[run[0] : run[-1] + width])


class PassageAutomaton:
    """Aho-Corasick over word numbers: finds every stretch of ``width`` words or more that a document shares with a passage.

    Keys are aligned blocks of passages, of which every window contains one; a block that occurs is extended in
    both directions, word by word.
    """

    def __init__(self, passages: dict[bytes, int], width: int = WINDOW) -> None:
        """``passages``: words joined by blanks, with the smallest id that has them."""
        import ahocorasick

        self.width, self.block, self.vocabulary = width, (width + 1) // 2, Vocabulary()
        self.texts: list[np.ndarray] = []
        self.owners: list[int] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for passage, owner in sorted(passages.items(), key=lambda p: (p[1], p[0])):
            numbers = self.vocabulary.numbers(passage.split())
            plain = numbers.tolist()
            for at in range(0, len(plain) - self.block + 1, self.block):
                places.setdefault(tuple(plain[at : at + self.block]), []).append((len(self.texts), at))
            self.texts.append(numbers)
            self.owners.append(owner)
        # Which hashes a block can have: the automaton reads the stretches of a document that can hold one.
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self._marks(np.array([x for block in places for x in block], np.int64))[:: self.block]] = True
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, at in places.items():
            self.machine.add_word(block, at)
        if places:
            self.machine.make_automaton()

    def _marks(self, numbers: np.ndarray) -> np.ndarray:
        """The place in ``seen`` of each block of consecutive words."""
        return (window_hashes(numbers.astype(np.uint64), self.block) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)

    def _stretches(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Where all blocks are that may be keys."""
        at = self.seen[self._marks(numbers)].nonzero()[0]
        if not len(at):
            return []
        apart = np.flatnonzero(np.diff(at) > self.block)
        return list(zip([int(at[0]), *at[apart + 1].tolist()], [*(at[apart] + self.block).tolist(), int(at[-1]) + self.block], strict=True))

    def covered(self, ws: list[bytes], doc: int | None) -> np.ndarray:
        """Mask of the words inside windows that a passage of an owner smaller than ``doc`` has."""
        return self.mask(self.vocabulary.numbers(ws), doc)

    def mask(self, numbers: np.ndarray, doc: int | None) -> np.ndarray:
        mask = np.zeros(len(numbers), bool)
        if doc is None or not self.texts or len(numbers) < self.width:
            return mask
        width, block, owners = self.width, self.block, self.owners
        done: dict[tuple[int, int], int] = {}
        for a, b in self._stretches(numbers):
            for end, places in self.machine.iter(tuple(numbers[a:b].tolist())):
                begin = a + end + 1 - block
                for passage, at in places:
                    if owners[passage] >= doc:
                        break  # places are by owner
                    line = (passage, begin - at)
                    if done.get(line, 0) > begin:
                        continue
                    if mask[max(0, begin + block - width) : begin + width].all():
                        break  # every window over this block is covered already
                    left, right = self._extent(numbers, self.texts[passage], begin, at)
                    done[line] = right
                    if right - left >= width:
                        mask[left:right] = True
        return mask

    def _extent(self, numbers: np.ndarray, passage: np.ndarray, begin: int, at: int) -> tuple[int, int]:
        """The longest stretch around a block in which document and passage agree."""
        back = min(begin, at)
        differs = (numbers[begin - back : begin] != passage[at - back : at]).nonzero()[0]
        left = begin - back + (int(differs[-1]) + 1 if len(differs) else 0)
        ahead = min(len(numbers) - begin, len(passage) - at)
        differs = (numbers[begin : begin + ahead] != passage[at : at + ahead]).nonzero()[0]
        return left, begin + (int(differs[0]) if len(differs) else ahead)


def located(docs: pa.Table, passages: pa.Table, width: int, hasher: Hasher) -> Iterator[tuple[int | None, list[bytes], np.ndarray, list[int]]]:
    """(id, words, removed mask, hashes of windows that should be there but aren't) of each document of a shard."""
    owner_of: dict[bytes, int] = {}
    for owner, words in zip(passages["owner"].to_pylist(), passages["words"].to_pylist(), strict=True):
        owner_of[words] = min(owner, owner_of.get(words, owner))
    automaton = PassageAutomaton(owner_of, width)
    vocabulary = automaton.vocabulary
    parts = [(h, np.full(len(h), owner, np.int64)) for t, owner in zip(automaton.texts, automaton.owners, strict=True) for h in (hasher(vocabulary.hashes(t), width),)]
    if parts:
        h, o = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        h, o = h[first], o[first]
    for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()), strict=True):
        ws = split_words(text.as_py())
        if not parts or doc is None or len(ws) < width:
            yield doc, ws, np.zeros(len(ws), bool), []
            continue
        numbers = vocabulary.numbers(ws)
        mask, own = automaton.mask(numbers, doc), hasher(vocabulary.hashes(numbers), width)
        at = np.searchsorted(h, own)
        at[at == len(h)] = 0
        there = (h[at] == own).nonzero()[0]
        lost: list[int] = []
        if len(there):
            sums = np.concatenate([[0], np.cumsum(mask)])
            there = there[(o[at[there]] < doc) & (sums[there + width] - sums[there] < width)]
            lost = np.unique(own[there]).view(np.int64).tolist()
        yield doc, ws, mask, lost


FOUND = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, lost array<bigint>"
KINDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("lost", pa.list_(pa.int64()))])


def _passages(sharded: DataFrame, buckets: int, shards: int, width: int, hasher: Hasher) -> DataFrame:
    """(shard, owner, words): the passages that each shard needs."""
    tasks = max(int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    first, *finer = levels(buckets)
    blobs = sharded.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lambda it: _windows(it, first, shards, width, hasher), "bucket int, blob binary")
    for n in finer:
        dealt = blobs.repartition(tasks, "bucket", F.pmod(F.xxhash64("blob"), F.lit(BRANCHES))).sortWithinPartitions("bucket")
        blobs = dealt.mapInArrow(lambda it, n=n: _refine(it, n, shards), "bucket int, blob binary")
    dealt = blobs.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    debts = dealt.mapInArrow(lambda it: _confirm(it, shards), "shard int, blob binary")

    def cut(_key, docs: pa.Table, debts: pa.Table) -> pa.Table:
        rows = list(owed(docs, debts, width, hasher))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "owner", "words"])

    return sharded.groupBy("shard").cogroup(debts.groupBy("shard")).applyInArrow(cut, "shard int, owner long, words binary")


def _locate(sharded: DataFrame, passages: DataFrame, width: int, hasher: Hasher, texts: bool) -> DataFrame:
    def locate(_key, docs: pa.Table, passages: pa.Table) -> pa.Table:
        rows = []
        for doc, ws, gone, lost in located(docs, passages, width, hasher):
            kept = b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if gone.any() else ws)
            rows.append((doc, len(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None, lost))
        columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
        return pa.table([pa.array(c, k) for c, k in zip(columns, KINDS.types, strict=True)], schema=KINDS)

    return sharded.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(locate, FOUND)


def _same_words(sharded: DataFrame, lost: DataFrame, n: int, width: int, hasher: Hasher) -> DataFrame:
    """Passages of windows whose hash different words share, found by the words themselves, some hashes at a time."""
    blocks, found = -(-n // LOST_AT_ONCE), []
    for k in range(blocks):
        hashes = np.array([r.h for r in lost.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k).collect()], np.int64)  # LOST_AT_ONCE, about
        sent = sharded.sparkSession.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))

        def pick(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for shard, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                    ws = split_words(text.as_py())
                    rows += [(shard, doc, words) for words in {b" ".join(ws[at : at + width]) for at in np.flatnonzero(np.isin(hasher(word_hashes(ws), width), sent.value))}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["shard", "doc_id", "words"])

        rows = sharded.where("doc_id IS NOT NULL").select("shard", "doc_id", "text").mapInArrow(pick, "shard int, doc_id long, words binary")
        # Each window's holders by (words, shard): one row a shard, so a window that many share stays small.
        by_shard = rows.groupBy("words", "shard").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        least = by_shard.groupBy("words").agg(F.min("low").alias("owner"), F.max("high").alias("last")).where("owner < last")
        found.append(by_shard.join(least.select("words", "owner"), "words").where("owner < high").select("shard", "owner", "words"))
    return checkpoint(reduce(DataFrame.unionByName, found))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW, texts: bool = True, hasher: Hasher = window_hashes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row; kept_text is null without ``texts``.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller id. Null and blank
    texts have no words, texts shorter than a window lose none, and long ones are worked on whole by one task. Rows
    with one id never remove each other's words, and repeated rows stay rows; rows with a null id neither remove nor
    lose words. An empty table gives an empty result. Columns of ``docs`` other than the two aren't read, so their
    names don't matter. The result is checkpointed. ``hasher`` may be any hash of windows: it costs time if it is
    weak, but doesn't change the result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    conf = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(conf, -(-text_bytes(rows) // SHARD_BYTES))
    at = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    sharded = rows.select(F.pmod(at, F.lit(shards)).cast("int").alias("shard"), "doc_id", "text")
    passages = _passages(sharded, shards, shards, width, hasher)
    found = checkpoint(_locate(sharded, passages, width, hasher, texts))
    lost = found.select(F.explode("lost").alias("h")).distinct()
    n = lost.count()
    if n:
        passages = passages.unionByName(_same_words(sharded, lost, n, width, hasher))
        found = checkpoint(_locate(sharded, passages, width, hasher, texts))
    return found.drop("lost")


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return remove_repeats(read_table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p
), m AS (
  SELECT s, min(doc_id) AS owner FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1
), h AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM (SELECT g.doc_id, g.i FROM g JOIN m ON g.s = m.s WHERE m.owner < g.doc_id)
), v AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d
), k AS (
  SELECT v.doc_id, count(h.j) AS n_removed, string_agg(CASE WHEN h.j IS NULL THEN v.word END, ' ' ORDER BY v.j) AS kept
  FROM v LEFT JOIN h ON v.doc_id = h.doc_id AND v.j = h.j GROUP BY v.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
