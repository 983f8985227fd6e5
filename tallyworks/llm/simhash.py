"""SimHash near-duplicate detection by bit-sliced comparison.

Fingerprints come from one pass over the texts (Arrow batches, numpy). Only distinct fingerprints are
compared. Pairs within the radius are found exactly: the 64 bits are cut into blocks, two fingerprints
within radius r agree on all but r blocks, so every table of "the other blocks" brings each such pair
together. A bucket of a table is stored as vertical bit planes, many queries are compared with it at
once by carry-save counters, and the comparison is abandoned once all lanes exceed the radius.

Buckets beyond ``TILE`` fingerprints are cut into parts, by another hash in each table, that are first
compared within themselves only; as tables mix the parts anew, that links nearly all of a large group. Only
buckets whose members are not all linked by then have their parts compared with each other. Each tile returns
a spanning forest of its links, never all pairs, and no task gets an unbounded group.

``near_copies`` finds texts by the similarity of their shingle sets: bits of wider fingerprints propose, bit-sliced
comparison sifts, and whole sets confirm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hex64

#: Fingerprints of one part of a bucket; a tile holds two parts at most.
TILE = 4096
#: Queries compared with a part at once.
QUERIES = 256
#: Shingles hashed at once, so a very long text needs bounded memory.
CHUNK = 1 << 16
#: Parts that the rows of one fingerprint are dealt into where they meet their component.
SALTS = 32
#: Rows that are broadcast at most to pick rows by id (some 50 bytes each); more go through a shuffled join.
BROADCAST_ROWS = 250_000

#: near_copies: words of a shingle, and the similarity from which texts are copies of each other.
WIDTH, SIMILARITY = 5, 0.8
#: How likely the tables may miss a pair of just that similarity; members of a bucket on average, about.
MISS, MEMBERS = 0.005, 64
#: Fingerprint words that pairs of a bucket are sifted by, and the deviations of their distance that pass.
SIFT, DEVIATIONS = 2, 3.5
#: Bytes of text of one part of a group of likely copies, and how often a larger group is dealt anew.
GROUP_BYTES, ROUNDS = 8 << 20, 4


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over ``width``-word shingles, repeats included; 0 for a text without words.

    Fewer words than ``width`` make one shingle of all of them.
    """
    import xxhash

    ws = words_of(text)
    if not ws:
        return 0
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(ws) - width + 1)
    for at in range(0, total, CHUNK):
        part = ws[at : at + CHUNK + width - 1]
        shingles = zip(*(part[k:] for k in range(width)), strict=False) if len(part) >= width else [part]
        h = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((counts * 2 > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), width: int = 3, seed: int = 42) -> DataFrame:
    """``keys`` and ``fp`` (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*keys, "fp"])

    rows = docs.select(*keys, F.col(f"`{text}`").alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + (", " if keys else "") + "fp long"
    return rows.mapInArrow(run, schema)


def block_masks(radius: int, kept: int = 4) -> list[int]:
    """One mask for each table: ``kept`` of ``radius + kept`` equal blocks that a pair within the radius agrees on.

    >>> len(block_masks(2, 2))
    6
    """
    n = radius + kept
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, kept)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes over the lanes: row p has bit p of every fingerprint, 64 lanes to a word. ``fps``: (n,) or (n, words)."""
    fps = fps.reshape(len(fps), -1)
    lanes, bits_each = -(-len(fps) // 64) * 64, 64 * fps.shape[1]
    bits = np.zeros((lanes, bits_each), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (queries x words of lanes): lanes at most ``radius`` bits from each query."""
    queries, ones = queries.reshape(len(queries), -1), ~np.uint64(0)
    counters = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros_like(counters[0])

    def beyond() -> np.ndarray:
        more, same = over.copy(), np.full_like(over, ones)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more

    for p in range(len(planes)):
        bit = (queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        carry = planes[p][None, :] ^ np.where(bit, ones, np.uint64(0))[:, None]
        for c in counters:
            c_next = c & carry
            c ^= carry
            carry = c_next
        over |= carry
        if p % 8 == 7 and p >= radius and (beyond() == ones).all():
            break
    return ~beyond()


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest (index, root index) of the links among ``a`` (``b`` None), or between ``a`` and ``b``, over a then b."""
    lanes = a if b is None else b
    shift, planes = (0 if b is None else len(a)), planes_of(lanes)
    label = np.arange(len(a) + (0 if b is None else len(b)))
    for at in range(0, len(a), QUERIES):
        hits = within(a[at : at + QUERIES], planes, radius)
        for k in np.flatnonzero(hits.any(axis=1)):
            found = np.flatnonzero(np.unpackbits(hits[k].view(np.uint8), bitorder="little")[: len(lanes)]) + shift
            roots = np.unique(np.append(label[found], label[at + k]))
            for r in roots[1:]:
                label[label == r] = roots[0]
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(len(label)))]


#: What compares the rows of one tile: (rows, numbers of the parts) to pairs of row numbers.
Compare = Callable[[pa.Table, np.ndarray], list[tuple[int, int]]]
#: Lanes of a word: tiles that don't fill one are compared together, by population counts.
LANES = 64


class ByBits:
    """Compares fingerprints, held in the long columns ``names``: bit-sliced, or many small tiles at once."""

    def __init__(self, radius: int, names: tuple[str, ...]) -> None:
        self.radius, self.names = radius, names

    def _fps(self, rows: pa.Table) -> np.ndarray:
        return np.stack([rows[n].to_numpy().view(np.uint64) for n in self.names], axis=1)

    def __call__(self, rows: pa.Table, parts: np.ndarray) -> list[tuple[int, int]]:
        fps = self._fps(rows)
        if (parts == parts[0]).all():
            return forest(fps, None, self.radius)
        one, two = np.flatnonzero(parts == parts.min()), np.flatnonzero(parts == parts.max())
        every = np.concatenate([one, two])
        return [(int(every[x]), int(every[y])) for x, y in forest(fps[one], fps[two], self.radius)]

    def small(self, rows: pa.Table, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spanning forest (row, root) of all tiles of ``LANES`` rows at most; ``tile`` ascends."""
        fps, label, found = self._fps(rows), np.arange(len(tile)), []
        for d in range(1, LANES):
            at = np.flatnonzero(tile[d:] == tile[:-d])
            if not len(at):
                break
            at = at[np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1) <= self.radius]
            found.append(np.stack([at, at + d]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        while pairs.shape[1]:
            low, high = np.minimum(*label[pairs]), np.maximum(*label[pairs])
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
            pairs = pairs[:, label[pairs[0]] != label[pairs[1]]]
        linked = np.flatnonzero(label != np.arange(len(label)))
        return linked, label[linked]


def by_bits(radius: int, names: tuple[str, ...]) -> Compare:
    return ByBits(radius, names)


def _tiles(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (bucket, i, j), which may go over several batches. Columns: bucket, i, j, part, node, ..."""
    held: list[pa.RecordBatch] = []
    names = ("bucket", "i", "j")

    def links(run: pa.Table) -> np.ndarray:
        parts = run["part"].to_numpy()
        cross = run["i"][0].as_py() != run["j"][0].as_py()
        pairs = [] if len(run) < 2 or cross and (parts == parts[0]).all() else compare(run, parts)
        return run["node"].to_numpy()[np.array(pairs, np.int64).reshape(-1, 2)]

    def done(t: pa.Table) -> pa.RecordBatch:
        keys = [t[c].to_numpy() for c in names]
        begins = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1])
        sizes = np.diff(np.append(begins, len(t)))
        few = (sizes <= LANES) & (keys[1] == keys[2])[begins] if hasattr(compare, "small") else np.zeros(len(begins), bool)
        out = [links(t.slice(int(x), int(n))) for x, n in zip(begins[~few], sizes[~few], strict=True)]
        if few.any():
            tile = np.repeat(np.arange(len(begins)), sizes)
            at = np.flatnonzero(few[tile])
            node = t["node"].to_numpy()[at]
            row, root = compare.small(t.take(pa.array(at)), tile[at])
            out.append(np.stack([node[row], node[root]], axis=1))
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        keys = [t[c].to_numpy() for c in names]
        other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(other):
            open_from = int(other[-1]) + 1
            yield done(t.slice(0, open_from))
            held = t.slice(open_from).combine_chunks().to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def tiled_links(rows: DataFrame, compare: Compare, size: Column, limit: int, rounds: int = 1) -> DataFrame:
    """Edges (a, b) that span every group of linked nodes of a bucket. ``rows``: bucket (long), node (long), what compares them.

    ``size`` is a row's share of a tile; a bucket beyond ``limit`` is cut into parts, ``rounds`` times anew.
    """
    sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.sum(size) / limit).cast("long"), F.lit(1)).alias("parts")).where("n > 1")
    rows = rows.join(sums.drop("n"), "bucket").withColumn("part", F.pmod(F.xxhash64("bucket", "node"), "parts"))

    def run(tiles: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c not in ("bucket", "node", "parts", "part")]
        tiles = tiles.select("bucket", "i", "j", "part", "node", *own)
        dealt = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
        return dealt.mapInArrow(lambda it: _tiles(it, compare), "a long, b long").distinct()

    within = rows
    if rounds > 1:
        again = F.explode(F.sequence(F.lit(0), F.when(F.col("parts") > 1, rounds - 1).otherwise(0)))
        within = rows.withColumn("round", again).withColumn("part", F.pmod(F.xxhash64("bucket", "node", "round"), "parts") + F.col("parts") * F.col("round")).drop("round")
    edges = checkpoint(run(within.withColumns({"i": F.col("part"), "j": F.col("part")})))
    large = rows.where("parts > 1")
    if sums.where("parts > 1").isEmpty():
        return edges
    # Parts of a bucket are compared with each other only where what is linked so far leaves it in pieces.
    labels = large.join(connected_components(edges), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    torn = labels.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    left = large.join(torn, "bucket", "left_semi")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other <> part")
    cross = left.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")
    return checkpoint(edges.unionByName(run(cross)).distinct())


def links(distinct: DataFrame, radius: int = 2, kept: int = 2) -> DataFrame:
    """Edges (a, b) between distinct ``fp`` that span every group linked at ``radius`` or fewer differing bits."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(signed(m))) for t, m in enumerate(block_masks(radius, kept))))
    # A bucket is a hash of (table, key): should two of them meet in one bucket, it is only larger.
    rows = distinct.select(F.explode(keys).alias("bucket"), F.col("fp").alias("node"), "fp")
    return tiled_links(rows, by_bits(radius, ("fp",)), F.lit(1), TILE)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the ``edges`` (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps. Each step is aggregations and joins by node, with a
    reliable checkpoint after each round; nothing but counts comes to the driver.
    """
    edges, before = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(low, "a")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = checkpoint(edges.where("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _components(rows: DataFrame, radius: int, kept: int) -> DataFrame:
    """``rows`` (fp, doc_id, ...) with the root of their component, and the component's smallest id (least).

    Rows of a fingerprint that has many copies meet it in ``SALTS`` parts, so no task gets all of them.
    """
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    roots = connected_components(links(distinct.select("fp"), radius, kept)).withColumnRenamed("node", "fp")
    linked = roots.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = distinct.join(linked.join(least, "root").select("fp", "root", "least"), "fp", "left")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    parts = F.when(F.col("copies") == 1, F.array(part("rep"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least"))
    dealt = named.select("fp", F.coalesce("root", "fp").alias("root"), least.alias("least"), F.explode(parts).alias("part"))
    return rows.withColumn("part", part("doc_id")).join(dealt, ["fp", "part"]).drop("part")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2, kept: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other; very long ones are read in
    ``CHUNK`` shingles at once; repeated rows stay rows. A null id takes part in the links, and component_id is the
    smallest id that isn't null. Other columns of ``docs`` aren't read, so their names don't matter. An empty table
    gives an empty result.
    """
    rows = checkpoint(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width=width, seed=seed))
    return _components(rows, radius, kept).select("doc_id", "fp", F.col("least").alias("component_id"))


def text_key(text: Column) -> Column:
    """A digest that tells texts apart, a null one from an empty one too."""
    return F.md5(F.encode(F.coalesce(F.concat(F.lit("="), text), F.lit("")), "UTF-8"))


def pick(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, how: str = "inner") -> DataFrame:
    """(row, id, raw, ...): the rows of ``docs``, each packed into a struct, that ``keys`` (id, raw, ...) names, or that it doesn't.

    ``raw`` is the text's digest. Up to ``BROADCAST_ROWS`` keys are broadcast, more are joined by a shuffle.
    """
    packed = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"), F.col(f"`{doc_id}`").alias("id"), text_key(F.col(f"`{text}`")).alias("raw"))
    return packed.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, ["id", "raw"], how)


def one_of_each(docs: DataFrame, rows: DataFrame, winners: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each of ``winners`` (id, raw); rows with a null id all stay.

    ``rows`` has (id, raw) of all rows of ``docs`` with an id. What goes is picked out, as that is less than what stays.
    """
    counts = rows.groupBy("id", "raw").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(winners.withColumn("won", F.lit(True)), ["id", "raw"], "left")
    known = checkpoint(known.where("won IS NULL OR n > 1").select("id", "raw", F.col("won").isNotNull().alias("won")))
    kept = pick(docs, known.select("id", "raw"), doc_id, text, "left_anti").select("row")
    repeated = known.where("won").select("id", "raw")
    if not repeated.isEmpty():  # equal ids with equal texts: one row stays
        kept = kept.unionByName(pick(docs, repeated, doc_id, text).groupBy("id", "raw").agg(F.first("row").alias("row")).select("row"))
    return kept.select(*(F.col(f"row.`{n}`").alias(n) for n in docs.columns))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2, kept: int = 2, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, with the smallest id.

    Rows are told apart by id and text: where one id has texts of two components, a row of each stays, and of rows
    equal in both one stays. Rows with a null id all stay. Other columns may have any names.
    """
    data = F.col(f"`{text}`")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(data).alias("raw"), data.alias("text"))
    rows = checkpoint(fingerprints(keyed, keys=("doc_id", "raw"), width=width, seed=seed)).where("doc_id IS NOT NULL")
    named = _components(rows, radius, kept).where("doc_id = least")
    winners = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("id"), "raw")).alias("w")).select("w.id", "w.raw")
    return one_of_each(docs, rows.select(F.col("doc_id").alias("id"), "raw"), winners, doc_id, text)


# Near copies by the similarity of shingle sets.


def agreement(similarity: float) -> float:
    """How likely a bit agrees in two fingerprints, whose sets of one size have a Jaccard similarity.

    >>> round(agreement(0.8), 4)
    0.8485
    """
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def table_plan(texts: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(tables, bits of a table's key): keys grow with the logarithm of the corpus, tables so that ``MISS`` holds.

    >>> table_plan(1000), table_plan(10**7)
    ((36, 12), (96, 18))
    """
    bits = min(40, max(12, math.ceil(math.log2(max(texts, 1) / MEMBERS))))
    return math.ceil(math.log(MISS) / math.log(1 - agreement(similarity) ** bits)), bits


def sift_radius(similarity: float = SIMILARITY) -> int:
    p, n = 1 - agreement(similarity), 64 * SIFT
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


_RNG = np.random.default_rng(8)
_FACTORS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingles(ws: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words make one shingle of all of them."""
    import xxhash

    h, n = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws)), min(width, len(ws))
    out = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _FACTORS[k]
    return np.unique(mixed(out))


def wide_bits(found: np.ndarray, words: int) -> np.ndarray:
    """Bits (0 or 1) of a fingerprint of ``words`` times 64 bits over a set of hashes."""
    own = mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), 255):  # sums of 255 bits fit a byte
        h = mixed(found[at : at + 255, None] ^ own)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (counts * 2 > len(found)).astype(np.uint8)


def sketches(docs: DataFrame, tables: int, bits: int, width: int = WIDTH) -> DataFrame:
    """(id, raw, key, bands, s0, s1) of ``docs`` (id, raw, text); ``key`` tells lower-cased words apart, blank texts have no bands."""
    words = SIFT + -(-tables * bits // 64)
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys, bands, sift = [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                ws = words_of(text)
                keys.append(xxhash.xxh128_digest(b" ".join(ws)))
                found = wide_bits(shingles(ws, width), words)
                sift.append(np.packbits(found[: 64 * SIFT], bitorder="little").view("<i8"))
                bands.append(found[64 * SIFT : 64 * SIFT + tables * bits].reshape(tables, bits) @ powers if ws else powers[:0])
            longs = [pa.array([s[k] for s in sift], pa.int64()) for k in range(SIFT)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *longs], names=["id", "raw", "key", "bands", "s0", "s1"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, raw string, key binary, bands array<bigint>, s0 long, s1 long")


def by_shingles(radius: int, similarity: float, width: int) -> Compare:
    """Compares texts: pairs within the radius by their bits, and alike by their whole sets of shingles."""
    sift = tuple(f"s{k}" for k in range(SIFT))

    def compare(rows: pa.Table, parts: np.ndarray) -> list[tuple[int, int]]:
        sets = [shingles(words_of(t), width) for t in rows["text"].cast(pa.binary()).to_pylist()]
        sizes, label = np.array([len(s) for s in sets]), np.arange(len(sets))
        fps = np.stack([rows[n].to_numpy().view(np.uint64) for n in sift], axis=1)
        cross = rows["i"][0].as_py() != rows["j"][0].as_py()
        planes = planes_of(fps)

        def alike(k: int, of: np.ndarray) -> np.ndarray:
            if not len(of):
                return of
            every = np.concatenate([sets[x] for x in of])
            at = np.minimum(np.searchsorted(sets[k], every), sizes[k] - 1)
            begins = np.concatenate([[0], np.cumsum(sizes[of])[:-1]])
            both = np.add.reduceat((sets[k][at] == every).astype(np.int64), begins)
            return of[both >= similarity * (sizes[k] + sizes[of] - both)]

        for at in range(0, len(sets), QUERIES):
            hits = np.unpackbits(within(fps[at : at + QUERIES], planes, radius).view(np.uint8), axis=1, bitorder="little")
            for k in range(at, min(at + QUERIES, len(sets))):
                near = np.flatnonzero(hits[k - at][:k])
                near = near[(np.minimum(sizes[near], sizes[k]) >= similarity * np.maximum(sizes[near], sizes[k])) & (sizes[near] > 0)]
                if cross:
                    near = near[parts[near] != parts[k]]
                # One of each group first: what that links needs no further look.
                for only_first in (True, False):
                    apart = near[label[near] != label[k]]
                    if only_first:
                        apart = apart[np.unique(label[apart], return_index=True)[1]]
                    roots = np.unique(np.append(label[alike(k, apart)], label[k]))
                    if len(roots) > 1:
                        label[np.isin(label, roots)] = roots[0]
        return [(int(k), int(label[k])) for k in np.flatnonzero(label != np.arange(len(label)))]

    return compare


def _copies(docs: DataFrame, text: str, doc_id: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, raw, key) of ``docs`` with an id, and (key, id, raw, root) of their different word sequences; all checkpointed."""
    data = F.col(f"`{text}`")
    rows = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), text_key(data).alias("raw"), data.alias("text"))
    tables, bits = table_plan(docs.count(), similarity)
    radius = sift_radius(similarity)
    sketched = checkpoint(sketches(rows, tables, bits, width))
    nodes = sketched.groupBy("key").agg(F.min(F.struct("id", "raw", "s0", "s1", "bands")).alias("x")).select("key", "x.*")
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    # Likely copies: equal bits of a table, and bits to sift by within the radius.
    banded = nodes.select("node", "s0", "s1", F.posexplode("bands").alias("table", "band"))
    banded = banded.select((F.col("table").cast("long") * (1 << bits) + F.col("band")).alias("bucket"), "node", "s0", "s1")
    likely = connected_components(tiled_links(banded, by_bits(radius, ("s0", "s1")), F.lit(1), TILE))
    # Whole sets confirm them: the text of each goes to its group.
    named = nodes.select("id", "raw", "node", "s0", "s1").join(likely, "node").withColumnRenamed("root", "bucket")
    texts = checkpoint(pick(docs, named, doc_id, text).select("bucket", "node", "s0", "s1", F.col(f"row.`{text}`").alias("text")).dropDuplicates(["node"]))
    edges = tiled_links(texts, by_shingles(radius, similarity, width), F.octet_length("text") + F.lit(64), GROUP_BYTES, ROUNDS)
    roots = connected_components(edges)
    return sketched.select("id", "raw", "key"), checkpoint(nodes.join(roots, "node", "left").select("key", "id", "raw", F.coalesce("root", "node").alias("root")))


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` with an id; component_id is the smallest id of its copies.

    Copies are texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more, and
    copies of copies. Texts of the same lower-cased words are copies, null and blank ones among them. Nothing is
    linked that the sets don't confirm; a pair of just that similarity is missed with a probability of ``MISS``. An
    empty table gives an empty result.
    """
    rows, nodes = _copies(docs, text, doc_id, width, similarity)
    least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(nodes.select("key", "root").join(least, "root"), "key").select(F.col("id").alias("doc_id"), "component_id")


def deduplicate_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of ``near_copies`` one row, with the smallest id.

    Rows are told apart as ``deduplicate`` tells them; rows with a null id all stay. Other columns may have any names.
    """
    rows, nodes = _copies(docs, text, doc_id, width, similarity)
    winners = nodes.groupBy("root").agg(F.min(F.struct("id", "raw")).alias("w")).select("w.id", "w.raw")
    return one_of_each(docs, rows.select("id", "raw"), winners, doc_id, text)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
