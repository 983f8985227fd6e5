import numpy as np
import pytest

from tallyworks.llm import simhash as S

from .fixtures import documents, frame


def brute_fp(text):
    import xxhash

    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not w:
        return 0
    sh = [" ".encode().join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("radius", [2, 3, 6])
def test_bit_sliced_matches_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 9), replace=False))) for b in base for _ in range(8)], dtype=np.uint64)
    hits = S.within(fps, S.planes_of(fps), radius)
    bits = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    want = np.array([[bin(int(a ^ b)).count("1") <= radius for b in fps] for a in fps])
    assert (bits.astype(bool) == want).all()


def test_every_pair_meets_in_a_table():
    rng = np.random.default_rng(5)
    for radius, kept in ((2, 2), (3, 4)):
        masks = S.block_masks(radius, kept)
        for _ in range(500):
            flips = sum(1 << int(k) for k in rng.choice(64, radius, replace=False))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("tile", [4096, 4])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rows = [*documents(), (None, "two words", "en", "s", 9)]
    got = S.near_duplicates(frame(spark, rows)).toPandas()
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted((-1 if r[0] is None else r[0], f, c) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps, 2), strict=True))
    assert sorted((-1 if i != i else int(i), int(f) % (1 << 64), int(c)) for i, f, c in got.itertuples(index=False)) == want


def test_one_dense_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    df = spark.createDataFrame([((1 << 62) ^ (1 << a) ^ (1 << b),) for a in range(12) for b in range(a)] + [(12345,)], "fp long")
    roots = S.connected_components(S.links(df)).toPandas()
    assert len(roots) == 66 and roots.root.nunique() == 1


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501)], "a long, b long")
    got = S.connected_components(edges).toPandas()
    assert dict(zip(got.node, got.root, strict=True)) == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500}


def test_empty_and_deduplicate(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    rows = documents()
    kept = S.deduplicate(frame(spark, rows))
    comp = dict(zip([r[0] for r in rows], brute_components([r[0] for r in rows], [brute_fp(r[1]) for r in rows], 2), strict=True))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(comp.values()))
    assert kept.columns == frame(spark, rows).columns


def test_small_tiles_as_bit_sliced():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(10)], dtype=np.uint64)
    tile = np.sort(rng.integers(0, 12, len(fps)))
    row, root = S.by_bits(3, ("fp",)).small(pa.table({"fp": fps.view(np.int64)}), tile)
    got = dict(zip(row.tolist(), root.tolist(), strict=True))
    want = {}
    for n in range(12):
        at = np.flatnonzero(tile == n)
        if len(at):
            want |= {int(at[i]): int(at[r]) for i, r in S.forest(fps[at], None, 3)}
    assert got == want and got
