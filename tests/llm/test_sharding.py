import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyworks.llm.sharding import BUCKETS, interleave, start

from .fixtures import documents, frame


def test_rows_law_mixture_and_sizes(spark):
    rows = documents()
    got = interleave(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    counts = got.shard.value_counts()
    assert set(got.shard) == set(range(8)) and counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r.size == r["size"] for r in []) or all(got["size"].iloc[k] == len(text[i]) + 1 and got.text_crc32.iloc[k] == zlib.crc32(text[i]) for k, i in enumerate(got.doc_id))
    for s, n in Counter(r[3] for r in rows).items():
        per = got[got.source == s].shard.value_counts() if s else got[got.source.isna()].shard.value_counts()
        assert all(abs(per.get(k, 0) - n / 8) <= 2 for k in range(8))


def test_same_for_any_partitioning_and_seeded(spark):
    df = frame(spark, documents())
    a, b = (interleave(d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (df.repartition(1), df.repartition(7)))
    assert a.equals(b)
    assert not a.equals(interleave(df, seed=7).toPandas().sort_values("doc_id").reset_index(drop=True))


@pytest.mark.parametrize("n", [0, 3])
def test_few_rows(spark, n):
    got = interleave(frame(spark, documents()[:n])).toPandas()
    assert len(got) == n and (got.slot == 0).all()


def test_repeated_rows(spark):
    rows = [(5, "same", "en", "s", 4)] * 20
    got = interleave(frame(spark, rows)).toPandas()
    assert sorted(got.shard.value_counts()) == [2, 2, 2, 2, 3, 3, 3, 3]


def brute(rows, shards=8, seed=42):
    """(doc_id, size, shard, slot) by sorting everything."""
    strata = defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        data = (text or "").encode()
        size, crc = len(data) + 1, zlib.crc32(data)
        strata["" if source is None else f"={source}"].append((hashlib.md5(f"{seed}:{doc_id}:{crc}:{size}".encode()).hexdigest(), doc_id, size, crc))
    line = []
    for name, members in strata.items():
        u = (int(hashlib.md5(name.encode()).hexdigest()[:8], 16) + 0.5) / float(1 << 32)
        line += [((k + u) / len(members), name, *m) for k, m in enumerate(sorted(members))]
    out, slots = [], Counter()
    for at, (_, _, _, doc_id, size, _) in enumerate(sorted(line)):
        shard = at * shards // len(line)
        out.append((doc_id, size, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sorting_everything(spark, seed):
    rows = documents(seed, 200)
    assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in interleave(frame(spark, rows)).collect()) == brute(rows)


def test_plan_has_no_python(spark):
    plan = interleave(frame(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_small_sources_are_spread_over_all_buckets(spark):
    """Of 100,000 sources of one row each no bucket, which is a task's work, gets more than a few."""
    names = spark.range(100_000).select(F.floor(start(F.concat(F.lit("=site-"), F.col("id").cast("string"))) * BUCKETS).alias("b"))
    assert names.groupBy("b").count().agg(F.max("count")).first()[0] <= 30
