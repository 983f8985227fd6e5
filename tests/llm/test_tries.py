import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import tries

from ..oracle import rows as as_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as tuples, from tuples of whole prefixes."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        front = convs.get(c - c % 5, [])[:h]
        paths[c] = tuple(front + own[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if paths[c] == p)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), sum(q not in children for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        if c % 11 == 10:
            continue
        for t in range(rng.choice((0, 1, 1, 3, 9, 12))):
            rows.append((c, t, rng.choice(("user", "assistant")) if t else "user", "hello" if t == 0 else rng.choice(("yes", "no", "ünd", ""))))
    rows += [(5, None, None, None), (6, 1, "user", "tie"), (6, 1, "user", "tie two"), (7, 0, "user", "hello"), (None, 1, "user", "nobody"), (100, 0, "a", "b" * 200_000), (100, 1, "a:", "b"), (101, 0, "a", ":b")]
    return rows


def run(spark, tmp_path, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.withColumns({c: F.lit(c) for c in ("key", "parent", "depth", "path", "turns", "t", "end", "n")})
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return tries.op13_prefixes(spark, str(tmp_path))


def test_equals_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rows = sample()
    got = run(spark, tmp_path, rows)
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute(rows) and len(found) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    res = con.execute(tries.OP13_SQL)
    assert as_rows(got.columns, found) == as_rows([d[0] for d in res.description], res.fetchall())


def test_small_pieces_and_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 3)
    monkeypatch.setattr(tries, "BUCKET_ROWS", 7)
    monkeypatch.setattr(tries, "MANY_CHILDREN", 4)
    rows = [*sample(), *((200 + 5 * k, 0, "user", "same") for k in range(40)), *((1000 + 5 * k, 0, "user", f"child {k}") for k in range(20))]
    assert sorted((tuple(r) for r in run(spark, tmp_path, rows).collect()), key=str) == brute(rows)


def test_intervals_nest(spark, tmp_path):
    convs = tries.turn_sequences(spark.createDataFrame(sample(), SCHEMA))
    nodes = tries.prefix_trie(convs).collect()
    assert sorted(r.place for r in nodes) == list(range(1, len(nodes) + 1))
    for r in nodes:
        inside = [x for x in nodes if r.place <= x.place <= r.end]
        assert all(x.depth > r.depth for x in inside if x.place > r.place) and sum(x.n_children == 0 for x in inside) == r.n_leaves


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversations(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows).count() == 0


def test_a_long_conversation_takes_linear_time(spark, tmp_path):
    rows = [(5, t, "user", f"turn {t}") for t in range(20_000)]
    got = run(spark, tmp_path, rows, clash=False)
    assert got.count() == 20_001 and got.agg(F.max("depth")).first()[0] == 20_000
