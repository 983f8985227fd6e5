"""Small document tables with the awkward cases, for tests against brute force."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["the", "Of", "ünd", "ciónes", "a", "x1", "don't", "THE", "né"] + [f"w{k}" for k in range(40)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "İstanbul ΑΣ ΑΣ. 𝒳  nb\u0085sp"), (7, "word " * 6000), (8, "x" * 9000)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(15, 80))) for _ in range(n // 3)]
    for k in range(n):
        t = base[k % len(base)]
        if rng.random() < 0.4:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if rng.random() < 0.2:
            t = base[rng.randrange(len(base))] + "\n" + t + "\r\n\f" + base[0]
        rows.append((100 + k, t))
    rows += [(300, base[0]), (301, base[0]), (302, "one"), (303, None)]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in rows]


def frame(spark, rows, clash=True):
    """As a table; ``clash`` adds columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.withColumns({c: F.lit(c) for c in ("fp", "key", "a", "b", "n", "bucket", "shard", "component_id", "words", "spans", "kept")})
    return df
