import re

from pyspark.sql import functions as F

from tallyworks.llm import chat as C

T = "array<struct<role:string,text:string>>"
A, B, X = ("user", "hi"), ("assistant", "yo 𝒳"), ("assistant", "no")


def render(turns):
    return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_prefix_masks_and_edges(spark):
    rows = [(1, [A, B, A, X], [A, B, A, B, A]), (2, [A], [A]), (3, [], [A]), (4, None, [X]), (5, [(None, None)], [("user", None)]), (6, [A, B], [A]), (7, [B] * 300 + [X], [B] * 300)]
    df = spark.createDataFrame(rows, f"id long, chosen {T}, rejected {T}").withColumn("prompt", F.lit("own"))
    got = {r.id: r for r in C.format_preferences(df).collect()}
    for i, a, b in rows:
        a, b, r = a or [], b or [], got[i]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if (x[0] or "unknown", x[1] or "") != (y[0] or "unknown", y[1] or "")), min(len(a), len(b)))
        assert (r.n_prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion) == (n, render(a[:n]), render(a[n:]), render(b[n:])), i
        for done, m, turns in ((r.chosen_completion, r.chosen_mask, a[n:]), (r.rejected_completion, r.rejected_mask, b[n:])):
            assert [done[s.start : s.end] for s in m] == [(t or "") + "<|end|>\n" for role, t in turns if role == "assistant"]


def branch(c, turns):
    own = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
    if not own:
        return turns
    which = c % len(own)
    at = own[which]
    said = turns[own[-1]][1] if at < own[-1] else turns[at - 1][1] if at else ""
    return [*turns[:at], ("assistant", said), *(turns[at + 1 :] if which % 2 == 0 else [])]


def checked(convs, got):
    """Depths at which branches part, and how many turns the completions have."""
    depths, lengths = set(), set()
    assert set(got) == set(convs)
    for c, r in got.items():
        a, b = convs[c], branch(c, convs[c])
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.n_prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion) == (n, render(a[:n]), render(a[n:]), render(b[n:])), c
        for done, m, turns in ((r.chosen_completion, r.chosen_mask, a[n:]), (r.rejected_completion, r.rejected_mask, b[n:])):
            spans = [tuple(map(int, s.split(":"))) for s in m.split(",") if s]
            assert [done[x:y] for x, y in spans] == [t + "<|end|>\n" for role, t in turns if role == "assistant"]
        depths.add(n)
        lengths.add((len(a) - n, len(b) - n))
    return depths, lengths


def test_query_rows(spark, sf_dir):
    from tallyworks.llm.common import read_table

    convs = {}
    for r in sorted(read_table(spark, sf_dir, "conversations").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    depths, lengths = checked(convs, {r.conv_id: r for r in C.op1_preferences(spark, sf_dir).collect()})
    assert len(depths) > 3 and len(lengths) > 4


def test_branches_of_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (2, 3, "tool", None), (3, 0, "assistant", "first"), (4, 0, None, None), (None, 0, "assistant", "x")]
    rows += [(5, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(12)] + [(-7, k, ("user", "assistant")[k % 2], "same") for k in range(6)] + [(2, 1, "assistant", "yes")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("turns", "own", "at", "which", "__a")})
    convs = {}
    for c, _, role, text in sorted((r[0], r[1], r[2] or "unknown", r[3] or "") for r in rows if r[0] is not None):
        convs.setdefault(c, []).append((role, text))
    df = C._written(C.format_preferences(C.branch_pairs(turns)))
    checked(convs, {r.conv_id: r for r in df.collect()})
    assert not re.search("Python|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert C.format_preferences(C.branch_pairs(turns.limit(0))).count() == 0


def test_names_are_kept(spark):
    df = spark.createDataFrame([([A, B], [A, X], "one", "two", "three")], f"chosen {T}, rejected {T}, __a string, __b string, `x.y` string")
    r = C.format_preferences(df).first()
    assert (r["__a"], r["__b"], r["x.y"], r.n_prompt_turns) == ("one", "two", "three", 1)


def test_long_conversations_take_linear_time(spark):
    from time import perf_counter

    def seconds(n):
        begin = perf_counter()
        turns = spark.range(n).selectExpr("0 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
        r = C.format_preferences(C.branch_pairs(turns)).selectExpr("n_prompt_turns AS n", "size(chosen_mask) AS m", "size(rejected_mask) AS k").first()
        assert (r.n, r.m, r.k) == (1, n // 2, n // 2)
        return perf_counter() - begin

    seconds(100)
    assert seconds(20000) < 10 + 4 * seconds(10000)
