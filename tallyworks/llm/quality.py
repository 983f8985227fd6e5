"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a permille figure of a document (higher is worse) and a grid of cutoffs. The labelled documents of a
stratum (a language) that pass the base rules are split by a digest of their id. One half proposes rule sets, from
careful to bold: for each price of a good document, the cutoffs that are worth most. The other half, the holdout,
tests them in that order as a whole: an exact binomial test must refuse that a set rejects more than a set share of
good documents, and the first that fails ends the sequence (fixed-sequence testing, so the order costs no power).
Levels are corrected for the strata (Bonferroni). The boldest set before the end is used; a stratum without enough
labels certifies none and its documents only face the base rules, which are outside the guarantee.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, words

#: Cutoffs in permille; a document fails a rule if its figure is over the cutoff.
GRID = (0, 2, 5, 10, 20, 50, 100, 200, 300, 500, 800)
RULES = ("symbols", "duplicate_lines", "repeated_words", "exclamations", "capitals")
#: Strata whose thresholds are broadcast at most (some 300 bytes each); more are joined by a shuffle.
BROADCAST_STRATA = 20_000
#: Words of a window for repeats within a text.
WINDOW = 8


@dataclass(frozen=True)
class Risk:
    """At most ``share`` of a stratum's good documents are rejected, with probability 1 - ``delta`` for all strata at once.

    ``prices``: how many bad documents a good one is worth, in the order in which the rule sets are tested.
    """

    share: float = 0.05
    delta: float = 0.05
    prices: tuple[float, ...] = (1000.0, 100.0, 30.0, 10.0)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base figures and the rules' permille figures, all row by row.

    Null and blank texts have no words, no lines with words, and zero figures; long texts are worked on whole.
    Repeated rows and ids are rows like any other, and an empty table gives an empty result. Columns of ``docs``
    that have a figure's name are replaced; all others may have any names.
    """
    p = fresh(docs)
    data, ws, n = F.col(f"{p}text"), F.col(f"{p}words"), F.size(f"{p}words")
    df = docs.withColumn(f"{p}text", F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(f"{p}words", words(data))
    width = F.lit(WINDOW)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, width)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({f"{p}hashes": hashes, f"{p}lines": F.filter(F.split(data, "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))})
    # Places of windows found twice or more: only texts that have any are sorted.
    placed, twice, found, lines = (F.col(f"{p}{c}") for c in ("placed", "twice", "hashes", "lines"))
    sorted_places = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{p}placed", F.when(F.size(F.array_distinct(found)) < F.size(found), sorted_places))
    again = F.filter(
        F.transform(placed, lambda x, k: F.when((F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn(f"{p}twice", F.when(placed.isNotNull(), F.array_sort(again)))
    covered = F.aggregate(F.transform(twice, lambda i, k: F.least(width, F.coalesce(F.get(twice, k + 1) - i, width))), F.lit(0), lambda a, x: a + x)
    count_of = lambda pattern: (F.length(data) - F.length(F.regexp_replace(data, pattern, ""))).cast("long")
    df = df.withColumns({
        f"{p}n_words": n.cast("long"),
        f"{p}word_chars": F.length(F.array_join(ws, "")).cast("long"),
        f"{p}n_symbols": count_of(r"[#*$%&|<>]+"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_marks": count_of("!+"),
        f"{p}n_capitals": count_of(r"\p{Lu}+"),
    })
    own = lambda c: F.col(f"{p}{c}")
    permille = lambda part, whole: F.coalesce(F.try_divide(own(part) * 1000, own(whole)), F.lit(0.0)).cast("double")
    figures = {
        "symbols": permille("n_symbols", "word_chars"),
        "duplicate_lines": permille("n_dup_lines", "n_lines"),
        "repeated_words": permille("n_repeat_words", "n_words"),
        "exclamations": permille("n_marks", "word_chars"),
        "capitals": permille("n_capitals", "word_chars"),
    }
    failed = (own("n_words") < 20) | (100 * own("n_repeat_words") > 30 * own("n_words"))
    base = [own(n).alias(n) for n in FIGURES if n.startswith(("n_", "word"))]
    row = F.struct(*base, failed.alias("base_failed"), *(figures[r].alias(f"rule_{r}") for r in RULES))
    # As a generator's output the figures are worked out once: a filter on them is not pushed into their making.
    return df.select(*(F.col(f"`{n}`") for n in docs.columns if n not in FIGURES), F.inline(F.array(row)))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"rule_{r}" for r in RULES))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in log space; 1 where k >= n * p (no test can refuse there)."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * F.lit(math.log(1 - p))).alias("term"), F.exp(n * F.lit(math.log(1 - p))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(terms, start, step, lambda s: s["sum"])))


def _over(cutoffs: Column) -> Column:
    """Whether a row's figures are over any of the ``cutoffs``, a map from rule to cutoff."""
    over = [F.coalesce(F.col(f"rule_{r}") > F.try_element_at(cutoffs, F.lit(r)), F.lit(False)) for r in RULES]
    return reduce(Column.__or__, over)


def proposals(rows: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, step, cutoffs): for each stratum and price the cutoffs that are worth most, as a map from rule to cutoff."""
    level = lambda r: F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: F.col(f"rule_{r}") > c))
    long = rows.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES))).alias("x"))
    counts = long.groupBy("stratum", "x.rule", "x.level").agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad"))
    # A figure of level v is over the first v cutoffs: cutoff number c rejects the levels above c.
    grid = F.array(*(F.struct(F.lit(k).alias("number"), F.lit(float(c)).alias("cutoff")) for k, c in enumerate(GRID)))
    over = counts.select("stratum", "rule", "level", "good", "bad", F.explode(grid).alias("g")).where("level > g.number")
    lost = over.groupBy("stratum", "rule", "g.cutoff").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    prices = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(p).alias("price")) for k, p in enumerate(risk.prices)))
    worth = lost.select("stratum", "rule", "cutoff", F.explode(prices).alias("p"), "good", "bad").select("stratum", "rule", "p.step", "cutoff", (F.col("bad") - F.col("p.price") * F.col("good")).alias("worth"))
    best = worth.where("worth > 0").groupBy("stratum", "step", "rule").agg(F.max(F.struct("worth", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum", "step").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def thresholds(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, cutoffs): for each stratum the boldest certified rule set, a map from rule to cutoff; strata without one are left out.

    ``labelled``: stratum, quality (1 good, 0 bad; others are left out), holdout (boolean) and the rules' figures.
    """
    rows = labelled.where(F.col("quality").isin(0, 1)).where(F.col("stratum").isNotNull())
    steps = proposals(rows.where("NOT holdout"), risk)
    # All rule sets of a stratum go to its holdout rows together: a row meets `prices` sets at most.
    sets = steps.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("step", "cutoffs")), lambda a, b: a["step"] - b["step"]).alias("sets"))
    good = rows.where("holdout AND quality = 1").join(_small(sets), "stratum")
    tested = good.select("stratum", F.explode("sets").alias("s"), *(f"rule_{r}" for r in RULES))
    tested = tested.select("stratum", "s.step", _over(F.col("s.cutoffs")).alias("rejected"))
    tested = tested.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("k"))
    strata = rows.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))  # one row
    tested = tested.crossJoin(F.broadcast(strata)).withColumn("passed", binomial_tail(F.col("n"), F.col("k"), risk.share) <= F.lit(risk.delta) / F.col("strata"))
    ends = tested.groupBy("stratum").agg(F.min(F.when(~F.col("passed"), F.col("step"))).alias("fails"))
    certified = tested.join(ends, "stratum").where("passed AND (fails IS NULL OR step < fails)").groupBy("stratum").agg(F.max("step").alias("step"))
    return certified.join(steps, ["stratum", "step"]).select("stratum", "cutoffs")


def _small(table: DataFrame) -> DataFrame:
    """A table of one row a stratum, broadcast if it has ``BROADCAST_STRATA`` rows at most."""
    table = checkpoint(table)
    return F.broadcast(table) if table.count() <= BROADCAST_STRATA else table


def _named(stratum: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))


def fit(figures: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", risk: Risk = Risk()) -> DataFrame:
    """Thresholds from ``figures`` (id, stratum, features) and ``labels`` (doc_id, quality), checkpointed: a row a stratum.

    A document with several labels counts as bad if one says so; null ids and labels are left out, and so are
    documents that fail the base rules. Every stratum is tested by itself, a null one as one of them.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    passed = figures.where("NOT base_failed").select(F.col(f"`{doc_id}`").alias("doc_id"), _named(F.col(f"`{stratum}`")).alias("stratum"), *(f"rule_{r}" for r in RULES))
    holdout = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return checkpoint(thresholds(passed.join(marks, "doc_id").withColumn("holdout", holdout), risk))


def judge(figures: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """``figures`` with ``kept``: base rules passed and no certified cutoff of the stratum exceeded."""
    p = fresh(figures)
    named = figures.withColumn(f"{p}stratum", _named(F.col(f"`{stratum}`")))
    own = _small(limits.select(F.col("stratum").alias(f"{p}stratum"), F.col("cutoffs").alias(f"{p}cutoffs")))
    df = named.join(own, f"{p}stratum", "left")
    return df.withColumn("kept", ~F.col("base_failed") & ~_over(F.col(f"{p}cutoffs"))).drop(f"{p}stratum", f"{p}cutoffs")


def filter_documents(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names.

    Figures are worked out in two passes over the texts: one for the thresholds, from which only narrow rows go to
    the labels, and one for the verdicts. No text is shuffled, however many labels there are.
    """
    p = fresh(docs)
    aside = {n: f"{p}own_{n}" for n in docs.columns if n in FIGURES or n == "kept"}
    renamed = docs.withColumnsRenamed(aside)
    text, stratum, doc_id = (aside.get(n, n) for n in (text, stratum, doc_id))
    read = renamed.select(*(F.col(f"`{n}`") for n in dict.fromkeys((doc_id, stratum, text))))
    narrow = features(read, text).where("NOT base_failed").select(F.col(f"`{doc_id}`"), F.col(f"`{stratum}`"), "base_failed", *(f"rule_{r}" for r in RULES))
    narrow = checkpoint(narrow)
    kept = judge(features(renamed, text), fit(narrow, labels, stratum, doc_id), stratum).where("kept")
    return kept.select(*(F.col(f"`{aside.get(n, n)}`").alias(n) for n in docs.columns))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    figures = checkpoint(features(docs).select("doc_id", "lang", *FIGURES))
    judged = judge(figures, fit(figures, read_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
