"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a projection of DataFrame functions: no shuffle, no Python on the executors. A kind's spans
come from the matches and the gaps between them (their code points add up to the offsets). The patterns
are written so that matching takes time in proportion to the text: runs are possessive and can only begin
where the run begins (or where the last match ended), which matches the same spans as the plain forms. Long
texts are read in chunks of ``CHUNK`` code points where a span needs its surroundings, and running figures over
spans are worked out in blocks, so time stays in proportion to text and spans there too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Code points before and after a span that are searched for context words.
BEFORE, AFTER = 48, 24
#: Code points of a chunk; more than a span's surroundings.
CHUNK = 1024
#: A span of a kind that isn't a base kind counts from this score on.
THRESHOLD = 0.6
#: What a context word adds to a score.
BOOST = 0.3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (letters and digits, no blanks) passes the mod-97 check."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _small_parts(match: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _card(match: Column) -> Column:
    d = _digits(match)
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)


def _iban(match: Column) -> Column:
    code = F.replace(match, F.lit(" "), F.lit(""))
    return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: what proposes it, what confirms it, its score and its context words."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    base: bool = False


#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, r"mail|contact|write to", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts, 0.7, r"\bip\b|address|host|server", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.8, r"card|visa|credit|payment|karte|tarjeta|carte", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.7, r"phone|\btel\b|call|mobile|fax|telefon", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban, 0.8, r"iban|bank|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.4, r"\bssn\b|social security"),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])", lambda m: m.rlike("[A-Fa-f]") & m.rlike("[0-9]"), 0.4, r"token|secret|passw|api|\bkey\b"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def running(values: Column, plus: Callable[[Column, Column], Column], zero: Column, block: int = 128, depth: int = 2) -> Column:
    """``plus`` over an array of longs up to and with each place, in ``depth`` levels of blocks."""

    def fold(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, x: F.struct(plus(s["at"], x).alias("at"), F.concat(s["out"], F.array(plus(s["at"], x))).alias("out"))
        return F.aggregate(part, begin, step, lambda s: s["out"])

    if not depth:
        return fold(values, zero)
    count = F.floor((F.size(values) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(values, k * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda part: F.aggregate(part, zero, plus))
    begins = F.slice(F.concat(F.array(zero), running(totals, plus, zero, block, depth - 1)), F.lit(1), count + 1)
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.zip_with(blocks, begins, fold)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, x: a + x, F.lit(0).cast("long"))


def chunks_of(text: Column) -> Column:
    """A text cut after every ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in chunks."""
    start, end = start.cast("int"), F.greatest(start, end).cast("int")
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head, tail = F.coalesce(F.get(chunks, first), F.lit("")), F.coalesce(F.get(chunks, last), F.lit(""))
    inside = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    apart = F.concat(F.substr(head, start - first * CHUNK + 1), inside, F.substr(tail, F.lit(1), end - last * CHUNK))
    return F.when(first == last, F.substr(head, start - first * CHUNK + 1, end - start)).otherwise(apart)


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` as a generator's output, so they are worked out once a row wherever they are used after."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, score, base), by kind as listed, then start.

    Offsets are code points, end exclusive. A null text counts as empty, repeated rows and ids are rows like any
    other, and an empty table gives an empty result. Matches of a kind are leftmost and don't overlap; a match that
    its checksum refuses is dropped, and nothing inside it is tried again. Kinds that aren't base kinds must reach
    ``THRESHOLD``. Columns of ``docs`` other than ``out`` are kept as they are, whatever their names.
    """
    names, p = docs.columns, fresh(docs)
    data, chunks = F.col(f"{p}text"), F.col(f"{p}chunks")
    df = docs.withColumn(f"{p}text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = _settled(df, {f"{p}m_{k.name}": F.regexp_extract_all(data, F.lit(k.pattern), F.lit(0)) for k in kinds})
    any_match = reduce(Column.__or__, (F.size(f"{p}m_{k.name}") > 0 for k in kinds))
    gaps = {f"{p}g_{k.name}": F.when(F.size(f"{p}m_{k.name}") > 0, F.split(data, k.pattern, -1)) for k in kinds}
    df = _settled(df, gaps | {f"{p}chunks": F.when(any_match, chunks_of(data))})

    def ends(k: Kind) -> Column:
        own = F.col(f"{p}g_{k.name}")
        widths = F.transform(f"{p}m_{k.name}", lambda m, i: (F.length(m) + F.length(F.get(own, i))).cast("long"))
        return F.when(F.size(f"{p}m_{k.name}") > 0, running_sum(widths))

    df = _settled(df, {f"{p}e_{k.name}": ends(k) for k in kinds})

    def spans(k: Kind) -> Column:
        m, e = (F.col(f"{p}{c}_{k.name}") for c in "me")

        def place(x: Column, i: Column) -> Column:
            return F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), k.confirm(x).alias("ok"))

        def one(s: Column) -> Column:
            start, end = s["start"], s["end"]
            near = F.concat_ws("\n", between(chunks, F.greatest(start - BEFORE, F.lit(0)), start), between(chunks, end, end + AFTER))
            score = F.round(F.lit(k.score) + F.when(near.rlike(f"(?i)(?:{k.context})"), BOOST).otherwise(0.0), 2)
            return F.struct(
                F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                F.least(F.lit(1.0), score).alias("score"), F.lit(k.base).alias("base"),
            )

        confirmed = F.transform(F.filter(F.transform(m, place), lambda s: s["ok"]), one)
        kept = F.filter(confirmed, lambda s: s["base"] | (s["score"] >= THRESHOLD))
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")
        return F.when(F.size(m) > 0, kept).otherwise(none)

    found = F.concat(*(spans(k) for k in kinds))
    return df.select(*(F.col(f"`{n}`") for n in names if n != out), found.alias(out))


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    p = fresh(docs)
    df = find(docs, text, kinds, out=f"{p}pii")
    ordered, reach, chunks = F.col(f"{p}ordered"), F.col(f"{p}reach"), F.col(f"{p}pieces")
    by_start = F.array_sort(F.transform(f"{p}pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = _settled(df, {f"{p}ordered": by_start})
    ends = running(F.transform(ordered, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
    df = _settled(df, {f"{p}reach": ends, f"{p}pieces": F.when(F.size(ordered) > 0, chunks_of(F.col(f"`{text}`")))})

    # A span that begins where all spans before it have ended brings the text since then and its kind.
    def piece(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
        return F.when(s["start"] >= before, F.concat(between(chunks, before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    done = F.try_element_at(reach, F.lit(-1))
    tail = between(chunks, done, F.length(F.col(f"`{text}`")).cast("long"))
    clean = F.when(F.size(ordered) > 0, F.concat(F.array_join(F.transform(ordered, piece), ""), tail)).otherwise(F.col(f"`{text}`"))
    return df.select(*((clean.alias(n) if n == text else F.col(f"`{n}`")) for n in docs.columns))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    df = find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("pii", lambda s: s["kind"])
    return df.select(
        "doc_id",
        *((F.size(kinds) - F.size(F.array_remove(kinds, name))).cast("long").alias(f"n_{name}") for name in BASE),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
