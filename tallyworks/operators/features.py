"""Training features over token offsets, and batches of them; arrays in, arrays out, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import ranked

IGNORED = -100
#: What pads each feature of a batch.
FILL = {"input_ids": None, "attention_mask": 0, "labels": IGNORED, "token_loss_weights": 0.0, "step_positions": 0, "step_targets": 0.0, "step_target_scales": 1.0, "step_mask": False}
TOKEN_FEATURES = ("input_ids", "attention_mask", "labels", "token_loss_weights")
STEP_FEATURES = ("step_positions", "step_targets", "step_target_scales", "step_mask")


def overlaps(offset: Column, span: Column) -> Column:
    """Whether a token that isn't empty shares a character with a span."""
    return (offset["end"] > offset["start"]) & (offset["end"] > span["start"]) & (offset["start"] < span["end"])


def offsets_valid(offsets: Column, tokens: Column) -> Column:
    """One span for each token, none negative, none ending before it starts or starting before the one before it."""
    ordered = F.forall(F.transform(offsets, lambda o, i: (o["start"] >= 0) & (o["end"] >= o["start"]) & ((i == 0) | (o["start"] >= F.coalesce(F.get(offsets, i - 1)["start"], F.lit(0))))), lambda x: x)
    return (F.size(offsets) == F.size(tokens)) & ordered


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: in a lambda, or after Spark has merged projections, it would be worked out for each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _end_before(spans: Column, i: Column) -> Column:
    return F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))


def _steady(spans: Column) -> Column:
    """Whether spans come in order with ends that never fall, and empty ones add nothing."""
    return F.forall(F.transform(spans, lambda s, i: (s["start"] >= F.coalesce(F.get(spans, i - 1)["start"], F.lit(0))) & (s["end"] >= _end_before(spans, i)) & ((s["end"] > s["start"]) | (s["end"] == _end_before(spans, i)))), lambda x: x)


def _mask(spans: Column) -> Column:
    """A byte for each character up to the last end: "1" under any of some steady spans, else "0"."""

    def piece(s: Column, i: Column) -> Column:
        begin = F.greatest(s["start"], _end_before(spans, i))
        return F.concat(F.repeat(F.lit("0"), begin - _end_before(spans, i)), F.repeat(F.lit("1"), s["end"] - begin))

    return F.encode(F.array_join(F.transform(spans, piece), ""), "UTF-8")


def _has(mask: Column, span: Column, what: str) -> Column:
    """Whether a byte of the mask inside a span is ``what``."""
    return F.contains(F.substr(mask, span["start"] + 1, F.greatest(span["end"] - span["start"], F.lit(0))), F.encode(F.lit(what), "UTF-8"))


def _first_past(offsets: Column) -> Column:
    """For each character up to the last end, the number of the first token that reaches past it; offsets are steady."""
    return F.flatten(F.transform(offsets, lambda o, i: F.array_repeat(i, F.when(o["end"] > o["start"], o["end"] - _end_before(offsets, i)).otherwise(0))))


def token_weights(offsets: Column, labels: Column, spans: Column, weight: float) -> Column:
    """0 for ignored labels, ``weight`` for tokens over any span, else 1.

    Steady spans become a mask of the text, so time grows with the text and not with tokens times spans; others are compared one by one.
    """
    if isinstance(weight, bool) or not 0 < weight < float("inf"):
        raise ValueError("the weight must be finite and positive")
    weigh = lambda tokens, hit: F.transform(tokens, lambda o, i: F.when(F.get(labels, i) == IGNORED, 0.0).when(hit(o), float(weight)).otherwise(1.0))
    by_mask = lambda t, s: let(_mask(s), lambda m: weigh(t, lambda o: (o["end"] > o["start"]) & _has(m, o, "1")))
    one_by_one = lambda t, s: weigh(t, lambda o: F.exists(s, lambda x: overlaps(o, x)))
    return let(offsets, lambda t: let(spans, lambda s: F.when(_steady(s), by_mask(t, s)).otherwise(one_by_one(t, s))))


def visible(offsets: Column, span: Column) -> Column:
    """Whether tokens cover a span without a gap."""
    reach = F.aggregate(offsets, span["start"], lambda at, o: F.when((o["end"] > o["start"]) & (o["start"] <= at) & (o["end"] > at), o["end"]).otherwise(at))
    return reach >= span["end"]


def causal_position(offsets: Column, at: Column) -> Column:
    """Number of the last token before the first one that reaches past ``at``; null if there is none."""
    past = F.array_position(F.transform(offsets, lambda o: (o["end"] > o["start"]) & (o["end"] > at)), True)
    return F.when(past > 1, (past - 2).cast("int"))


def context_starts(text: Column, spans: Column) -> Column:
    """Where each annotation's context begins: after its line's start and the annotation before it, past blanks."""

    def all_of(ss: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            between = F.substr(text, _end_before(ss, i) + 1, s["start"] - _end_before(ss, i))
            line = F.substring_index(between, "\n", -1)
            return (s["start"] - F.length(F.regexp_replace(line, r"^(?U)[\s\x1c-\x1f]+", ""))).cast("int")

        return F.transform(ss, one)

    return let(spans, all_of)


def step_features(df: DataFrame, answer: str = "answer", offsets: str = "offsets", steps: str = "steps", answer_start: str | None = None) -> DataFrame:
    """Adds positions, targets, scales and mask of every step; a step that can't be seen, placed or held in a double is masked.

    Offsets count from the start of the tokenized text, in which the answer begins at ``answer_start`` (none: 0).
    """
    shift = F.col(answer_start) if answer_start else F.lit(0)
    spans = F.transform(steps, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("__spans", spans).withColumn("__contexts", context_starts(F.col(answer), F.col("__spans")))
    shifted = lambda x: F.struct((x["start"] + shift).alias("start"), (x["end"] + shift).alias("end"))
    # Where steps stand among the tokens, and which are covered by them: by tables over the text's characters if the tokens are in order, else
    # by going through all tokens for each step.

    def places(tokens: Column) -> Column:
        quick = let(_first_past(tokens), lambda past: F.transform("__contexts", lambda c: F.when(F.get(past, c + shift) > 0, F.get(past, c + shift) - 1)))
        return F.when(_steady(tokens), quick).otherwise(F.transform("__contexts", lambda c: causal_position(tokens, c + shift)))

    def seen(tokens: Column) -> Column:
        quick = let(_mask(tokens), lambda m: F.transform("__spans", lambda x: (F.octet_length(m) >= x["end"] + shift) & ~_has(m, shifted(x), "0")))
        return F.when(_steady(tokens), quick).otherwise(F.transform("__spans", lambda x: visible(tokens, shifted(x))))

    df = df.withColumns({"__places": let(F.col(offsets), places), "__seen": let(F.col(offsets), seen)})
    paired = F.arrays_zip(F.col(steps).alias("step"), F.col("__places").alias("place"), F.col("__seen").alias("seen"))
    return df.withColumns({
        "step_positions": F.transform("__places", lambda p: F.coalesce(p, F.lit(0))),
        "step_targets": F.transform(steps, lambda s: F.coalesce(s["target_value"], F.lit(0.0))),
        "step_target_scales": F.transform(steps, lambda s: F.coalesce(s["target_scale"], F.lit(1.0))),
        "step_mask": F.transform(paired, lambda x: x["step"]["valid"] & x["step"]["target_value"].isNotNull() & x["place"].isNotNull() & x["seen"]),
        "postfix_program": F.to_json(F.struct(F.transform(steps, lambda s: F.struct(s["index"].alias("index"), s["valid"].alias("valid"), s["actions"].alias("actions"))).alias("steps"))),
    }).drop("__spans", "__contexts", "__places", "__seen")


def build(df: DataFrame, requested: list[str], weight: float = 2.0, answer_start: str | None = None) -> DataFrame:
    """Only the requested features, of rows with offsets, labels, answer and steps."""
    sound = offsets_valid(F.col("offsets"), F.col("labels"))
    known = {"token_loss_weights", *STEP_FEATURES, "postfix_program"}
    if unknown := sorted(set(requested) - known):
        raise ValueError(f"unknown features: {unknown}")
    if not requested:
        return df
    df = df.withColumn("offsets", F.when(sound, F.col("offsets")).otherwise(F.raise_error(F.lit("offsets must be one ordered span for each token")).cast(df.schema["offsets"].dataType)))
    out = step_features(df, answer_start=answer_start) if set(requested) - {"token_loss_weights"} else df
    if "token_loss_weights" in requested:
        shift = F.col(answer_start) if answer_start else F.lit(0)
        spans = F.transform("steps", lambda s: F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end")))
        out = out.withColumn("token_loss_weights", token_weights(F.col("offsets"), F.col("labels"), spans, weight))
    return out.select(*df.columns, *requested)


def completion_labels(prompt_ids: Column, ids: Column) -> Column:
    """Labels that ignore the prompt."""
    n = F.size(prompt_ids)
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))


def character_tokens(df: DataFrame, text: str) -> DataFrame:
    """A tokenizer of single characters: input_ids, attention_mask and offsets (as tests and fixtures use it)."""
    ids = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("input_ids", ids)
    return df.withColumns({"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "offsets": F.transform("input_ids", lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))})


def number_batches(df: DataFrame, size: int, order: str, drop_incomplete: bool, by: str | None = None) -> DataFrame:
    """Adds batch: rows of each ``by`` group in order, ``size`` to a batch; optionally without the last short one."""
    keys = [by] if by else []
    df = ranked(df, order, *keys).withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")
    if not drop_incomplete:
        return df
    full = F.count(F.lit(1)).over(Window.partitionBy(*keys, "batch"))
    return df.withColumn("__n", full).where(F.col("__n") == size).drop("__n")


def collate(df: DataFrame, pad_id: int, multiple: int = 8, by: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Every feature padded on the right to its batch's longest: tokens to a multiple, steps by themselves."""
    group = Window.partitionBy(*by)
    for names, round_to in ((TOKEN_FEATURES, multiple), (STEP_FEATURES, 1)):
        for name in (n for n in names if n in df.columns):
            longest = F.max(F.size(name)).over(group)
            width = (F.ceil(longest / round_to) * round_to).cast("int")
            df = df.withColumn("__width", width)
            kind = df.schema[name].dataType.elementType
            fill = F.lit(pad_id if FILL[name] is None else FILL[name]).cast(kind)
            df = df.withColumn(name, F.concat(F.col(name), F.array_repeat(fill, F.col("__width") - F.size(name)))).drop("__width")
    return df
