"""Row-local exact work, fused into one Arrow pass a row; everything after it is DataFrame work on arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

CANDIDATES = "array<struct<kind:string,ref:int>>"
NUMBERS = "array<struct<text:string,start:int,end:int,value:string>>"
NODES = f"array<struct<kind:string,op:string,value:string,ref:int,args:array<int>,candidates:{CANDIDATES}>>"
OPERANDS = f"array<struct<kind:string,ref:int,value:string,candidates:{CANDIDATES}>>"
ACTIONS = f"array<struct<operator:string,supervised:string,mask:array<boolean>,operands:{OPERANDS}>>"
STEPS = (
    "array<struct<index:int,raw:string,start:int,end:int,expression:string,expression_start:int,expression_end:int,claimed_text:string,claimed_start:int,claimed_end:int,"
    "claimed:string,target:string,target_value:double,shown:string,valid:boolean,error:string,is_final:boolean,root:string,target_scale:double,dependencies:array<int>,unresolved:int,"
    f"nodes:{NODES},actions:{ACTIONS},graph_result:string,graph_error:string,program_result:string,program_error:string>>"
)
ISSUES = "array<struct<code:string,step:int>>"
FORMULAS = "array<struct<raw:string,expression:string,claimed:string,value:string,parsed:boolean,executed:boolean,correct:boolean,error:string>>"


def with_rows(df: DataFrame, inputs: list[str], outputs: str, one: Callable[..., dict]) -> DataFrame:
    """``df`` and the columns ``outputs`` (a schema), which ``one`` makes of the ``inputs`` of each row.

    Own columns of the outputs' names are replaced. One Python pass over Arrow batches, no shuffle. ``one`` depends on nothing but its
    inputs: a task works equal rows out once, as far as its memory goes. Texts are their own keys there; other inputs are told apart by
    their SHA-256, so that only new ones are read as Python values.
    """
    added = df.sparkSession.createDataFrame([], outputs).schema
    base = df.drop(*added.names)
    names, types = base.columns, dict(base.dtypes)
    places = [names.index(c) for c in inputs]
    schema = base.limit(0).schema
    for f in added:
        schema = schema.add(f)
    kind = pa.struct(list(to_arrow_schema(added)))
    texts = all(types[c] == "string" for c in inputs)
    width = len(names)
    if not texts:
        base = base.select("*", F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(inputs)))), 256).alias("__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.memo import Memory

        memory = Memory(one, kind)
        for b in batches:
            columns = [b.column(p) for p in places]
            keys = list(zip(*(c.to_pylist() for c in (columns if texts else [b.column(width)])), strict=True))
            rows = lambda at, columns=columns, keys=keys: [keys[k] for k in at] if texts else list(zip(*(c.take(pa.array(at, pa.int64())).to_pylist() for c in columns), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *memory(keys, rows).flatten()], names=schema.names)

    return base.mapInArrow(run, schema)


def counted(df: DataFrame, *texts: str) -> DataFrame:
    """Each different row of ``texts`` once, with ``times``: how often it is there. Figures that add up need no more of equal rows."""
    return df.groupBy(*texts).agg(F.count(F.lit(1)).alias("times"))


def analyze(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Adds numbers, steps and issues: spans, trees, provenance, programs and both executions of every row."""
    from ..functions.calculation import record

    return with_rows(df, [question, answer], f"numbers {NUMBERS}, steps {STEPS}, issues {ISSUES}", record)


def check_programs(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Replaces issues: how the programs that the columns numbers and steps hold differ from the graphs of question and answer.

    The columns are those of ``analyze``, or come from elsewhere, such as a stored or edited set of programs.
    """
    from ..functions import calculation

    def one(q: str | None, a: str | None, numbers: list[dict], steps: list[dict]) -> dict:
        program = calculation.program_from([n["value"] for n in numbers], steps)
        return {"issues": [{"code": c, "step": s} for c, s in calculation.structure_issues(calculation.graph_of(q or "", a or ""), program)]}

    return with_rows(df, [question, answer, "numbers", "steps"], f"issues {ISSUES}", one)


def audited(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """``analyze`` of answers without trivial identities; example_hash identifies the row as it came."""
    from ..functions import calculation, canonical

    def one(q: str | None, a: str | None) -> dict:
        clean = canonical.drop_identities(a or "")
        return calculation.record(q, clean) | {"preprocessed": clean}

    rows = with_rows(df, [question, answer], f"preprocessed string, numbers {NUMBERS}, steps {STEPS}, issues {ISSUES}", one)
    return rows.withColumn("example_hash", example_key(F.col(question), F.col(answer)))


def example_key(question, answer):
    """SHA-256 of question, NUL, answer."""
    return F.sha2(F.concat(F.coalesce(question, F.lit("")), F.lit("\0"), F.coalesce(answer, F.lit(""))), 256)


def with_formulas(df: DataFrame, text: str) -> DataFrame:
    """Adds formulas: the verdict on every annotation of a text."""
    from ..functions.grammar import formulas

    def one(t: str | None) -> dict:
        return {"formulas": [{"raw": f.raw, "expression": f.expression, "claimed": f.claimed, "value": f.shown, "parsed": f.parsed, "executed": f.executed, "correct": f.correct, "error": f.error} for f in formulas(t)]}

    return with_rows(df, [text], f"formulas {FORMULAS}", one)


def with_canonical(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds without_identities and canonical, the training form of an answer: Python finds the spans to cut, native functions mend what is left."""
    from ..functions import canonical, scan

    def one(a: str | None) -> dict:
        clean = canonical.drop_identities(a or "")
        edges = [0, *(x for cut in canonical.cuts(clean) for x in cut), len(clean)]
        return {"without_identities": clean, "canonical": "".join(clean[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))}

    rows = with_rows(df, [answer], "without_identities string, canonical string", one)
    return rows.withColumn("canonical", scan.mend_blanks(F.col("canonical")))


def training_examples(df: DataFrame, system: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """prompt (system, user) and completion (assistant) of every row; an empty question or answer is an error."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    blanks = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
    rows = with_canonical(df, answer).withColumns({"__q": F.regexp_replace(F.coalesce(question, F.lit("")), blanks, ""), "__a": F.regexp_replace("canonical", blanks, "")})
    checked = lambda c, what: F.when(F.col(c) == "", F.raise_error(F.lit(f"the {what} must not be empty"))).otherwise(F.col(c))
    return rows.select(
        *df.columns,
        F.array(turn("system", F.lit(system)), turn("user", checked("__q", "question"))).alias("prompt"),
        F.array(turn("assistant", checked("__a", "answer"))).alias("completion"),
    )
