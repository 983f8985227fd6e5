"""Chat examples as token rows: ids, mask, completion-only labels and offsets."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .examples import with_rows
from .features import IGNORED

TOKENS = "input_ids array<int>, attention_mask array<int>, labels array<int>, offsets array<struct<start:int,end:int>>, answer_start int"
Encode = Callable[[str], list[tuple[int, int, int]]]


def render(messages: list[dict], opened: bool = False) -> str:
    """<role>content</role> of each message; ``opened`` adds the start of an assistant's turn."""
    return "".join(f"<{m['role']}>{m['content']}</{m['role']}>" for m in messages) + ("<assistant>" if opened else "")


def characters(text: str) -> list[tuple[int, int, int]]:
    """(id, start, end) of each character: a tokenizer for tests."""
    return [(k, k, k + 1) for k in range(len(text))]


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def from_file(path: str) -> Encode:
    """A public tokenizer's file, loaded once in each worker."""

    def encode(text: str) -> list[tuple[int, int, int]]:
        e = _library(path).encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    return encode


def check_markers(path: str, markers: tuple[str, ...]) -> dict[str, int]:
    """The id of each marker that a chat template needs; an error for markers that aren't one token of their own."""
    ids = {m: _library(path).token_to_id(m) for m in markers}
    if missing := [m for m, i in ids.items() if i is None or _library(path).encode(m, add_special_tokens=False).ids != [i]]:
        raise ValueError(f"the tokenizer lacks {missing}")
    return ids


def tokenize(df: DataFrame, encode: Encode = characters, longest: int | None = None, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Adds token columns to chat examples; offsets and answer_start count characters of the rendered text.

    The rendered prompt must begin the whole text, and its tokens the whole text's tokens. Rows are cut to
    ``longest`` tokens; a row whose labels are all ignored then is an error.
    """

    def one(before: list[dict], after: list[dict]) -> dict:
        head, whole = render(before, opened=True), render([*before, *after])
        if not whole.startswith(head):
            raise ValueError("the prompt is not a prefix of the text")
        start, tokens = encode(head), encode(whole)
        if [t[0] for t in tokens[: len(start)]] != [t[0] for t in start]:
            raise ValueError("the prompt's tokens are not a prefix of the text's")
        tokens = tokens[:longest]
        labels = [IGNORED if k < len(start) else t[0] for k, t in enumerate(tokens)]
        if all(x == IGNORED for x in labels):
            raise ValueError("no token is left to learn from")
        return {"input_ids": [t[0] for t in tokens], "attention_mask": [1] * len(tokens), "labels": labels, "offsets": [{"start": a, "end": b} for _, a, b in tokens], "answer_start": len(head)}

    return with_rows(df, [prompt, completion], TOKENS, one)


def prepare(df: DataFrame, encode: Encode = characters, longest: int | None = None) -> DataFrame:
    """Train and validation rows of a split collection, tokenized, without their source columns; test rows are never read."""
    rows = df.where(F.col("split").isin("train", "validation"))
    return tokenize(rows, encode, longest).select("split", *(x.split()[0] for x in TOKENS.split(", ")))
