"""Final answers: the marked number at the end of a text, or else its last standalone number."""

from __future__ import annotations

import re

from . import exact

#: Fixed patterns.
MARKED = re.compile(rf"####\s*({exact.NUMBER_OR_RATIO})\s*\Z")
STANDALONE = re.compile(rf"(?<![\w.-])({exact.NUMBER_OR_RATIO})(?![\w/-]|\.\d)")


def marked(text: str | None) -> str | None:
    m = MARKED.search(text or "")
    return exact.normal(m[1]) if m else None


def fallback(text: str | None) -> str | None:
    """The last standalone number; None if that one can't be read."""
    found = STANDALONE.findall(text or "")
    return exact.normal(found[-1]) if found else None


def reference(text: str | None) -> str | None:
    """A marked answer, or a text that is a number."""
    return marked(text) or exact.normal(text)
