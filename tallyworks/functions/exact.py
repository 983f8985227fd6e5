"""Exact rational numbers as text: reading, showing, comparing. Pure Python, shared by the Arrow functions."""

from __future__ import annotations

import math
import re
from decimal import DecimalException
from fractions import Fraction

#: What counts as a number in text, and the digits shown of a repeating decimal.
NUMBER = r"-?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)"
RATIO = rf"{NUMBER}\s*/\s*{NUMBER}"
NUMBER_OR_RATIO = rf"(?:{RATIO}|{NUMBER})"
SHOWN_PLACES = 10
WORST_ERROR = Fraction(2)

_WHOLE = re.compile(NUMBER_OR_RATIO)


def read(text: str | None) -> Fraction | None:
    """The number that the whole text is, or None; a zero denominator is no number."""
    text = (text or "").strip()
    if not _WHOLE.fullmatch(text):
        return None
    try:
        over = [Fraction(part.strip().replace(",", "")) for part in text.split("/")]
        return over[0] if len(over) == 1 else over[0] / over[1]
    except (ValueError, ZeroDivisionError, DecimalException):
        return None


def half_up(value: Fraction, places: int) -> Fraction:
    """Rounded to ``places`` decimals, halves away from zero."""
    scaled = abs(value) * 10**places
    size = Fraction(math.floor(scaled + Fraction(1, 2)), 10**places)
    return -size if value < 0 else size


def cut_off(value: Fraction, places: int) -> Fraction:
    size = Fraction(math.floor(abs(value) * 10**places), 10**places)
    return -size if value < 0 else size


def _decimal(value: Fraction, places: int) -> str:
    units = value * 10**places
    digits = str(abs(units.numerator)).rjust(places + 1, "0")
    sign = "-" if value < 0 else ""
    return f"{sign}{digits[:-places]}.{digits[-places:]}" if places else sign + digits


def show(value: Fraction) -> str:
    """Shortest exact decimal; repeating decimals rounded to SHOWN_PLACES."""
    rest, twos, fives = value.denominator, 0, 0
    while rest % 2 == 0:
        rest, twos = rest // 2, twos + 1
    while rest % 5 == 0:
        rest, fives = rest // 5, fives + 1
    if rest == 1:
        return _decimal(value, max(twos, fives))
    return _decimal(half_up(value, SHOWN_PLACES), SHOWN_PLACES)


def normal(text: str | None) -> str | None:
    value = read(text)
    return None if value is None else show(value)


def places(text: str) -> int | None:
    """Stated decimal places; None for a ratio."""
    plain = text.strip().replace(",", "")
    if "/" in plain:
        return None
    return len(plain.partition(".")[2])


def accepts(stated: str | None, value: Fraction) -> bool:
    """Whether stated text is the value, or the value rounded or cut off at one stated decimal place or more."""
    got = read(stated)
    if got is None:
        return False
    if got == value:
        return True
    n = places(stated)
    return bool(n) and got in (half_up(value, n), cut_off(value, n))


def same(stated: str | None, target: str | None) -> bool:
    value = read(target)
    return value is not None and accepts(stated, value)


def symmetric_error(stated: str | None, target: str | None) -> Fraction | None:
    """2|a-b| / (|a|+|b|), 0 for two zeros; None if either is no number."""
    a, b = read(stated), read(target)
    if a is None or b is None:
        return None
    whole = abs(a) + abs(b)
    return 2 * abs(a - b) / whole if whole else Fraction(0)


def finite(value: Fraction | None) -> float | None:
    """As a double; None if it doesn't fit."""
    try:
        out = float(value)
    except (OverflowError, TypeError):
        return None
    return out if math.isfinite(out) else None


def scale(value: Fraction | None) -> float | None:
    """max(|value|, 1) as a double."""
    return None if value is None else finite(max(abs(value), Fraction(1)))
