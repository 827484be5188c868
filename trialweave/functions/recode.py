"""Recoding of answers, attributes and match indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import _col, _value, if_else


def map_values(c, mapping: Mapping, default=None) -> Column:
    """Value -> label. Unlisted and missing values get ``default`` (NULL unless given)."""
    c = _col(c)
    out = None
    for value, label in mapping.items():
        out = (F if out is None else out).when(c == F.lit(value), F.lit(label))
    return out if default is None else out.otherwise(_value(default))


def cross_label(columns: Sequence, labels: Mapping[tuple, str]) -> Column:
    """Label for a combination of attributes; combinations not listed are missing."""
    cols = [_col(c) for c in columns]
    out = None
    for values, label in labels.items():
        cond = F.lit(True)
        for c, v in zip(cols, values):
            cond = cond & (c == F.lit(v))
        out = (F if out is None else out).when(cond, F.lit(label))
    return out


def shift_answer(c, low: int = 0, high: int = 6) -> Column:
    """Scale answers low..high moved to 1..; anything else is missing."""
    c = _col(c)
    return F.when(c.between(low, high), c + (1 - low))


def likert_score(c, reverse: Column, mid: int = 3, top: int = 6) -> Column:
    """Centred score: ``mid - r`` for regular items, ``r - mid`` for reverse-coded ones.

    A missing coding gives a missing score; answers outside 0..top are missing.
    """
    c = _col(c)
    return F.when(c.between(0, top), if_else(reverse, c - mid, F.lit(mid) - c))


def code_by_prefix(part, sentence, n: int = 2, same: str = "standard", other: str = "reversed"):
    """Coding key by comparing the first ``n`` characters of the pole and of the sentence."""
    return if_else(
        F.substring(_col(part), 1, n) == F.substring(_col(sentence), 1, n), same, other
    )


def sign_by_order(c, order, keep: str = "right_to_left", mid: int = 3) -> Column:
    """Centred answer, negated unless shown in the order ``keep``; no order leaves it unchanged."""
    centred, order = _col(c) - mid, _col(order)
    return F.when(order.isNull() | (order == keep), centred).otherwise(-centred)


def suffix_condition(c, suffixes: Mapping[str, str], default: str) -> Column:
    """Condition from a literal contained in the item name."""
    c = _col(c)
    out = None
    for literal, label in suffixes.items():
        out = (F if out is None else out).when(c.contains(literal), F.lit(label))
    return out.otherwise(F.lit(default))


def matches(a, b) -> Column:
    """1/0 indicator that two attributes are equal; missing if one is missing."""
    return (_col(a) == _col(b)).cast("int")


def match_class(first: Column, second: Column, names=("Gender", "Race")) -> Column:
    """Label of the 2x2 of two match flags."""
    one, two = names
    return F.when(
        first.isNotNull() & second.isNotNull(),
        F.concat(
            F.when(first, f"{one} Match").otherwise(f"{one} No-Match"),
            F.lit(" / "),
            F.when(second, f"{two} Match").otherwise(f"{two} No-Match"),
        ),
    )


def match_score(first: Column, second: Column) -> Column:
    """-1 when both match, 0 when one does, +1 when none does."""
    return F.lit(1) - first.cast("int") - second.cast("int")


def button_correct(pressed, correct) -> Column:
    """1 when the pressed button is the correct one, else 0."""
    return matches(pressed, correct)


def unknown_indicator(c, one: str, zero: str | None = None) -> Column:
    """Indicator for ``one``.

    Without ``zero`` every other value, also the sentinel for "not computable", counts as 0;
    with ``zero`` only that value is 0 and the rest is missing.
    """
    c = _col(c)
    if zero is None:
        return if_else(c == one, 1, 0)
    return F.when(c == one, 1).when(c == zero, 0)


def order_rank(c, levels: Sequence) -> Column:
    """Position of a category in its display order (0-based)."""
    return map_values(c, {v: i for i, v in enumerate(levels)})
