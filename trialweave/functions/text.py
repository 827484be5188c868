"""Answers, item codes and file-name tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import _col


def strip_literals(c, literals) -> Column:
    """Remove every given literal (no patterns), one after the other."""
    out = _col(c)
    for literal in literals:
        out = F.replace(out, F.lit(literal), F.lit(""))
    return out


def replace_literals(c, pairs: dict[str, str]) -> Column:
    """Replace every given literal (no patterns) by its other text, one after the other."""
    out = _col(c)
    for old, new in pairs.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def answer(c, question: str = "Q0") -> Column:
    """The single answer of a JSON record. Text that is not JSON is unwrapped literally."""
    c = _col(c)
    wrappers = [
        '{"%s":"' % question,
        '{"%s":"' % question.lower(),
        '{"%s":' % question,
        '"}',
        "}",
    ]
    parsed = F.coalesce(
        F.get_json_object(c, f"$.{question}"), F.get_json_object(c, f"$.{question.lower()}")
    )
    return F.coalesce(parsed, strip_literals(c, wrappers))


def answer_fields(c) -> Column:
    """A flat JSON object as a map; JSON nulls stay NULL, unreadable text gives an empty map."""
    return F.from_json(_col(c), "map<string,string>")


def malformed_answer(c) -> Column:
    """1 where a non-missing answer is not a readable JSON object, else 0."""
    c = _col(c)
    return F.when(c.isNotNull() & F.get_json_object(c, "$").isNull(), 1).otherwise(0)


def item_event(c) -> Column:
    """Item code without its digits: ``play3`` -> ``play``."""
    return F.regexp_replace(_col(c), "[0-9]+", "")


def item_number(c) -> Column:
    """Only the digits of an item code: ``play3`` -> ``3``."""
    return F.regexp_replace(_col(c), "[^0-9]+", "")


def drop_extension(c, n: int = 4) -> Column:
    """Cut the last ``n`` characters."""
    c = _col(c)
    return F.substring(c, F.lit(1), F.length(c) - F.lit(n))


def tag_by_pattern(c, pattern: str, yes: str, no: str) -> Column:
    """Tag by regular expression; like pattern tests on text, a missing name does not match."""
    return F.when(F.coalesce(_col(c).rlike(pattern), F.lit(False)), yes).otherwise(no)


CORRUPT = "_corrupt"


def parsed_answer(c, fields: dict[str, str]) -> Column:
    """A JSON object as a struct of typed fields; ``_corrupt`` holds the whole text where it can't be read."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in fields.items()), f"{CORRUPT} string"])
    return F.from_json(_col(c), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def round_trips(c, fields: dict[str, str]) -> Column:
    """Whether the text, read into these fields, written and read again, is the same and all that was there.

    False for unreadable text and for objects with other fields; missing for missing text.
    """
    first = parsed_answer(c, fields)
    keys = F.coalesce(F.size(F.json_object_keys(_col(c))), F.lit(-1))
    again = parsed_answer(F.to_json(first.dropFields(CORRUPT)), fields)
    whole = F.filter(F.array(*[first[n].isNotNull() for n in fields]), lambda x: x)
    same = first[CORRUPT].isNull() & (F.to_json(first) == F.to_json(again)) & (keys == F.size(whole))
    return F.when(_col(c).isNotNull(), F.coalesce(same, F.lit(False)))


def discovered_fields(df, c):
    """(field, n): names of the objects' fields and in how many texts they occur, in one pass; unreadable texts have none."""
    keys = df.select(F.explode(F.json_object_keys(_col(c))).alias("field"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
