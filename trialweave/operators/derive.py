"""Trial-level derivations: which name comes first, is the trial valid, who matches whom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import _col, if_else
from ..functions.recode import match_class, match_score, matches
from ..functions.text import tag_by_pattern

UNKNOWN = "cannot auto compute"


def _whole_word(part: Column) -> Column:
    """Pattern for a quoted name that neither follows nor precedes a letter, digit or underscore."""
    quoted = F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?U)(?<!\\w)\\Q"), quoted, F.lit("\\E(?!\\w)"))


def contains_text(text, part, word: bool = False) -> Column:
    """Substring test between two columns; ``word=True`` asks for whole words."""
    text, part = _col(text), _col(part)
    return F.rlike(text, _whole_word(part)) if word else F.contains(text, part)


def place_of_text(text, part, word: bool = False) -> Column:
    """Place of the first occurrence, from one; ``word=True`` asks for whole words."""
    text, part = _col(text), _col(part)
    return F.regexp_instr(text, _whole_word(part)) if word else F.instr(text, part)


def first_mention(
    df: DataFrame,
    text: str,
    left: str,
    right: str,
    attributes: Sequence[str] = (),
    name: str = "first_person",
    left_label: str = "left",
    right_label: str = "right",
    attribute_columns: dict[str, tuple[str, str]] | None = None,
    word: bool = False,
) -> DataFrame:
    """Which of two names occurs first in a text, and that person's attributes.

    Adds ``left_mentioned``, ``right_mentioned``, ``both_mentioned``, ``<name>`` and one
    ``<name>_<attribute>`` per attribute, read from ``left_<attribute>`` / ``right_<attribute>``
    unless ``attribute_columns`` says otherwise. ``UNKNOWN`` when not both names are there.
    """
    out = (
        df.withColumn("left_mentioned", contains_text(text, left, word))
        .withColumn("right_mentioned", contains_text(text, right, word))
        .withColumn(
            "both_mentioned",
            if_else(F.col("left_mentioned") & F.col("right_mentioned"), True, False),
        )
    )
    both = F.col("both_mentioned")
    # a column of its own: inside the choice below the positions would be searched twice
    earlier = F.when(both, place_of_text(text, left, word) < place_of_text(text, right, word))
    out = out.withColumn("_earlier", earlier)
    choice = if_else(F.col("_earlier"), left_label, right_label)
    out = out.withColumn(name, if_else(~both, F.lit(UNKNOWN), choice)).drop("_earlier")
    for a in attributes:
        l, r = (attribute_columns or {}).get(a, (f"left_{a}", f"right_{a}"))
        out = out.withColumn(
            f"{name}_{a}",
            if_else(~both, F.lit(UNKNOWN), if_else(F.col(name) == left_label, F.col(l), F.col(r))),
        )
    return out


def validate_trial(df: DataFrame, text: str, phrase: str) -> DataFrame:
    """``syntax_correct`` and the three included/excluded labels (by mention, by phrase, both)."""
    return (
        df.withColumn("syntax_correct", contains_text(text, phrase))
        .withColumn("excluded_trial_mention", if_else(~F.col("both_mentioned"), "excluded", "included"))
        .withColumn("excluded_trial_syntax", if_else(~F.col("syntax_correct"), "excluded", "included"))
        .withColumn(
            "excluded_trial",
            if_else(
                (F.col("excluded_trial_mention") == "included")
                & (F.col("excluded_trial_syntax") == "included"),
                "included",
                "excluded",
            ),
        )
    )


def complete_phrase(df: DataFrame, text: str, syntax: str, needs: str, literal: str) -> DataFrame:
    """Trials of kind ``needs`` must contain ``literal`` to be complete; the rest is complete."""
    kind = F.col(syntax)
    return df.withColumn(
        "complete_phrase",
        if_else(
            (kind != needs) | ((kind == needs) & F.contains(F.col(text), F.lit(literal))),
            "complete",
            "incomplete",
        ),
    )


def trial_types(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Trial type from the equality of two attributes, and the two sub-types."""
    lg, rg = F.col(f"{left}_gender"), F.col(f"{right}_gender")
    lr, rr = F.col(f"{left}_race"), F.col(f"{right}_race")
    return (
        df.withColumn("TrialType", if_else(lg == rg, "RaceTrial", "GenderTrial"))
        .withColumn(
            "GenderTrialType",
            if_else((lr == "black") & (rr == "black"), "BlackTrial", "WhiteTrial"),
        )
        .withColumn(
            "RaceTrialType", if_else((lg == "woman") & (rg == "woman"), "WomanTrial", "ManTrial")
        )
    )


def like_me(
    df: DataFrame,
    actor_gender: str = "first_person_gender",
    actor_race: str = "first_person_race",
    own_gender: str = "ppt_gender",
    own_race: str = "ppt_race",
    use_race: Column | None = None,
) -> DataFrame:
    """Match of actor and participant by gender, by race, and by the attribute that varies."""
    use_race = F.col("TrialType") == "RaceTrial" if use_race is None else use_race
    return (
        df.withColumn("Like_Me_Gender", matches(actor_gender, own_gender))
        .withColumn("Like_Me_Race", matches(actor_race, own_race))
        .withColumn(
            "OverallLikeMe", if_else(use_race, F.col("Like_Me_Race"), F.col("Like_Me_Gender"))
        )
    )


def memory_match_features(
    df: DataFrame,
    stimulus: str = "stimulus",
    gender_pattern: str = "W[1-2].jpg",
    race_pattern: str = "W[MW][1-2].jpg",
    race_labels: tuple[str, str] = ("white", "black"),
) -> DataFrame:
    """Actor attributes read off the picture name, match flags, 2x2 class and distance score."""
    out = df.withColumn(
        "figure_gender", tag_by_pattern(stimulus, gender_pattern, "woman", "man")
    ).withColumn("figure_race", tag_by_pattern(stimulus, race_pattern, *race_labels))
    same_gender = F.col("ppt_gender") == F.col("figure_gender")
    same_race = F.col("ppt_race") == F.col("figure_race")
    return (
        out.withColumn("first_guess_num", matches("first_guess", F.lit("TRUE")))
        .withColumn("correct_response", matches("button_pressed", "correct"))
        .withColumn("like_me_gender", same_gender.cast("int"))
        .withColumn("like_me_race", same_race.cast("int"))
        .withColumn("OverallLikeMe", (same_race & same_gender).cast("int"))
        .withColumn("LikeMeFeature", match_class(same_gender, same_race))
        .withColumn("LikeMeFeatureNumeric", match_score(same_gender, same_race))
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite cells by a corrections table with one row per key.

    Its other columns name the columns to correct; a missing cell there changes nothing.
    """
    from .units import lookup_join

    targets = [c for c in corrections.columns if c not in keys]
    renamed = corrections.withColumnsRenamed({c: f"_new_{c}" for c in targets})
    out = lookup_join(df, renamed, keys)
    for c in targets:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}").cast(df.schema[c].dataType), F.col(c)))
    return out.drop(*[f"_new_{c}" for c in targets])


def recode_by_table(df: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Label from a (key, value) table; keys not in it get NULL."""
    from .units import lookup_join

    return lookup_join(df, mapping.select(key, value), [key])


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drop the columns from ``first`` to ``last`` as they stand in the table."""
    cols = df.columns
    return df.drop(*cols[cols.index(first) : cols.index(last) + 1])


def composite_key(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Key pasted together with blanks; a missing part is written as ``NA``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    return df.withColumn(name, F.concat_ws(" ", *parts))


