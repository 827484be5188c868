"""Rating studies: scores, catch items, participant rules, time limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    answer,
    code_by_prefix,
    if_else,
    item_event,
    item_number,
    likert_score,
    not_in,
    num,
    shift_answer,
    sign_by_order,
    suffix_condition,
)
from ..operators import exclude, order
from ..operators.units import UnitProfile, lookup_join, profile_units, unit_join
from ..sources.work import checkpointed

# Catch items, the one that is reversed, question kinds, thresholds.
CATCH_ITEMS = ["chase", "drive", "teach", "remind", "carry", "pose", "feed", "hire"]
REVERSED_CATCH = "drive"
RATING_TYPE = "survey-likert-extra-labels"
EMPATHY_SUFFIXES = {"_active": "active", "_passive": "passive", "_conjoined": "conjoined"}


def rating_rows(log: DataFrame, profile: UnitProfile | None = None) -> DataFrame:
    """Rating rows with the sentence carried down from the row that showed it."""
    log = log.withColumn("trial_index", F.col("trial_index").try_cast("long"))
    filled = order.carry_forward(log, ["id"], "trial_index", "stimulus", profile=profile)
    rows = filled.filter(F.col("trial_type") == RATING_TYPE)
    return rows.withColumn("responses", answer("responses")).withColumn("response", num("responses"))


def score_ratings(rows: DataFrame, coding: DataFrame, by_prefix: bool = False) -> DataFrame:
    """Critical rows with item parts and centred score.

    The coding key comes from the lookup, or from the poles and the sentence (``by_prefix``).
    """
    critical = rows.filter(not_in("verb", CATCH_ITEMS))
    if by_prefix:
        coding = coding.drop("coding")
        # an empty answer is dropped, a missing one as well
        critical = critical.filter(~F.col("responses").isin("", '""'))
    out = lookup_join(critical, coding, ["list", "verb"])
    out = out.withColumns({
        "first_mention_gender": item_event("first_mention_gender"),
        "event": item_event("verb"),
        "event_number": item_number("verb"),
    }).withColumn(
        "trial_condition",
        if_else(F.col("event_number").isin("1", "2"), "same_gender", "different_gender"),
    )
    if by_prefix:
        out = out.withColumn("coding", code_by_prefix("left_part", "sentence_type"))
        reverse = F.col("coding") == "reversed"
    else:
        reverse = F.col("coding") == "reverse"
    return out.withColumns({
        "responses_new": shift_answer("response"),
        "score": likert_score("response", reverse),
    })


def catch_rules(reversed_item: str | None = None, strict: bool = False) -> list[tuple[Column, str]]:
    """(condition, label) in order; the middle of the 1-7 scale counts as correct.

    ``reversed_item`` flips the direction for that item. ``strict`` keeps a slip of the original
    rules: the reversed item is never incorrect on a low volition answer but left unlabelled.
    """
    score, part = F.col("catch_score"), F.col("test_part")
    causation, volition = part == "rating_causation", part == "rating_volition"
    plain = F.lit(True) if reversed_item is None else F.col("verb") != reversed_item
    out = [
        ((score > 3) & causation & plain, "correct"),
        ((score < 5) & volition & plain, "correct"),
        ((score < 5) & causation & plain, "incorrect"),
        ((score > 3) & volition & plain, "incorrect"),
    ]
    if reversed_item is not None:
        flipped = F.col("verb") == reversed_item
        out += [
            ((score < 5) & causation & flipped, "correct"),
            ((score > 3) & volition & flipped, "correct"),
            ((score > 3) & causation & flipped, "incorrect"),
        ]
        if not strict:
            out.append(((score < 5) & volition & flipped, "incorrect"))
    return out


def score_catch(rows: DataFrame, reversed_item: str | None = None, strict: bool = False) -> DataFrame:
    catch = rows.filter(F.col("verb").isin(CATCH_ITEMS))
    catch = catch.withColumn("catch_score", shift_answer("response"))
    return exclude.score_catch_trials(catch, catch_rules(reversed_item, strict))


def straight_liners(rows: DataFrame, threshold: int = 76, values: Sequence[int] | None = None):
    """Participants with the same answer on more than ``threshold`` rating rows (reported only)."""
    return exclude.straight_lining(rows, ["subject"], "response", threshold, values)


def clean_ratings(
    log: DataFrame,
    coding: DataFrame,
    by_prefix: bool = False,
    reversed_item: str | None = None,
    strict: bool = False,
    max_wrong: int = 2,
    residence: bool = True,
    ineligible: DataFrame | None = None,
    slow_sd: float = 3.0,
) -> DataFrame:
    """Scored ratings without participants failing catch items, residence or eligibility."""
    unit = ["subject"]
    profile = profile_units(log, unit)
    rows = checkpointed(rating_rows(log))
    wrong = exclude.by_bad_trials(
        score_catch(rows, reversed_item, strict), unit, F.col("catch_correct") == "incorrect",
        max_wrong, reason="catch items",
    )
    kept = exclude.remove_units(score_ratings(rows, coding, by_prefix), wrong, unit, profile)
    if residence:
        abroad = (F.col("test_part") == "fiveyears") & (num("button_pressed") == 1)
        kept = exclude.remove_units(
            kept, exclude.by_condition(log, unit, abroad, "residence"), unit, profile
        )
    if ineligible is not None:
        kept = exclude.remove_units(kept, ineligible, unit, profile)
    kept = kept.withColumn("rt", num("rt"))
    return exclude.exclude_slow_trials(kept, unit, "rt", slow_sd, profile)


def with_ages(data: DataFrame, log: DataFrame) -> DataFrame:
    """Inner join with the age each participant gave; participants without answers drop out."""
    ages = exclude.participant_answers(
        log, ["subject"], {"Q0": "ppt_age"}, F.col("test_part") == "demographics"
    )
    ages = ages.groupBy("subject").agg(F.min(num("ppt_age")).alias("ppt_age"))
    return unit_join(data, ages, ["subject"], "inner", profile_units(log, ["subject"]))


def clean_empathy(log: DataFrame, minimum: float = 0.85) -> DataFrame:
    """Signed empathy answers with condition, without participants below the catch rate."""
    rows = log.filter(F.col("trial_type") == RATING_TYPE)
    rows = rows.withColumn("responses", num(answer("responses")))
    rows = rows.withColumn("responses", sign_by_order("responses", "name_order"))
    rows = rows.withColumn("condition", suffix_condition("verb", EMPATHY_SUFFIXES, "catch"))
    catch = rows.filter(F.col("verb").isin(CATCH_ITEMS))
    value, flipped = F.col("responses"), F.col("verb") == REVERSED_CATCH
    catch = catch.withColumn(
        "correct", F.when(flipped & (value > 0), 1).when(~flipped & (value < 0), 1).otherwise(0)
    )
    out = exclude.by_rate(catch, ["id"], "correct", minimum)
    return exclude.remove_units(rows, out, ["id"], profile_units(log, ["id"]))


def double_completions(log: DataFrame) -> DataFrame:
    """Worker ids in more than one file, with the first file (by path) and the number of files."""
    ids = log.filter(F.col("test_part") == "worker_id").select("id", answer("responses").alias("w"))
    return (
        ids.groupBy("w")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_files"))
        .filter(F.col("n_files") > 1)
        .withColumnRenamed("w", "worker_id")
    )


def known_worker(log: DataFrame, worker: str) -> bool:
    """Whether a worker id occurs in the log."""
    ids = log.filter((F.col("test_part") == "worker_id") & (answer("responses") == worker))
    return not ids.limit(1).isEmpty()
