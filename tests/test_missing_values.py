"""Missing-value, rounding and order rules that differ between the statistics scripts and SQL."""

import pytest
from pyspark.sql import functions as F

from trialweave.functions import (
    answer,
    answer_fields,
    code_by_prefix,
    if_else,
    item_event,
    item_number,
    larger_of,
    likert_score,
    malformed_answer,
    map_values,
    match_class,
    match_score,
    not_in,
    num,
    sign_by_order,
    strict_mean,
    unknown_indicator,
)
from trialweave.operators import derive, exclude, order, summarise


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_not_in_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.filter(not_in("x", ["a"])).collect()} == {"b", None}


def test_if_else_propagates_missing(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    assert values(df, if_else(F.col("c"), "y", "n")) == [("y",), ("n",), (None,)]


def test_map_values_first_match(spark):
    df = spark.createDataFrame([("hug",), ("run",), (None,)], "e string")
    assert values(df, map_values("e", {"hug": "intimate"})) == [("intimate",), (None,), (None,)]


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("null",), (None,)], "x string")
    assert values(df, num("x")) == [(1.5,), (None,), (None,)]


def test_larger_of_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double")
    assert values(df, larger_of("a", "b")) == [(2.0,), (None,)]


def test_strict_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "g string, x double")
    assert dict(values(df.groupBy("g").agg(strict_mean("x").alias("m")), "g", "m")) == {
        "a": 2.0, "b": None,
    }


def test_single_trial_has_no_sd_and_is_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", None)], "subject string, rt double")
    kept = exclude.exclude_slow_trials(df, ["subject"], "rt")
    assert sorted(values(kept, "subject", "rt")) == [("b", 1.0), ("b", 2.0)]
    # the standard error counts the missing row too
    se = kept.select("rt_se").first()[0]
    assert se == pytest.approx(0.5**0.5 / 3**0.5)


def test_missing_unit_is_a_unit(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0), ("a", 5.0)], "subject string, rt double")
    assert exclude.exclude_slow_trials(df, ["subject"], "rt").count() == 4
    out = spark.createDataFrame([("a",)], "subject string")
    assert exclude.remove_units(df, out, ["subject"]).count() == 2


def test_rounding_half_even(spark):
    df = spark.range(1).select(F.bround(F.lit(0.25), 1), F.bround(F.lit(0.35), 1))
    assert tuple(df.first()) == (0.2, 0.4)


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    r = summarise.five_number(df, [], "x").first()
    assert (r.q1, r.median, r.q3) == (1.75, 2.5, 4.75)
    r = summarise.five_number(df, [], "x", group_limit=0).first()
    assert (r.q1, r.median, r.q3) == (1.75, 2.5, 4.75)


def test_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", None)], "p string, q string")
    got = {(r.p, r.q): r.n for r in summarise.contingency(df, ["p", "q"]).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1}


def test_pivot_keeps_absent_cells_missing_and_any_condition_excludes(spark):
    rows = [("p", "active")] * 3 + [("q", "active")] + [("q", "passive")] * 2
    df = spark.createDataFrame(rows, "subject string, syntax string").withColumn("bad", F.lit(True))
    counts = exclude.bad_trial_counts(df, ["subject"], F.col("bad"), "syntax", ["active", "passive"])
    assert sorted(values(counts, "subject", "active", "passive")) == [("p", 3, None), ("q", 1, 2)]
    out = exclude.by_bad_trials(df, ["subject"], F.col("bad"), 2, "syntax", ["active", "passive"])
    assert values(out, "subject") == [("p",)]


def test_order_needs_a_column(spark):
    df = spark.createDataFrame([("a", 1)], "id string, trial_index int")
    with pytest.raises(ValueError):
        order.carry_forward(df, ["id"], "position", "id")


def test_first_mention(spark):
    rows = [("ann kicks bob", "ann", "bob"), ("bob kicks ann", "ann", "bob"), ("ann runs", "ann", "bob"),
            ("ann kicks bob", None, "bob")]
    df = spark.createDataFrame(rows, "t string, left string, right string").withColumns(
        {"left_gender": F.lit("woman"), "right_gender": F.lit("man"), "aux": F.lit("kick")}
    )
    out = derive.validate_trial(derive.first_mention(df, "t", "left", "right", ["gender"]), "t", "aux")
    assert values(out, "first_person", "first_person_gender", "excluded_trial") == [
        ("left", "woman", "included"), ("right", "man", "included"),
        ("cannot auto compute", "cannot auto compute", "excluded"), (None, None, None),
    ]
    assert values(out.withColumn("w", derive.contains_text("t", "aux", word=True)), "w") == [
        (False,)] * 4


def test_indicator_of_unknown(spark):
    df = spark.createDataFrame([("man",), ("woman",), ("cannot auto compute",), (None,)], "g string")
    assert values(df, unknown_indicator("g", "man"), unknown_indicator("g", "man", "woman")) == [
        (1, 1), (0, 0), (0, None), (None, None)]


def test_answers(spark):
    rows = [('{"Q0":"Left Man"}',), ('{"q0":4}',), ('{"Q0":"bad "quote"}',), (None,)]
    df = spark.createDataFrame(rows, "r string")
    assert values(df, answer("r")) == [("Left Man",), ("4",), ('bad "quote',), (None,)]
    df = spark.createDataFrame([('{"Q0":"27","Q1":null}',), ("oops",)], "r string")
    m = df.select(answer_fields("r").alias("m"), malformed_answer("r").alias("bad"))
    assert [(r.m and r.m.get("Q0"), r.m and r.m.get("Q1"), r.bad) for r in m.collect()][0] == ("27", None, 0)
    assert m.collect()[1].bad == 1


def test_items_and_scores(spark):
    df = spark.createDataFrame([("play3", 0, "reverse"), ("play3", 6, "regular"), ("x", 7, "regular"),
                                ("x", 1, None)], "v string, r int, coding string")
    assert values(df, item_event("v"), item_number("v"), likert_score("r", F.col("coding") == "reverse")) == [
        ("play", "3", -3), ("play", "3", -3), ("x", "", None), ("x", "", None)]
    df = spark.createDataFrame([(5, None), (5, "right_to_left"), (5, "left_to_right")], "r int, o string")
    assert values(df, sign_by_order("r", "o")) == [(2,), (2,), (-2,)]
    df = spark.createDataFrame([("W1", "W1 is"), ("W3", "W1 is"), (None, "W1")], "p string, s string")
    assert values(df, code_by_prefix("p", "s")) == [("standard",), ("reversed",), (None,)]


def test_match_labels(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True)], "g boolean, r boolean")
    assert values(df, match_class(F.col("g"), F.col("r")), match_score(F.col("g"), F.col("r"))) == [
        ("Gender Match / Race Match", -1), ("Gender Match / Race No-Match", 0),
        ("Gender No-Match / Race No-Match", 1), (None, None)]


def test_composite_key_writes_missing_as_text(spark):
    df = spark.createDataFrame([("study1", None), ("study1", "7")], "study string, subject string")
    assert values(derive.composite_key(df, ["study", "subject"], "k"), "k") == [("study1 NA",), ("study1 7",)]


def test_corrections_and_mismatches(spark):
    df = spark.createDataFrame([("1", "english"), ("2", "english")], "subject string, lang string")
    fix = spark.createDataFrame([("2", "chinese")], "subject string, lang string")
    assert sorted(values(derive.apply_corrections(df, fix, ["subject"]), "subject", "lang")) == [
        ("1", "english"), ("2", "chinese")]
    answers = spark.createDataFrame([("1", "Female ", "woman"), ("2", "man", "woman"), ("3", None, "man")],
                                    "subject string, said string, registered string")
    out = exclude.eligibility_mismatch(answers, ["subject"], {"gender": (F.col("said"), F.col("registered"))},
                                       {"female": "woman", "male": "man"})
    assert sorted(values(out, "subject", "reason")) == [("2", "gender"), ("3", "gender")]


def test_copies_keep_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, t string")
    assert sorted(values(exclude.first_of_copies(df, "t", "i"), "i", "n_copies")) == [(1, 2), (3, 1), (4, 1)]


def test_accuracy_carries_missing_values(spark):
    from trialweave.operators.summarise import accuracy_rt

    df = spark.createDataFrame([("a", 1, 2.0), ("a", None, 4.0), ("b", 1, 3.0)], "g string, f int, t double")
    assert values(accuracy_rt(df, ["g"], "f", "t"), "g", "mean_flag") == [("a", None), ("b", 1.0)]
    assert values(accuracy_rt(df, ["g"], "f", "t", na_rm=True), "g", "mean_flag") == [("a", 1.0), ("b", 1.0)]


def test_first_mention_of_whole_words(spark):
    from trialweave.operators.derive import first_mention

    df = spark.createDataFrame(
        [("superman and anna, then man.", "man", "anna"), ("a man, and anna", "man", "anna"), ("superman, anna", "man", "anna"),
         ("m.n anna man", "m.n", "anna")], "text string, l string, r string")
    got = [r.first_person for r in first_mention(df, "text", "l", "r", word=True).collect()]
    assert got == ["right", "left", "cannot auto compute", "left"]
