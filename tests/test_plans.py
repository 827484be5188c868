"""Whole plans on synthetic logs, written as CSV and read back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trialweave.functions import drop_extension
from trialweave.operators import exclude
from trialweave.plans import analysis, memory, production, ratings
from trialweave.sources import (
    pseudonymise,
    read_intermediate,
    read_logs,
    read_lookup,
    write_csv,
    write_numbered_csv,
    write_table,
)

LOG_COLUMNS = [
    "rt", "subject", "list", "trial_type", "trial_index", "responses", "image_type", "phrase_type",
    "ppt_gender", "ppt_race", "test_part", "button_pressed", "first_guess", "correct", "stimulus",
]
LOOKUP_COLUMNS = [
    "verb", "list", "left", "right", "left_gender", "left_race", "right_gender", "right_race",
    "syntax", "auxiliary",
]


@pytest.fixture(scope="module")
def production_log(spark, tmp_path_factory):
    rng = random.Random(1)
    people = [("ann", "woman", "white"), ("bob", "man", "white"), ("eve", "woman", "black"), ("jim", "man", "black")]
    lookup = []
    for i in range(1, 9):
        l, r = rng.sample(people, 2)
        lookup.append((f"hug{i}", "List1A", l[0], r[0], l[1], l[2], r[1], r[2],
                       "intransitive" if i % 2 else "transitive", "is"))
    rows = []
    for p in range(12):
        who = people[p % 4]
        for t, item in enumerate(lookup * 3):
            verb, l, r = item[0], item[2], item[3]
            first, second = (l, r) if rng.random() < (1.0 if p == 1 else 0.5) else (r, l)
            said = f"{first} is hugging {second}" if not (p == 0 and rng.random() < 0.8) else f"{first} hugs"
            rt = 60_000 if (p == 2 and t == 5) else 900 + rng.randrange(200)
            rows.append((str(rt), f"s{p}", "list1A", "survey-text", str(t), json.dumps({"Q0": said}, separators=(",", ":")),
                         f'<img src="stim_listA/{verb}.gif"</stim_listA>', "x", who[1], who[2], "" if p % 2 else None, None,
                         None, None, None))
        rows.append(("1", f"s{p}", "list1A", "survey-text", "90", json.dumps({"Q0": "30", "Q1": "English", "Q4": who[2], "Q5": "Female " if who[1] == "woman" else "male"}),
                     "", "", who[1], who[2], "demographics", None, None, None, None))
        rows.append(("null", f"s{p}", "list1A", "html-button-response", "91", None, "", "", who[1], who[2], "fiveyears",
                     "1" if p == 5 else "0", None, None, None))
        for g in range(6):
            rows.append((str(2000 + 17 * g * (p + 1) + rng.randrange(400)), f"s{p}", "list1A", "html-button-response", str(100 + g), None, "", "", who[1], who[2],
                         "memory", str(g % 2), "TRUE", str(g % 2), ["BW1.jpg", "BM1.jpg", "WW2.jpg", "WM1.jpg"][g % 4]))
    folder = tmp_path_factory.mktemp("logs")
    log = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in LOG_COLUMNS))
    write_csv(log, f"{folder}/log")
    write_csv(spark.createDataFrame(lookup, ", ".join(f"{c} string" for c in LOOKUP_COLUMNS)), f"{folder}/tags")
    read = read_logs(spark, [(f"{folder}/log", LOG_COLUMNS)])
    return read, read_lookup(spark, f"{folder}/tags", LOOKUP_COLUMNS, lower=["list"])


def test_clean_log(production_log):
    log, tags = production_log
    study = production.ProductionStudy("study1", valence=production.VALENCE_FIRST, bad_limit=5, cycle=24)
    trials = production.prepare(log, tags, study)
    assert trials.count() == 12 * 24
    assert {r.trial_number for r in trials.filter("subject = 's3'").collect()} == set(range(1, 25))
    rules = production.rules(trials, log, study)
    assert [r.subject for r in rules["bad trials"].collect()] == ["s0"]
    assert [r.subject for r in rules["orientation"].collect()] == ["s1"]
    clean = production.clean_log(log, tags, study)
    by = {r.subject: r["count"] for r in clean.groupBy("subject").count().collect()}
    assert set(by) == {f"s{i}" for i in range(2, 12)} and by["s2"] == 23 and by["s3"] == 24
    row = clean.filter("subject = 's4'").first()
    assert row.event == "hug" and row.valence == "intimate" and row.ppt_demog == "White_Woman"
    assert row.study == "study1" and row.first_person in ("left", "right")
    abroad = production.ProductionStudy("study4", bad_limit=5, residence_part="fiveyears")
    assert "s5" not in {r.subject for r in production.clean_log(log, tags, abroad).select("subject").collect()}
    game = production.memory_trials(log, trials, study)
    assert game.count() == 10 * 6
    report = production.orientation_report(trials, study, ["ppt_gender"])
    assert report.count() == 2


def test_memory(spark, production_log):
    log, tags = production_log
    study = production.ProductionStudy("study1", bad_limit=5)
    game = production.memory_trials(log, production.prepare(log, tags, study), study)
    f = memory.features(game.withColumn("id", F.col("subject")))
    assert f.filter("figure_gender = 'woman'").select("stimulus").distinct().count() == 2
    assert memory.accuracy(f).filter("mean_flag = 1").count() > 0
    s = memory.match_summary(f, replicates=50)
    assert s.count() == 4 and s.filter("ci_low <= mean and mean <= ci_high").count() == 4
    assert memory.cutoff_report(spark, f, [10_000, 2_500]).count() == 4
    assert memory.ordered_means(spark, f).count() == 3


def test_eligibility(production_log):
    log, _ = production_log
    answers = exclude.participant_answers(
        log, ["subject"], {"Q0": "age", "Q5": "gender"}, F.col("test_part") == "demographics", keep=["ppt_gender"]
    )
    assert answers.count() == 12 and answers.first().age == "30"
    out = exclude.eligibility_mismatch(answers, ["subject"], {"gender": (F.col("gender"), F.col("ppt_gender"))},
                                       {"female": "woman", "male": "man"})
    assert out.count() == 0


def rating_log(spark):
    rows = []
    for p in range(5):
        position = 0
        for item, part in [("play1", "rating_volition"), ("play3", "rating_causation"), ("drive", "rating_causation"),
                           ("hire", "rating_volition"), ("feed", "rating_causation"), ("pose", "rating_volition")] * 2:
            rows.append((f"f{p}", f"s{p}", str(position), f"W{position}", "html-keyboard-response", "1A", item, None, None, "900", "conjoined", "W1", "W1 is"))
            wrong = p == 0 and item in ("hire", "feed", "drive", "pose")
            good = 5 if (part == "rating_causation") else 1
            r = 6 - good if wrong else good
            rows.append((f"f{p}", f"s{p}", str(position + 1), None, "survey-likert-extra-labels", "1A", item, part, json.dumps({"Q0": r}), str(800 + position), "conjoined", "W1 x", "W1 is"))
            position += 2
        rows.append((f"f{p}", f"s{p}", str(position), None, "survey-text", "1A", None, "demographics", '{"Q0":"41","Q1":null}', "1", "conjoined", None, None))
        rows.append((f"f{p}", f"s{p}", str(position + 1), None, "survey-text", "1A", None, "worker_id", '{"Q0":"w%d"}' % min(p, 3), "1", "conjoined", None, None))
    cols = "id subject trial_index stimulus trial_type list verb test_part responses rt condition left_part sentence_type".split()
    log = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    return log.withColumns({"button_pressed": F.lit(None).cast("string"), "name_order": F.lit("left_to_right")})


def test_ratings(spark):
    log = rating_log(spark)
    coding = spark.createDataFrame([("play1", "1A", "regular", "W1"), ("play3", "1A", "reverse", "M2")],
                                   "verb string, list string, coding string, first_mention_gender string")
    rows = ratings.rating_rows(log)
    assert rows.filter("stimulus = 'W0' and trial_index = 1").count() == 5
    assert {r.score for r in ratings.score_ratings(rows, coding).filter("verb = 'play1'").collect()} == {2}
    assert {r.score for r in ratings.score_ratings(rows, coding).filter("verb = 'play3'").collect()} == {2}
    assert {r.score for r in ratings.score_ratings(rows, coding, by_prefix=True).filter("verb = 'play3'").collect()} == {-2}
    clean = ratings.clean_ratings(log, coding)
    assert {r.subject for r in clean.select("subject").distinct().collect()} == {"s1", "s2", "s3", "s4"}
    assert ratings.with_ages(clean, log).filter("ppt_age = 41").count() == clean.count()
    assert ratings.straight_liners(rows, threshold=5).count() > 0
    double = ratings.double_completions(log).collect()
    assert [(r.worker_id, r.first_id, r.n_files) for r in double] == [("w3", "f3", 2)]
    assert ratings.known_worker(log, "w1") and not ratings.known_worker(log, "nobody")
    assert analysis.rating_report(clean, replicates=20).count() == 1


def test_reversed_catch_item(spark):
    df = spark.createDataFrame([("drive", "rating_volition", 2.0), ("drive", "rating_causation", 2.0), ("hire", "rating_volition", 2.0),
                                ("hire", "rating_causation", 3.0)], "verb string, test_part string, response double")
    label = lambda **kw: [r.catch_correct for r in ratings.score_catch(df, **kw).collect()]
    assert label() == ["correct", "incorrect", "correct", "correct"]
    assert label(reversed_item="drive") == ["incorrect", "correct", "correct", "correct"]
    assert label(reversed_item="drive", strict=True) == [None, "correct", "correct", "correct"]


def test_empathy(spark):
    rows = [("f1", v, r) for v, r in (("hire", 5), ("drive", 1), ("kick_active", 4), ("kick_passive", 2))]
    rows += [("f2", v, r) for v, r in (("hire", 1), ("drive", 1), ("kick_active", 4))]
    df = spark.createDataFrame([("survey-likert-extra-labels", i, v, json.dumps({"Q0": r}), "left_to_right") for i, v, r in rows],
                               "trial_type string, id string, verb string, responses string, name_order string")
    kept = ratings.clean_empathy(df)
    got = {(r.verb, r.condition, r.responses) for r in kept.filter("condition <> 'catch'").collect()}
    assert got == {("kick_active", "active", -1.0), ("kick_passive", "passive", 1.0)}


def test_chinese_study(spark):
    stim = spark.createDataFrame([("kick1.gif", "race_male", "english", "1A", "Li", "Bob", "Asian", "black", "male", "male"),
                                  ("kick2.gif", "gender_asian", "english", "1A", "Li", "Mei", "asian", "asian", "male", "female")],
                                 "gif string, picture_condition string, language string, list string, left_name string, right_name string, "
                                 "left_race string, right_race string, left_gender string, right_gender string")
    rows = []
    for p, gender in ((1, "man"), (2, "woman")):
        for t in range(8):
            gif, other = ("kick1", "bob") if t % 2 else ("kick2", "mei")
            first, second = ("li", other) if t % 4 < 2 else (other, "li")
            rows.append((str(p), str(900 + t), "1a", "survey-text", str(t), '{"q0":"%s is kicking %s"}' % (first, second),
                         f"<img src='gifs/{gif}.gif' style='height:400px;''></img>", "kick", "is kicking", "english", gender, "asian", None))
    log = spark.createDataFrame(rows, "subject string, rt string, list string, trial_type string, trial_index string, responses string, "
                                "image string, verb string, phrase string, condition string, ppt_gender string, ppt_race string, test_part string")
    clean = production.clean_log(log, production.chinese_lookup(stim), production.CHINESE)
    assert clean.count() == 16
    verbs = spark.createDataFrame([("kick", "kick")], "verb string, english_translation string")
    out = production.chinese_for_union(clean, verbs)
    assert {r.TrialType for r in out.collect()} == {"Race Trials", "Gender Trials"}
    assert out.filter("event = 'kick' and OverallLikeMe is not null").count() == 16
    english = spark.createDataFrame([("study1", "9", "hug", 1, "RaceTrial", "White_Man", "conjoined", "man", "white")],
                                    "study string, subject string, event string, OverallLikeMe int, TrialType string, ppt_demog string, "
                                    "syntax string, ppt_gender string, ppt_race string")
    both = analysis.harmonise(english, out)
    assert both.filter("ppt_race = 'asian' and ppt_gender = 'man'").count() == 8
    assert both.filter("TrialType = 'Race Trials' and study = 'study1'").count() == 1
    report = {r.syntax_unique: r for r in analysis.construction_report(both, replicates=20).collect()}
    assert set(report) == {"Conjoined", "Chinese active"} and report["Chinese active"].n == 2


def test_catalogue_is_consistent():
    models = analysis.catalogue()
    assert len(models) == 31
    for family, m in models.values():
        assert family in ("binomial", "gaussian")
        for term in [*m.fixed, *(t for r in m.random for t in r.terms)]:
            assert set(term) <= set(m.variables)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", ' lead "q"')], "k string, t string")
    write_numbered_csv(df, str(tmp_path / "numbered"), df.columns[:1])
    back = read_intermediate(spark, str(tmp_path / "numbered"), ["k", "t"])
    assert sorted(r.t for r in back.collect()) == ['lead "q"', "x y"] and back.columns == ["k", "t"]
    write_table(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert {r.k for r in pseudonymise(df, ["k"]).collect()} == {"anonymised"}
    assert len({r.k for r in pseudonymise(df, ["k"], how="sha2").collect()}) == 2
    assert df.select(drop_extension(F.lit("a1.gif"))).first()[0] == "a1"
    plain = read_logs(spark, [(str(tmp_path / "numbered"), ["_row", "k", "t"], {"condition": "c"})], {"_row": "long"})
    assert dict(plain.dtypes)["_row"] == "bigint" and plain.first().id.startswith("file:")


def test_reads_what_survey_tools_write(spark, tmp_path):
    """Byte-order mark, padded cells, doubled quotes in JSON, empty cells, differing headers."""
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "1.csv").write_bytes(
        b'\xef\xbb\xbfverb,list,responses\nkick1,"Female ","{""Q0"":""27"",""Q1"":null}"\n Black,NA,x\n'
    )
    (tmp_path / "a" / "skip.txt").write_text("verb,list,responses\nz,z,z\n")
    (tmp_path / "b" / "2.csv").write_text('"list","verb"\n"1A","hug2"\n')
    log = read_logs(spark, [(str(tmp_path / "a" / "*.csv"), ["verb", "list", "responses"]),
                            (str(tmp_path / "b"), ["list", "verb"], {"condition": "transitive"})])
    rows = {r.verb: r for r in log.collect()}
    assert set(rows) == {"kick1", "Black", "hug2"}
    assert rows["kick1"].list == "Female" and rows["kick1"].responses == '{"Q0":"27","Q1":null}'
    assert rows["Black"].list is None and rows["hug2"].condition == "transitive"
    assert rows["hug2"].responses is None and rows["hug2"].id.endswith("/b/2.csv")
