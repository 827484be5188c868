"""Harmonising studies, group reports and the catalogue of fitted models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import if_else
from ..models import Factor, Model, Numeric, Random, fit_glm, fit_glmm, fit_lmm
from ..operators.derive import composite_key
from ..operators.summarise import group_report, stage_means
from ..sources.logs import union_logs
from ..sources.work import checkpointed

# fixed values: category labels in display order
TRIAL_TYPES = ["Race Trials", "Gender Trials"]
RACES = ("white", "black", "asian")
GENDERS = ("man", "woman")


def harmonise(production: DataFrame, chinese: DataFrame) -> DataFrame:
    """One table of all studies: trial-type labels unified, attributes filled for one study."""
    both = union_logs([production, chinese.withColumn("study", F.lit("study5"))])
    race_trial = F.coalesce(F.col("TrialType").isin("RaceTrial", "Race Trials"), F.lit(False))
    both = both.withColumn(
        "TrialType", F.when(race_trial, "Race Trials").otherwise("Gender Trials")
    )
    group = F.col("ppt_demog")
    gender = F.when(group == "Asian Man", "man").when(group == "Asian Woman", "woman")
    both = both.withColumn("ppt_gender", F.coalesce(gender, F.col("ppt_gender")))
    asian = group.isin("Asian Man", "Asian Woman")
    return both.withColumn("ppt_race", F.when(asian, "asian").otherwise(F.col("ppt_race")))


def construction_report(harmonised: DataFrame, replicates: int = 1000) -> DataFrame:
    """Like-me share per construction with bootstrap interval over (study, participant)."""
    s = F.col("syntax")
    label = (
        F.when(s.isin("active", "transitive"), "Active Transitive")
        .when(s == "conjoined", "Conjoined")
        .when(s == "passive", "Passive")
        .when(s == "English Transitive (Chinese speaker)", "English active")
        .otherwise("Chinese active")
    )
    keyed = composite_key(harmonised, ["study", "subject"], "subject_unique")
    keyed = keyed.withColumn("syntax_unique", label)
    out = group_report(
        keyed, ["subject_unique"], ["syntax_unique"], "OverallLikeMe", 1.0, replicates, na_rm=False
    )
    english = F.col("syntax_unique").isin("Passive", "Active Transitive", "Conjoined")
    return out.withColumn(
        "Participant_Background", if_else(english, "English speakers", "Chinese speakers")
    )


def rating_report(ratings: DataFrame, replicates: int = 1000) -> DataFrame:
    """Mean score per condition from (participant, item) means of participant means."""
    units = stage_means(
        ratings, [["subject", "verb", "condition"], ["subject", "condition"]], "score"
    )
    return group_report(units, ["subject"], ["condition"], "score", 1.0, replicates)


def fit_model(df: DataFrame, model: Model, family: str, **kw):
    """Fit by family and presence of random terms."""
    if family == "binomial":
        return fit_glmm(df, model, **kw) if model.random else fit_glm(df, model, **kw)
    return fit_lmm(df, model, **kw)


def fit_family(
    spark: SparkSession,
    df: DataFrame,
    model: Model,
    subsets: Mapping[str, Column],
    keep: Sequence[str],
    family: str = "binomial",
) -> DataFrame:
    """The same model on several subsets.

    Equal rows are counted once, with the columns the subsets are defined on; every fit starts
    from those counts. ``subset`` names the rows of the result.
    """
    groups = [r.group for r in model.random]
    columns = list(dict.fromkeys([*groups, *model.variables, *keep, model.response]))
    rows = checkpointed(
        df.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("_count"))
    )
    out = None
    for name, cond in subsets.items():
        table = fit_model(rows.filter(cond), model, family, weight="_count").coefficients(spark)
        table = table.withColumn("subset", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return out


def slopes(*names: str) -> tuple[tuple[str, ...], ...]:
    return tuple((n,) for n in names)


def catalogue() -> dict[str, tuple[str, Model]]:
    """Every model formula in use: name -> (family, model)."""
    syntax = Factor("syntax", ("conjoined", "transitive"), "sum2")
    voice = Factor("syntax", ("active", "passive"), "sum2")
    # active sentences count as transitive here
    grammar = Factor("syntax", ("conjoined", "passive", "transitive"))
    condition = Factor("condition", ("chinese", "english"), "sum2")
    rating_condition = Factor("condition", ("conjoined", "passive", "transitive"))
    part = Factor("test_part", ("rating_causation", "rating_volition"), "sum2")
    empathy_condition = Factor("condition", ("active", "conjoined", "passive"))
    gender = Factor("ppt_gender", GENDERS, "centered_treatment")
    race = Factor("ppt_race", RACES, "centered_treatment")
    gender2, race2 = Factor("ppt_gender", GENDERS, "sum2"), Factor("ppt_race", ("black", "white"), "sum2")
    trial_type = Factor("TrialType", tuple(TRIAL_TYPES), "poly")
    y, s = "OverallLikeMe", slopes("syntax")
    subject, event, verb = Random("subject"), Random("event"), Random("verb")
    by_gender_race = (("ppt_gender",), ("ppt_race",), ("ppt_gender", "ppt_race"))
    out: dict[str, tuple[str, Model]] = {
        "syntax": (
            "binomial",
            Model(y, (syntax,), s, random=(Random("subject", s), Random("event", s))),
        ),
        "voice": (
            "binomial",
            Model(y, (voice,), s, random=(Random("subject", s), Random("event", s))),
        ),
        "chinese_null": ("binomial", Model(y, random=(subject, verb))),
        "chinese_condition": (
            "binomial",
            Model(y, (condition,), slopes("condition"),
                  random=(subject, Random("verb", slopes("condition")))),
        ),
        "chinese_condition_simple": (
            "binomial", Model(y, (condition,), slopes("condition"), random=(subject, verb)),
        ),
        "rating_mean": ("gaussian", Model("score", random=(subject, event))),
        "rating_zero": ("gaussian", Model("score", intercept=False, random=(subject, event))),
        "empathy": (
            "gaussian",
            Model("responses", (empathy_condition,), slopes("condition"),
                  random=(Random("subject", slopes("condition")), verb)),
        ),
        "empathy_null": ("gaussian", Model("responses", random=(subject, verb))),
        "empathy_check": (
            "gaussian",
            Model("responses", (empathy_condition,), slopes("condition"),
                  random=(Random("id", slopes("condition")),)),
        ),
        "demographics": (
            "binomial", Model(y, (gender, race), by_gender_race, random=(subject,)),
        ),
        "subject_only": ("binomial", Model(y, random=(subject,))),
        "trial_type": (
            "binomial",
            Model(y, (trial_type,), slopes("TrialType"),
                  random=(Random("subject", slopes("TrialType")), Random("event", slopes("TrialType")))),
        ),
        "grammar": ("gaussian", Model(y, (grammar,), s, random=(subject, verb))),
        "grammar_null": ("gaussian", Model(y, random=(subject, verb))),
        "gender_race_event": (
            "binomial",
            Model(y, (gender2, race2), by_gender_race,
                  random=(subject, Random("event", slopes("ppt_gender", "ppt_race")))),
        ),
        "gender_race_event_simple": (
            "binomial", Model(y, (gender2, race2), by_gender_race, random=(subject, event)),
        ),
        "gender_race_fixed": ("binomial", Model(y, (gender2, race2), by_gender_race)),
    }
    for name, terms in {
        "rating_interaction": (("condition",), ("test_part",), ("condition", "test_part")),
        "rating_additive": (("condition",), ("test_part",)),
        "rating_part": (("test_part",),),
    }.items():
        preds = (part,) if name == "rating_part" else (rating_condition, part)
        out[name] = (
            "gaussian",
            Model("score", preds, terms, random=(Random("subject", slopes("test_part")), event)),
        )
    for attribute, factor in (("ppt_gender", gender2), ("ppt_race", race2)):
        terms = ((attribute,), ("syntax",), (attribute, "syntax"))
        out[f"{attribute}_syntax"] = (
            "binomial",
            Model(y, (factor, voice), terms,
                  random=(Random("subject", s), Random("event", slopes(attribute)))),
        )
        out[f"{attribute}_syntax_simple"] = (
            "binomial", Model(y, (factor, voice), terms, random=(Random("subject", s),)),
        )
    for x in ("like_me_race", "like_me_gender", "OverallLikeMe", "LikeMeFeatureNumeric"):
        out[f"memory_{x}"] = (
            "gaussian",
            Model("log_rt", (Numeric(x),), slopes(x), random=(Random("id", slopes(x)),)),
        )
    out["memory_null"] = ("gaussian", Model("log_rt", random=(Random("id"),)))
    ordered = Factor("LikeMeFeatureOrdered", (-1, 0, 1), "poly")
    out["memory_ordered"] = (
        "gaussian",
        Model("log_rt", (ordered, Numeric("LikeMeFeatureNumeric")), slopes("LikeMeFeatureOrdered"),
              random=(Random("id", slopes("LikeMeFeatureNumeric")),)),
    )
    return out
