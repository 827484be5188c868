"""Raw production log -> cleaned trial table, for the studies in which people describe pictures.

``prepare`` derives everything per trial, ``rules`` computes each participant rule on the table it
belongs to, ``clean_log`` applies them in order.  Participant rules are small tables keyed by
participant; the log itself is joined with them, and one measured profile of the log decides how.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    answer,
    cross_label,
    if_else,
    item_event,
    map_values,
    matches,
    not_in,
    num,
    strip_literals,
    unknown_indicator,
)
from ..operators import derive, exclude, order
from ..operators.units import UnitProfile, lookup_join, profile_units
from ..sources.work import checkpointed

# Fixed values of the studies: labels, wrappers, categories and thresholds.
DEMOGRAPHIC_GROUPS = {
    ("man", "white"): "White_Man",
    ("man", "black"): "Black_Man",
    ("woman", "black"): "Black_Woman",
    ("woman", "white"): "White_Woman",
}
WRAPPERS = [
    '<img src="stim_listA/',
    '<img src="stim_listB/',
    '.gif"</stim_listA>',
    '.gif"</stim_listB>',
]
WRAPPERS_PASSIVE = [
    '<img src="stim_listA/',
    '<img src="stim_listB/',
    '.gif"style="height:400px;"></stim_listA>',
    '.gif"style="height:400px;"></stim_listB>',
]
WRAPPERS_CHINESE = ["<img src='gifs/", ".gif' style='height:400px;''></img>"]
VALENCE_FIRST = {
    "hug": "intimate", "kiss": "intimate", "marry": "intimate", "dance": "intimate",
    "shout": "negative", "argue": "negative", "fight": "negative",
    "meet": "casual", "talk": "casual", "touch": "casual",
}
VALENCE_SECOND = {
    "flirt": "intimate", "kiss": "intimate", "marry": "intimate", "dance": "intimate",
    "shout": "negative", "argue": "negative", "fight": "negative",
    "play": "casual", "talk": "casual", "touch": "casual",
}
VALENCE_THIRD = {
    "kiss": "intimate", "seduce": "intimate", "hug": "intimate",
    "shout": "negative", "challenge": "negative", "oppose": "negative",
    "greet": "casual", "look": "casual", "touch": "casual", "copy": "casual",
}
SIZE_COLUMNS = [
    "left_height", "right_height", "height_diff", "left_width", "right_width", "width_diff",
    "left_volume", "right_volume", "volume_diff",
]


@dataclass(frozen=True)
class ProductionStudy:
    study: str
    image: str = "image_type"
    item: str = "verb"
    wrappers: Sequence[str] = field(default_factory=lambda: WRAPPERS)
    skip_parts: Sequence[str] = ("worker_id", "demographics")
    lookup_keys: Sequence[str] = ("list", "verb")
    left: str = "left"
    right: str = "right"
    left_label: str = "left"
    right_label: str = "right"
    first: str = "first_person"
    phrase: str = "auxiliary"
    conjoined: bool = True  # syntax "intransitive" -> "conjoined", anything else "transitive"
    complete: tuple[str, str] | None = None  # (syntax, literal that must occur)
    valence: Mapping[str, str] = field(default_factory=dict)
    cycle: int = 80
    bad_condition: str | None = "syntax"
    bad_levels: Sequence[str] = ("conjoined", "transitive")
    bad_limit: int = 20
    share_bounds: tuple[float, float] = (0.1, 0.9)
    residence_part: str | None = None
    slow_sd: float = 3.0
    drop: Sequence[str] = ()


FIRST = ProductionStudy("study1", valence=VALENCE_FIRST, drop=SIZE_COLUMNS)
SECOND = ProductionStudy(
    "study2", valence=VALENCE_SECOND, complete=("conjoined", "each"), drop=SIZE_COLUMNS
)
THIRD = ProductionStudy(
    "study4",
    wrappers=WRAPPERS_PASSIVE,
    phrase="phrase_type",
    conjoined=False,
    valence=VALENCE_THIRD,
    bad_levels=("active", "passive"),
    residence_part="fiveyears",
)
CHINESE = ProductionStudy(
    "study5",
    image="image",
    item="gif",
    wrappers=WRAPPERS_CHINESE,
    skip_parts=("fiveyears", "worker_id", "demographics"),
    lookup_keys=("list", "condition", "gif"),
    left="left_name",
    right="right_name",
    left_label="left_name",
    right_label="right_name",
    first="first_figure",
    phrase="phrase",
    conjoined=False,
    cycle=90,
    bad_condition=None,
    bad_limit=32,
)


def chinese_lookup(stimuli: DataFrame) -> DataFrame:
    """Lookup of the two-language study: keys and names in lower case, file extension cut."""
    from ..functions import drop_extension

    names = ["list", "left_name", "right_name", "left_race", "right_race", "left_gender",
             "right_gender"]
    out = stimuli.withColumns({c: F.lower(c) for c in names})
    return out.withColumn("gif", drop_extension("gif")).withColumnRenamed("language", "condition")


def extract_trials(log: DataFrame, stimuli: DataFrame, s: ProductionStudy) -> DataFrame:
    """Trial rows with item code, unwrapped answer and stimulus attributes."""
    trials = log.filter((F.col("trial_type") == "survey-text") & not_in("test_part", s.skip_parts))
    trials = trials.withColumns({
        s.item: strip_literals(s.image, s.wrappers),
        "responses": F.lower(answer("responses")),
        "list": F.lower("list"),
    })
    return lookup_join(trials, stimuli.withColumn("list", F.lower("list")), list(s.lookup_keys))


def prepare(
    log: DataFrame, stimuli: DataFrame, s: ProductionStudy, profile: UnitProfile | None = None
) -> DataFrame:
    """All trial-level derivations."""
    t = extract_trials(log, stimuli, s)
    t = derive.first_mention(
        t, "responses", s.left, s.right, ["gender", "race"], s.first, s.left_label, s.right_label
    )
    t = derive.validate_trial(t, "responses", s.phrase)
    if s.conjoined:
        t = t.withColumn(
            "syntax", if_else(F.col("syntax") == "intransitive", "conjoined", "transitive")
        )
    if s.complete:
        t = derive.complete_phrase(t, "responses", "syntax", *s.complete)
    t = t.withColumn("event", item_event("verb"))
    if s.valence:
        t = t.withColumns({
            "valence": map_values("event", s.valence),
            "ppt_demog": cross_label(["ppt_gender", "ppt_race"], DEMOGRAPHIC_GROUPS),
            "man_first": unknown_indicator(f"{s.first}_gender", "man"),
            "white_first": unknown_indicator(f"{s.first}_race", "white"),
        })
    else:
        t = t.withColumns({
            "man_first": unknown_indicator(f"{s.first}_gender", "male", "female"),
            "asian_first": unknown_indicator(f"{s.first}_race", "asian", "black"),
        })
    t = t.withColumn("trial_index", F.col("trial_index").try_cast("long"))
    return order.cycle_number(t, ["subject"], "trial_index", s.cycle, profile=profile)


def rules(trials: DataFrame, log: DataFrame, s: ProductionStudy) -> dict[str, DataFrame]:
    """Participant rules, each on its own table: reason -> excluded participants."""
    unit = ["subject"]
    first = F.col(s.first)
    shares = exclude.orientation_shares(
        trials, unit, first == s.left_label, first == s.right_label
    )
    out = {
        "bad trials": exclude.by_bad_trials(
            trials, unit, F.col("excluded_trial") == "excluded", s.bad_limit,
            s.bad_condition, s.bad_levels,
        ),
        "orientation": exclude.by_share_bounds(shares, unit, *s.share_bounds),
    }
    if s.residence_part:
        abroad = (F.col("test_part") == s.residence_part) & (num("button_pressed") == 1)
        out["residence"] = exclude.by_condition(log, unit, abroad, "residence")
    return out


def orientation_report(trials: DataFrame, s: ProductionStudy, by: Sequence[str]) -> DataFrame:
    """Mean and sd over participants of the larger orientation share."""
    first = F.col(s.first)
    shares = exclude.orientation_shares(
        trials, ["subject"], first == s.left_label, first == s.right_label, by
    )
    return shares.groupBy(*by).agg(
        F.avg("orientation_bias").alias("orientation_bias_mean"),
        F.stddev_samp("orientation_bias").alias("orientation_bias_sd"),
    )


def clean_log(
    log: DataFrame,
    stimuli: DataFrame,
    s: ProductionStudy,
    ineligible: DataFrame | None = None,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """The cleaned trial table.

    Orientation shares are taken over all trials and applied to the valid ones; the time limits
    come from the valid trials of the remaining participants. ``ineligible`` has a ``subject``
    column (for instance ``exclude.by_table`` or ``exclude.eligibility_mismatch``).
    """
    unit = ["subject"]
    profile = profile or profile_units(log, unit)
    # read by every rule, the time limits and the result: derived once
    trials = checkpointed(prepare(log, stimuli, s, profile))
    excluded = rules(trials, log, s)
    if ineligible is not None:
        excluded["eligibility"] = ineligible
    out = None
    for table in excluded.values():
        keys = table.select("subject")
        out = keys if out is None else out.unionByName(keys)
    kept = exclude.remove_units(trials, out, unit, profile)
    kept = kept.filter(F.col("excluded_trial") != "excluded")
    if s.complete:
        kept = kept.filter(F.col("complete_phrase") != "incomplete")
    kept = kept.withColumn("rt", num("rt"))
    kept = exclude.exclude_slow_trials(kept, unit, "rt", s.slow_sd, profile)
    return kept.drop(*s.drop).select(F.lit(s.study).alias("study"), "*")


def chinese_measures(data: DataFrame) -> DataFrame:
    """Match measures of the two-language study, trial type read off the picture condition."""
    race_picture = F.coalesce(F.col("picture_condition").isin("race_male", "race_female"), F.lit(False))
    code = if_else(F.col("ppt_gender") == "man", "male", "female")
    out = data.withColumn("LikeMeGender", matches("first_figure_gender", code))
    return out.withColumn(
        "OverallLikeMe", F.when(race_picture, F.col("asian_first")).otherwise(F.col("LikeMeGender"))
    ).withColumn("TrialType", F.when(race_picture, "Race Trials").otherwise("Gender Trials"))


def chinese_for_union(data: DataFrame, verbs: DataFrame) -> DataFrame:
    """The columns of the two-language study that join the other studies."""
    out = lookup_join(chinese_measures(data), verbs, ["verb"]).withColumn(
        "ppt_demog", if_else(F.col("ppt_gender") == "man", "Asian Man", "Asian Woman")
    )
    return out.select(
        "subject", F.col("english_translation").alias("event"), "OverallLikeMe", "TrialType",
        "ppt_demog",
    )


def memory_trials(log: DataFrame, trials: DataFrame, s: ProductionStudy) -> DataFrame:
    """First guesses in the naming game of participants who pass the first two rules only."""
    excluded = rules(trials, log, s)
    game = log.filter(
        (F.col("trial_type") == "html-button-response") & F.col("first_guess").isNotNull()
    )
    profile = profile_units(log, ["subject"])
    for reason in ("bad trials", "orientation"):
        game = exclude.remove_units(game, excluded[reason], ["subject"], profile)
    return game.withColumn("Study", F.lit(s.study))
