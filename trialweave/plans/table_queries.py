"""The operators bound to the test tables, each with SQL for the same result.

``events`` plays the trial log (user = participant, event_id = trial order, event_type =
condition, value = response time, props = answer), ``documents.text`` the answers in words,
``labels`` a lookup that covers only some rows, ``conversations`` an ordered log, and
orders/lineitem/customer/supplier the cleaned table with attributes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    answer,
    answer_fields,
    button_correct,
    code_by_prefix,
    cross_label,
    drop_extension,
    if_else,
    item_event,
    item_number,
    likert_score,
    log_value,
    malformed_answer,
    map_values,
    match_class,
    match_score,
    not_in,
    num,
    shift_answer,
    sign_by_order,
    strict_mean,
    strip_literals,
    suffix_condition,
    tag_by_pattern,
    unknown_indicator,
)
from ..operators import bootstrap, derive, exclude, order, quantiles, summarise
from ..operators.units import (
    lookup_join,
    natural_left_join,
    profile_units,
    unit_join,
)
from ..sources import pseudonymise, read_log, union_logs, write_csv
from ..sources.work import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

USER = ["user_id"]


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


def with_k(events: DataFrame) -> DataFrame:
    """The answer inside ``props`` as an integer."""
    return events.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


# --- response times -----------------------------------------------------------------------------


@query(
    "slow_trials",
    """
    WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd,
                      stddev_samp(value) / sqrt(count(*)) AS se
               FROM events GROUP BY user_id)
    SELECT e.event_id, e.user_id, e.event_type, e.value, round(m, 6) AS value_mean,
           round(sd, 6) AS value_sd, round(se, 6) AS value_se
    FROM events e JOIN s ON e.user_id IS NOT DISTINCT FROM s.user_id
    WHERE NOT (e.value > m + 3 * sd)
    """,
)
def slow_trials(spark, d):
    kept = exclude.exclude_slow_trials(table(spark, d, "events"), USER, "value")
    kept = kept.select(
        "event_id", "user_id", "event_type", "value", "value_mean", "value_sd", "value_se"
    )
    return rounded(kept, "value_mean", "value_sd", "value_se")


@query(
    "clean_two_stage",
    """
    WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1),
    u AS (SELECT e.user_id, e.event_type, avg(e.value) AS v FROM events e JOIN s USING (user_id)
          WHERE NOT (e.value > m + 3 * sd) GROUP BY 1, 2)
    SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n
    FROM u GROUP BY event_type
    """,
)
def clean_two_stage(spark, d):
    """Three-sd rule on the log, then participant means, then group mean, sd and se."""
    kept = exclude.exclude_slow_trials(
        table(spark, d, "events").select("user_id", "event_type", "value"), USER, "value"
    )
    out = summarise.multi_stage(kept, [["user_id", "event_type"]], ["event_type"], "value")
    return rounded(out, "mean", "sd", "se")


@query(
    "rt_stats",
    """
    WITH e AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
    SELECT user_id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n
    FROM e GROUP BY user_id
    """,
)
def rt_stats(spark, d):
    v = F.when(F.col("event_type") != "error", F.col("value"))
    df = table(spark, d, "events").select("user_id", v.alias("v"))
    out = df.groupBy("user_id").agg(*[e.alias(n) for n, e in summarise.spread("v").items()])
    return rounded(out, "mean", "sd", "se")


@query(
    "strict_mean",
    """
    WITH e AS (SELECT user_id, event_type, CASE WHEN value >= 1 THEN value END AS v FROM events)
    SELECT user_id, event_type, round(avg(v), 6) AS mean,
           round(CASE WHEN count(*) = count(v) THEN avg(v) END, 6) AS strict
    FROM e GROUP BY user_id, event_type
    """,
)
def strict_means(spark, d):
    v = F.when(F.col("value") >= 1, F.col("value"))
    df = table(spark, d, "events").select("user_id", "event_type", v.alias("v"))
    return df.groupBy("user_id", "event_type").agg(
        r6(F.avg("v")).alias("mean"), r6(strict_mean("v")).alias("strict")
    )


@query(
    "numeric_coercion",
    """
    WITH e AS (SELECT event_type,
                      CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(value AS VARCHAR) END AS t
               FROM events)
    SELECT event_type, count(*) AS n, count(TRY_CAST(t AS DOUBLE)) AS n_numbers,
           round(avg(ln(TRY_CAST(t AS DOUBLE))), 6) AS mean_log,
           round(sqrt(sum(TRY_CAST(t AS DOUBLE))), 6) AS root_sum
    FROM e GROUP BY event_type
    """,
)
def numeric_coercion(spark, d):
    text = F.when(F.col("event_type") == "error", "null").otherwise(F.col("value").cast("string"))
    return (
        table(spark, d, "events")
        .select("event_type", num(text).alias("v"))
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("v").alias("n_numbers"),
            r6(F.avg(log_value("v"))).alias("mean_log"),
            r6(F.sqrt(F.sum("v"))).alias("root_sum"),
        )
    )


# --- missing values -----------------------------------------------------------------------------


def labelled(spark, d) -> DataFrame:
    """Documents with their labels; most have none."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return lookup_join(docs, table(spark, d, "labels"), ["doc_id"])


@query(
    "null_safe_not_in",
    """
    SELECT d.doc_id, d.lang, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE coalesce(l.toxic NOT IN (1), TRUE)
    """,
)
def null_safe_not_in(spark, d):
    return labelled(spark, d).filter(not_in("toxic", [1])).select("doc_id", "lang", "toxic")


@query(
    "ifelse_null",
    """
    SELECT d.lang, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality <> 1 THEN 'bad' END AS grade,
           count(*) AS n
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2
    """,
)
def ifelse_null(spark, d):
    grade = if_else(F.col("quality") == 1, "good", "bad")
    return labelled(spark, d).groupBy("lang", grade.alias("grade")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "missing_filter",
    """
    SELECT d.source, count(*) AS n, sum(d.n_chars)::BIGINT AS chars
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1
    """,
)
def missing_filter(spark, d):
    return labelled(spark, d).filter(F.col("quality").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


# --- text and answers ---------------------------------------------------------------------------


@query(
    "answer_json",
    f"""
    SELECT {K} % 7 AS k7, count(*) AS n,
           sum(CASE WHEN json_valid(props) THEN 0 ELSE 1 END)::BIGINT AS malformed
    FROM events GROUP BY 1
    """,
)
def answer_json(spark, d):
    return (
        table(spark, d, "events")
        .select(
            (answer_fields("props").getItem("k").try_cast("int") % 7).alias("k7"),
            malformed_answer("props").alias("bad"),
        )
        .groupBy("k7")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("malformed"))
    )


@query(
    "answer_unwrap",
    """
    SELECT event_id, replace(replace(props, '{"k": ', ''), '}', '') AS unwrapped,
           json_extract_string(props, '$.k') AS parsed
    FROM events
    """,
)
def answer_unwrap(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        strip_literals("props", ['{"k": ', "}"]).alias("unwrapped"),
        answer("props", "k").alias("parsed"),
    )


@query(
    "item_parts",
    """
    SELECT source AS item, regexp_replace(source, '[0-9]+', '', 'g') AS event,
           regexp_replace(source, '[^0-9]+', '', 'g') AS number,
           substr(source, 1, length(source) - 1) AS shorter, count(*) AS n
    FROM documents GROUP BY 1
    UNION ALL
    SELECT p_brand, regexp_replace(p_brand, '[0-9]+', '', 'g'),
           regexp_replace(p_brand, '[^0-9]+', '', 'g'), substr(p_brand, 1, length(p_brand) - 1),
           count(*)
    FROM part GROUP BY 1
    """,
)
def item_parts(spark, d):
    items = (
        table(spark, d, "documents")
        .select(F.col("source").alias("item"))
        .unionByName(table(spark, d, "part").select(F.col("p_brand").alias("item")))
    )
    return (
        items.groupBy("item")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "item",
            item_event("item").alias("event"),
            item_number("item").alias("number"),
            drop_extension("item", 1).alias("shorter"),
            "n",
        )
    )


@query(
    "pattern_tags",
    """
    SELECT CASE WHEN regexp_matches(url, '[0-9]+$') THEN 'numbered' ELSE 'named' END AS tag,
           CASE WHEN contains(url, 'http://') THEN 'plain'
                WHEN contains(url, 'https://') THEN 'secure' ELSE 'other' END AS scheme,
           count(*) AS n
    FROM pages GROUP BY 1, 2
    """,
)
def pattern_tags(spark, d):
    return table(spark, d, "pages").groupBy(
        tag_by_pattern("url", "[0-9]+$", "numbered", "named").alias("tag"),
        suffix_condition("url", {"http://": "plain", "https://": "secure"}, "other").alias(
            "scheme"
        ),
    ).agg(F.count(F.lit(1)).alias("n"))


MENTION_SQL = """
    m AS (SELECT doc_id, lang, source, contains(t, 'the') AS l, contains(t, 'and') AS r,
                 instr(t, 'the') AS pl, instr(t, 'and') AS pr, t
          FROM (SELECT *, lower(text) AS t FROM documents)),
    f AS (SELECT *, CASE WHEN NOT (l AND r) THEN 'cannot auto compute'
                         WHEN pl < pr THEN 'left' ELSE 'right' END AS first_person FROM m)
"""


def mentions(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", "source", F.lower("text").alias("t")
    )
    docs = docs.withColumns({
        "left": F.lit("the"), "right": F.lit("and"), "auxiliary": F.lit("is"),
        "left_kind": F.lit("article"), "right_kind": F.lit("conjunction"),
    })
    return derive.first_mention(docs, "t", "left", "right", ["kind"])


@query(
    "first_mention",
    f"""
    WITH {MENTION_SQL}
    SELECT lang, first_person,
           CASE first_person WHEN 'left' THEN 'article' WHEN 'right' THEN 'conjunction'
                ELSE first_person END AS first_person_kind,
           sum(l::INT)::BIGINT AS n_left, sum(r::INT)::BIGINT AS n_right, count(*) AS n
    FROM f GROUP BY 1, 2, 3
    """,
)
def first_mention(spark, d):
    return mentions(spark, d).groupBy("lang", "first_person", "first_person_kind").agg(
        F.count_if("left_mentioned").alias("n_left"),
        F.count_if("right_mentioned").alias("n_right"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "validate_trial",
    f"""
    WITH {MENTION_SQL}
    SELECT doc_id, contains(t, 'is') AS syntax_correct,
           CASE WHEN l AND r THEN 'included' ELSE 'excluded' END AS excluded_trial_mention,
           CASE WHEN contains(t, 'is') THEN 'included' ELSE 'excluded' END AS excluded_trial_syntax,
           CASE WHEN l AND r AND contains(t, 'is') THEN 'included' ELSE 'excluded' END
             AS excluded_trial,
           CASE WHEN lang <> 'en' OR contains(t, 'each') THEN 'complete' ELSE 'incomplete' END
             AS complete_phrase
    FROM f
    """,
)
def validate_trial(spark, d):
    trials = derive.validate_trial(mentions(spark, d), "t", "auxiliary")
    trials = derive.complete_phrase(trials, "t", "lang", "en", "each")
    return trials.select(
        "doc_id", "syntax_correct", "excluded_trial_mention", "excluded_trial_syntax",
        "excluded_trial", "complete_phrase",
    )


@query(
    "mention_indicator",
    f"""
    WITH {MENTION_SQL}
    SELECT source, sum(CASE WHEN first_person = 'left' THEN 1 ELSE 0 END)::BIGINT AS as_zero,
           avg(CASE first_person WHEN 'left' THEN 1 WHEN 'right' THEN 0 END) AS as_missing
    FROM f GROUP BY source
    """.replace("avg(CASE first_person", "round(avg(CASE first_person").replace(
        "WHEN 'right' THEN 0 END)", "WHEN 'right' THEN 0 END), 6)"
    ),
)
def mention_indicator(spark, d):
    return mentions(spark, d).groupBy("source").agg(
        F.sum(unknown_indicator("first_person", "left")).alias("as_zero"),
        r6(F.avg(unknown_indicator("first_person", "left", "right"))).alias("as_missing"),
    )


# --- scores -------------------------------------------------------------------------------------


@query(
    "likert_score",
    f"""
    WITH e AS (SELECT user_id, {K} % 7 AS r, event_id % 2 = 1 AS rev FROM events)
    SELECT user_id, round(avg(CASE WHEN rev THEN r - 3 ELSE 3 - r END), 6) AS score,
           sum(r + 1)::BIGINT AS sum_shifted
    FROM e GROUP BY user_id
    """,
)
def likert_scores(spark, d):
    e = with_k(table(spark, d, "events")).withColumn("r", F.col("k") % 7)
    return e.groupBy("user_id").agg(
        r6(F.avg(likert_score("r", F.col("event_id") % 2 == 1))).alias("score"),
        F.sum(shift_answer("r")).alias("sum_shifted"),
    )


@query(
    "score_by_prefix",
    """
    WITH p AS (SELECT p_partkey, p_size % 7 AS r, CASE WHEN substr(p_name, 1, 1) =
                      substr(lower(p_type), 1, 1) THEN 'standard' ELSE 'reversed' END AS coding
               FROM part)
    SELECT coding, count(*) AS n,
           round(avg(CASE WHEN coding = 'reversed' THEN r - 3 ELSE 3 - r END), 6) AS score
    FROM p GROUP BY coding
    """,
)
def score_by_prefix(spark, d):
    p = table(spark, d, "part").select(
        (F.col("p_size") % 7).alias("r"),
        code_by_prefix("p_name", F.lower("p_type"), n=1).alias("coding"),
    )
    return p.groupBy("coding").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(likert_score("r", F.col("coding") == "reversed"))).alias("score"),
    )


@query(
    "signed_answer",
    f"""
    WITH e AS (SELECT user_id, {K} % 7 - 3 AS r,
                      CASE event_type WHEN 'view' THEN 'right_to_left' WHEN 'click' THEN
                           'left_to_right' END AS o FROM events)
    SELECT user_id, round(avg(CASE WHEN o IS NULL OR o = 'right_to_left' THEN r ELSE -r END), 6)
             AS response
    FROM e GROUP BY user_id
    """,
)
def signed_answer(spark, d):
    e = with_k(table(spark, d, "events"))
    shown = map_values("event_type", {"view": "right_to_left", "click": "left_to_right"})
    return e.groupBy("user_id").agg(
        r6(F.avg(sign_by_order(F.col("k") % 7, shown))).alias("response")
    )


# --- exclusions ---------------------------------------------------------------------------------

BAD_UNITS_SQL = """
    c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 5 GROUP BY 1, 2),
    x AS (SELECT DISTINCT user_id FROM c WHERE n > 3)
"""
TYPES = ["click", "error", "purchase", "signup", "view"]


def bad_units(events: DataFrame) -> DataFrame:
    return exclude.by_bad_trials(
        events, USER, F.col("value") < 5, 3, condition="event_type", levels=TYPES
    )


@query(
    "bad_trial_counts",
    """
    SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 0) AS click,
           nullif(count(*) FILTER (event_type = 'error'), 0) AS error,
           nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchase,
           nullif(count(*) FILTER (event_type = 'signup'), 0) AS signup,
           nullif(count(*) FILTER (event_type = 'view'), 0) AS "view"
    FROM events WHERE value < 5 GROUP BY user_id
    """,
)
def bad_trial_counts(spark, d):
    return exclude.bad_trial_counts(
        table(spark, d, "events"), USER, F.col("value") < 5, "event_type", TYPES
    )


@query(
    "bad_trial_units",
    f"""
    WITH {BAD_UNITS_SQL}
    SELECT event_id, user_id, event_type, value FROM events
    WHERE value >= 5 AND user_id NOT IN (SELECT user_id FROM x)
    """,
)
def bad_trial_units(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return exclude.remove_units(e, bad_units(e), USER).filter(F.col("value") >= 5)


@query(
    "bad_trial_total",
    """
    SELECT event_id, user_id, value FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE value < 5 GROUP BY 1
                          HAVING count(*) > 8)
    """,
)
def bad_trial_total(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return exclude.remove_units(e, exclude.by_bad_trials(e, USER, F.col("value") < 5, 8), USER)


SHARES_SQL = f"""
    s AS (SELECT user_id, avg(CASE WHEN {K} < 50 THEN 1.0 ELSE 0.0 END) AS l,
                 avg(CASE WHEN {K} >= 50 THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY user_id),
    b AS (SELECT user_id, l, r, CASE WHEN l >= r THEN l ELSE r END AS bias FROM s)
"""


def shares(spark, d) -> DataFrame:
    e = with_k(table(spark, d, "events"))
    return exclude.orientation_shares(e, USER, F.col("k") < 50, F.col("k") >= 50)


@query(
    "orientation_bias",
    f"""
    WITH {SHARES_SQL}
    SELECT e.event_id, e.user_id, e.value FROM events e
    WHERE e.user_id NOT IN (SELECT user_id FROM b WHERE NOT (bias BETWEEN 0.4 AND 0.6))
    """,
)
def orientation_bias(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    out = exclude.by_share_bounds(shares(spark, d), USER, 0.4, 0.6)
    return exclude.remove_units(e, out, USER)


@query(
    "bias_summary",
    f"""
    WITH {SHARES_SQL}
    SELECT c.c_mktsegment AS segment, round(avg(bias), 6) AS mean,
           round(stddev_samp(bias), 6) AS sd, count(*) AS n
    FROM b LEFT JOIN customer c ON c.c_custkey = b.user_id GROUP BY 1
    """,
)
def bias_summary(spark, d):
    segment = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )
    # at most one row per user on both sides
    b = shares(spark, d).join(segment, "user_id", "left")
    return b.groupBy("segment").agg(
        r6(F.avg("orientation_bias")).alias("mean"),
        r6(F.stddev_samp("orientation_bias")).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )


CATCH_SQL = f"""
    k AS (SELECT user_id, CASE WHEN k > 40 AND odd = 0 THEN 'correct'
                               WHEN k < 60 AND odd = 1 THEN 'correct'
                               WHEN k < 60 AND odd = 0 THEN 'incorrect'
                               WHEN k > 40 AND odd = 1 THEN 'incorrect' END AS catch_correct
          FROM (SELECT user_id, {K} AS k, event_id % 2 AS odd FROM events
                WHERE event_type = 'error'))
"""


def catch_trials(spark, d) -> DataFrame:
    e = with_k(table(spark, d, "events").filter(F.col("event_type") == "error"))
    odd, k = F.col("event_id") % 2, F.col("k")
    rules = [
        ((k > 40) & (odd == 0), "correct"),
        ((k < 60) & (odd == 1), "correct"),
        ((k < 60) & (odd == 0), "incorrect"),
        ((k > 40) & (odd == 1), "incorrect"),
    ]
    return exclude.score_catch_trials(e, rules)


@query(
    "catch_score",
    f"""WITH {CATCH_SQL} SELECT catch_correct, count(*) AS n FROM k GROUP BY 1""",
)
def catch_score(spark, d):
    return summarise.value_counts(catch_trials(spark, d), ["catch_correct"])


@query(
    "catch_exclusion",
    f"""
    WITH {CATCH_SQL}
    SELECT e.event_id, e.user_id FROM events e
    WHERE e.user_id NOT IN (SELECT user_id FROM k WHERE catch_correct = 'incorrect'
                            GROUP BY 1 HAVING count(*) > 6)
    """,
)
def catch_exclusion(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    out = exclude.by_bad_trials(
        catch_trials(spark, d), USER, F.col("catch_correct") == "incorrect", 6
    )
    return exclude.remove_units(e, out, USER)


@query(
    "catch_rate",
    f"""
    WITH {CATCH_SQL}
    SELECT e.event_id, e.user_id FROM events e
    WHERE e.user_id NOT IN (SELECT user_id FROM k GROUP BY 1
        HAVING avg(CASE WHEN catch_correct = 'correct' THEN 1.0 ELSE 0.0 END) < 0.5)
    """,
)
def catch_rate(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    scored = catch_trials(spark, d).withColumn(
        "ok", F.when(F.col("catch_correct") == "correct", 1.0).otherwise(0.0)
    )
    return exclude.remove_units(e, exclude.by_rate(scored, USER, "ok", 0.5), USER)


@query(
    "answer_exclusion",
    f"""
    SELECT event_id, user_id FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND {K} = 1)
    """,
)
def answer_exclusion(spark, d):
    e = table(spark, d, "events")
    out = exclude.by_condition(
        with_k(e), USER, (F.col("event_type") == "signup") & (F.col("k") == 1), "residence"
    )
    return exclude.remove_units(e.select("event_id", "user_id"), out, USER)


@query(
    "exclusion_table",
    """
    SELECT event_id, user_id, CASE user_id WHEN 1 THEN 'first language' WHEN 5 THEN 'no answer'
                                           WHEN 7 THEN 'no answer' END AS reason
    FROM events
    """,
)
def exclusion_table(spark, d):
    """Hand-written exclusions with their reasons, shown next to the rows."""
    e = table(spark, d, "events").select("event_id", "user_id")
    rows = [(1, "first language"), (5, "no answer"), (7, "no answer")]
    return lookup_join(e, exclude.by_table(spark, USER, rows, ["bigint"]), USER)


@query(
    "eligibility_mismatch",
    """
    SELECT c_custkey AS user_id,
           concat_ws(', ', CASE WHEN lower(trim(c_mktsegment)) IS DISTINCT FROM lower(s) THEN 'segment' END,
                     CASE WHEN n IS DISTINCT FROM r THEN 'region' END) AS reason
    FROM (SELECT c_custkey, c_mktsegment, o.s, lower(r1.r_name) AS n,
                 CASE WHEN c_acctbal < 0 THEN 'europe' ELSE lower(r1.r_name) END AS r
          FROM customer JOIN nation n1 ON c_nationkey = n_nationkey
          JOIN region r1 ON n_regionkey = r_regionkey
          JOIN (SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN 'BUILDING'
                                           ELSE 'MACHINERY' END) AS s FROM orders GROUP BY 1) o
            ON o.o_custkey = c_custkey)
    WHERE lower(trim(c_mktsegment)) IS DISTINCT FROM lower(s) OR n IS DISTINCT FROM r
    """,
)
def eligibility(spark, d):
    reported = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min(
                F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").otherwise("MACHINERY")
            ).alias("reported_segment")
        )
    )
    people = with_region(spark, d, table(spark, d, "customer"), "c_nationkey", "region")
    # both tables have one row per customer
    people = people.join(reported, "c_custkey").withColumn(
        "registered_region",
        F.when(F.col("c_acctbal") < 0, "europe").otherwise(F.col("region")),
    )
    return exclude.eligibility_mismatch(
        people.withColumnRenamed("c_custkey", "user_id"),
        USER,
        {
            "segment": (F.col("reported_segment"), F.col("c_mktsegment")),
            "region": (F.col("region"), F.col("registered_region")),
        },
    )


@query(
    "straight_lining",
    f"""
    SELECT user_id, {K} % 7 AS answer, count(*) AS n_same FROM events GROUP BY 1, 2
    HAVING count(*) > 15
    """,
)
def straight_lining(spark, d):
    e = with_k(table(spark, d, "events")).withColumn("answer", F.col("k") % 7)
    return exclude.straight_lining(e, USER, "answer", 15)


@query(
    "double_completion",
    """
    SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text
    """,
)
def double_completion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return exclude.first_of_copies(docs, "text", "doc_id").select("doc_id", "n_copies")


@query(
    "repeated_values",
    """SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""",
)
def repeated_values(spark, d):
    return exclude.repeated_values(table(spark, d, "documents"), "text")


@query(
    "rejects",
    f"""
    SELECT CASE WHEN value < 5 THEN 'too fast' WHEN {K} >= 90 THEN 'odd answer' ELSE 'kept' END
             AS reason, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1
    """,
)
def rejects(spark, d):
    kept, rejected = exclude.split_rejects(
        with_k(table(spark, d, "events")),
        [("too fast", F.col("value") < 5), ("odd answer", F.col("k") >= 90)],
    )
    both = kept.withColumn("reason", F.lit("kept")).unionByName(rejected)
    return both.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "waterfall",
    f"""
    WITH {BAD_UNITS_SQL}, {SHARES_SQL},
    o AS (SELECT user_id FROM b WHERE NOT (bias BETWEEN 0.4 AND 0.6)),
    f AS (SELECT e.value, e.user_id IN (SELECT user_id FROM x) AS f1, e.value < 5 AS f2,
                 e.user_id IN (SELECT user_id FROM o) AS f3, e.user_id, e.event_id FROM events e),
    lim AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM f
            WHERE NOT f1 AND NOT f2 AND NOT f3 GROUP BY 1),
    g AS (SELECT f.*, NOT f1 AND NOT f2 AND NOT f3 AND f.value > m + 3 * sd AS f4
          FROM f LEFT JOIN lim USING (user_id)),
    w AS (SELECT count(*) AS c0, count(*) FILTER (NOT f1) AS c1,
                 count(*) FILTER (NOT f1 AND NOT f2) AS c2,
                 count(*) FILTER (NOT f1 AND NOT f2 AND NOT f3) AS c3,
                 count(*) FILTER (NOT f1 AND NOT f2 AND NOT f3 AND NOT coalesce(f4, FALSE)) AS c4
          FROM g)
    SELECT 0 AS step, 'start' AS rule, c0 AS rows_left, 0::BIGINT AS rows_out,
           100.0::DOUBLE AS pct_kept FROM w
    UNION ALL SELECT 1, 'bad trials', c1, c0 - c1, round_even(100.0::DOUBLE * c1 / c0, 1) FROM w
    UNION ALL SELECT 2, 'invalid', c2, c1 - c2, round_even(100.0::DOUBLE * c2 / c1, 1) FROM w
    UNION ALL SELECT 3, 'orientation', c3, c2 - c3, round_even(100.0::DOUBLE * c3 / c2, 1) FROM w
    UNION ALL SELECT 4, 'slow', c4, c3 - c4, round_even(100.0::DOUBLE * c4 / c3, 1) FROM w
    """,
)
def waterfall(spark, d):
    """The cleaning order of the production studies with the counts after each rule."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    profile = profile_units(e, USER)
    flagged = exclude.flag_units(e, bad_units(e), USER, "f1", profile)
    biased = exclude.by_share_bounds(shares(spark, d), USER, 0.4, 0.6)
    flagged = exclude.flag_units(flagged, biased, USER, "f3", profile)
    flagged = flagged.withColumn("f2", F.col("value") < 5)
    # limits come from the valid trials; participant rules take or leave whole participants
    limits = e.filter(F.col("value") >= 5).groupBy(*USER).agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")
    )
    limited = unit_join(flagged, limits, USER, "left", profile)
    return exclude.waterfall(
        limited,
        [
            ("bad trials", F.col("f1")),
            ("invalid", F.col("f2")),
            ("orientation", F.col("f3")),
            ("slow", F.col("value") > F.col("m") + 3 * F.col("sd")),
        ],
    )


@query(
    "retention",
    """
    SELECT event_type, count(*) AS "rows", count(*) FILTER (value < 100) AS rows_kept,
           round(100.0 * count(*) FILTER (value < 100) / count(*), 6) AS pct_kept
    FROM events GROUP BY 1
    """,
)
def retention(spark, d):
    out = summarise.retention(table(spark, d, "events"), F.col("value") < 100, ["event_type"])
    return rounded(out, "pct_kept")


# --- order --------------------------------------------------------------------------------------


@query(
    "carry_forward",
    """
    SELECT conv_id, turn, role,
           last_value(CASE WHEN role <> 'assistant' THEN length(text) END IGNORE NULLS) OVER
             (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt_length
    FROM conversations
    """,
)
def carry_forward(spark, d):
    c = table(spark, d, "conversations").withColumn(
        "prompt_length",
        F.when(F.col("role") != "assistant", F.char_length("text").cast("long")),
    )
    filled = order.carry_forward(c, ["conv_id"], "turn", "prompt_length")
    return filled.select("conv_id", "turn", "role", "prompt_length")


@query(
    "cycle_number",
    """
    SELECT event_id, user_id,
           (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 8 + 1 AS trial_number
    FROM events
    """,
)
def cycle_number(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return order.cycle_number(e, USER, "event_id", 8)


@query(
    "center_by",
    """
    WITH a AS (SELECT event_id, event_type, value, value - avg(value) OVER (PARTITION BY user_id)
                      AS c FROM events)
    SELECT event_id, round(c + avg(value) OVER (PARTITION BY event_type), 6) AS value_norm FROM a
    """,
)
def center_by(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    out = order.center_by(e, USER, "value", "value_norm", add_back=["event_type"])
    return rounded(out.select("event_id", "value_norm"), "value_norm")


@query(
    "display_order",
    """
    SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1
             WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS position,
           count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def display_order(spark, d):
    levels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    n = summarise.value_counts(table(spark, d, "orders"), ["o_orderpriority"])
    return order.display_rank(n, "o_orderpriority", levels, "position")


# --- summaries ----------------------------------------------------------------------------------


@query(
    "contingency",
    """
    WITH d AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT * FROM (SELECT DISTINCT lang FROM d), (SELECT DISTINCT source FROM d),
                        (SELECT DISTINCT quality FROM d)),
    c AS (SELECT lang, source, quality, count(*) AS n FROM d GROUP BY 1, 2, 3)
    SELECT lang, source, quality, coalesce(n, 0) AS n FROM g LEFT JOIN c
      USING (lang, source, quality)
    """,
)
def contingency(spark, d):
    """All language x source x quality cells; unlabelled documents have no cell."""
    return summarise.contingency(labelled(spark, d), ["lang", "source", "quality"])


@query(
    "contingency_orders",
    """
    SELECT o_orderstatus, o_orderpriority, c_mktsegment, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
    """,
)
def contingency_orders(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    segment = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    joined = lookup_join(orders, segment, ["o_custkey"], "inner")
    return summarise.contingency(joined, ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


@query(
    "contingency_wide",
    """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F",
           count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
    FROM orders GROUP BY 1
    """,
)
def contingency_wide(spark, d):
    return summarise.contingency_wide(
        table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"]
    )


@query(
    "value_counts",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def value_counts(spark, d):
    return summarise.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "count_distinct",
    """
    SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1
    """,
)
def count_distinct(spark, d):
    # distinct pairs first: the second step then counts, and no group is gathered
    pairs = table(spark, d, "events").groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return pairs.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("users"), F.sum("_n").alias("n")
    )


@query(
    "five_number",
    """
    SELECT event_type, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median,
           quantile_cont(v, 0.75) AS q3, max(v) AS max, round(avg(v), 6) AS mean,
           count(*) FILTER (v IS NULL) AS n_missing
    FROM (SELECT event_type, CASE WHEN value >= 1 THEN value END AS v FROM events) GROUP BY 1
    """.replace("quantile_cont(v, 0.25)", "round(quantile_cont(v, 0.25), 6)").replace(
        "median(v) AS", "round(median(v), 6) AS"
    ).replace("quantile_cont(v, 0.75)", "round(quantile_cont(v, 0.75), 6)"),
)
def five_number(spark, d):
    v = F.when(F.col("value") >= 1, F.col("value"))
    e = table(spark, d, "events").select("event_type", v.alias("v"))
    return rounded(summarise.five_number(e, ["event_type"], "v"), "q1", "median", "q3", "mean")


@query(
    "five_number_sliced",
    """
    SELECT min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
           round(median(o_totalprice), 6) AS median,
           round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS max,
           round(avg(o_totalprice), 6) AS mean, 0::BIGINT AS n_missing
    FROM orders
    """,
)
def five_number_sliced(spark, d):
    """One group over the whole table by the sliced way large groups take."""
    o = table(spark, d, "orders")
    out = summarise.five_number(o, [], "o_totalprice", group_limit=0)
    return rounded(out, "q1", "median", "q3", "mean")


@query(
    "median_by",
    """
    SELECT user_id, event_type, round(median(value), 6) AS median FROM events GROUP BY 1, 2
    """,
)
def median_by(spark, d):
    out = quantiles.group_quantiles(
        table(spark, d, "events"), ["user_id", "event_type"], "value", {"median": 0.5}
    )
    return rounded(out, "median")


@query(
    "two_stage_mean",
    """
    WITH u AS (SELECT user_id, event_type, 100 * avg(value) AS v FROM events GROUP BY 1, 2)
    SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n FROM u GROUP BY 1
    """,
)
def two_stage_mean(spark, d):
    out = summarise.multi_stage(
        table(spark, d, "events"), [["user_id", "event_type"]], ["event_type"], "value", 100.0
    )
    return rounded(out, "mean", "sd", "se")


@query(
    "three_stage_mean",
    f"""
    WITH a AS (SELECT user_id, {K} // 10 AS band, event_type, avg(value) AS v FROM events
               GROUP BY 1, 2, 3),
    b AS (SELECT user_id, event_type, avg(v) AS v FROM a GROUP BY 1, 2)
    SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n FROM b GROUP BY 1
    """,
)
def three_stage_mean(spark, d):
    e = with_k(table(spark, d, "events")).withColumn("band", F.floor(F.col("k") / 10))
    stages = [["user_id", "band", "event_type"], ["user_id", "event_type"]]
    return rounded(summarise.multi_stage(e, stages, ["event_type"], "value"), "mean", "sd", "se")


@query(
    "global_two_stage",
    """
    WITH u AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1)
    SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n FROM u
    """,
)
def global_two_stage(spark, d):
    out = summarise.multi_stage(table(spark, d, "events"), [USER], [], "value")
    return rounded(out, "mean", "sd", "se")


@query(
    "summary_family",
    """
    WITH b AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_discount AS v FROM lineitem),
    u AS (SELECT 'l_returnflag' AS g, l_suppkey, l_returnflag, NULL AS l_linestatus, avg(v) AS v
          FROM b GROUP BY 2, 3
          UNION ALL SELECT 'l_linestatus', l_suppkey, NULL, l_linestatus, avg(v) FROM b GROUP BY 2, 4
          UNION ALL SELECT 'l_returnflag x l_linestatus', l_suppkey, l_returnflag, l_linestatus,
                           avg(v) FROM b GROUP BY 2, 3, 4
          UNION ALL SELECT '', l_suppkey, NULL, NULL, avg(v) FROM b GROUP BY 2)
    SELECT g AS grouping, l_returnflag, l_linestatus, round(avg(v), 6) AS mean,
           round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS se,
           count(*) AS n
    FROM u GROUP BY 1, 2, 3
    """,
)
def summary_family(spark, d):
    """Supplier means, then group summaries, for four groupings in one pass."""
    out = summarise.summary_family(
        table(spark, d, "lineitem"),
        ["l_suppkey"],
        [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"], []],
        "l_discount",
    )
    return rounded(out, "mean", "sd", "se")


@query(
    "rounded_report",
    """
    WITH u AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
    SELECT event_type, round_even(avg(v), 1) AS mean, round_even(stddev_samp(v), 1) AS sd
    FROM u GROUP BY 1
    """,
)
def rounded_report(spark, d):
    out = summarise.multi_stage(
        table(spark, d, "events"), [["user_id", "event_type"]], ["event_type"], "value"
    )
    return out.select("event_type", F.bround("mean", 1).alias("mean"), F.bround("sd", 1).alias("sd"))


@query(
    "within_subject_se",
    """
    WITH c AS (SELECT user_id, event_type, median(value) AS v FROM events GROUP BY 1, 2),
    n AS (SELECT event_type, v, v - avg(v) OVER (PARTITION BY user_id) AS z FROM c)
    SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS se,
           round(stddev_samp(z) / sqrt(count(*)), 6) AS se_norm,
           round(1.96 * stddev_samp(z) / sqrt(count(*)), 6) AS ci_norm, count(*) AS n
    FROM n GROUP BY 1
    """,
)
def within_subject_se(spark, d):
    out = summarise.within_subject_se(table(spark, d, "events"), USER, ["event_type"], "value")
    return rounded(out, "mean", "se", "se_norm", "ci_norm")


@query(
    "rating_distribution",
    f"""
    SELECT event_type, 3 - {K} % 7 AS score, count(*) AS n FROM events GROUP BY 1, 2
    """,
)
def rating_distribution(spark, d):
    e = with_k(table(spark, d, "events"))
    e = e.withColumn("score", likert_score(F.col("k") % 7, F.lit(False)))
    return summarise.value_counts(e, ["event_type", "score"])


@query(
    "accuracy_rt",
    f"""
    SELECT event_type, round(avg(({K} % 2 = event_id % 2)::INT), 6) AS mean_flag,
           round(avg(value), 6) AS mean_value, count(*) AS n
    FROM events WHERE value < 100 GROUP BY 1
    """,
)
def accuracy_rt(spark, d):
    e = with_k(table(spark, d, "events"))
    e = e.withColumn("correct", button_correct(F.col("k") % 2, F.col("event_id") % 2))
    out = summarise.accuracy_rt(e, ["event_type"], "correct", "value", F.col("value") < 100)
    return rounded(out, "mean_flag", "mean_value")


@query(
    "cutoff_sensitivity",
    """
    SELECT event_type, c AS cutoff, count(*) FILTER (value < c) AS kept,
           round(count(*) FILTER (value < c) / count(*), 6) AS kept_share,
           round(avg(value) FILTER (value < c), 6) AS mean_kept
    FROM events, (VALUES (50.0::DOUBLE), (100.0::DOUBLE), (150.0::DOUBLE)) v(c) GROUP BY 1, 2
    """,
)
def cutoff_sensitivity(spark, d):
    out = summarise.cutoff_sensitivity(
        table(spark, d, "events"), "value", [50, 100, 150], ["event_type"]
    )
    return rounded(out, "kept_share", "mean_kept")


@query(
    "item_subset",
    """
    WITH s AS (SELECT d.source, d.lang, l.quality, d.n_chars FROM documents d LEFT JOIN labels l
               USING (doc_id)
               WHERE coalesce(d.source NOT IN ('src1', 'src2'), TRUE)
                 AND coalesce(l.quality NOT IN (0), TRUE)),
    u AS (SELECT source, lang, avg(n_chars) AS v FROM s GROUP BY 1, 2)
    SELECT lang, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n
    FROM u GROUP BY 1
    """,
)
def item_subset(spark, d):
    """Summary without ambiguous items: membership in either of two columns removes a row."""
    s = labelled(spark, d).filter(not_in("source", ["src1", "src2"]) & not_in("quality", [0]))
    out = summarise.multi_stage(s, [["source", "lang"]], ["lang"], "n_chars")
    return rounded(out, "mean", "sd", "se")


# --- recoding, unions, key sets -------------------------------------------------------------------


@query(
    "recode_map",
    """
    SELECT CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'plain'
                WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'sized' END AS valence,
           count(*) AS n
    FROM part GROUP BY 1
    """,
)
def recode_map(spark, d):
    """Value -> category by a small table; values not in it are missing."""
    mapping = spark.createDataFrame(
        [("ECONOMY", "plain"), ("STANDARD", "plain"), ("SMALL", "sized"), ("MEDIUM", "sized"),
         ("LARGE", "sized")],
        "p_type string, valence string",
    )
    coded = derive.recode_by_table(table(spark, d, "part"), mapping, "p_type", "valence")
    return summarise.value_counts(coded, ["valence"])


def with_region(spark, d, df: DataFrame, nation_key: str, name: str) -> DataFrame:
    """Add the lower-case region name of a nation key."""
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias(nation_key), F.lower("r_name").alias(name)
    )
    return lookup_join(df, names, [nation_key])


@query(
    "cross_label",
    """
    SELECT CASE WHEN c_mktsegment = 'BUILDING' AND r_name = 'ASIA' THEN 'Building_Asia'
                WHEN c_mktsegment = 'BUILDING' AND r_name = 'EUROPE' THEN 'Building_Europe'
                WHEN c_mktsegment = 'MACHINERY' AND r_name = 'ASIA' THEN 'Machinery_Asia'
                WHEN c_mktsegment = 'MACHINERY' AND r_name = 'EUROPE' THEN 'Machinery_Europe' END
             AS label, count(*) AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1
    """,
)
def cross_labels(spark, d):
    c = with_region(spark, d, table(spark, d, "customer"), "c_nationkey", "region")
    label = cross_label(
        ["c_mktsegment", "region"],
        {
            ("BUILDING", "asia"): "Building_Asia",
            ("BUILDING", "europe"): "Building_Europe",
            ("MACHINERY", "asia"): "Machinery_Asia",
            ("MACHINERY", "europe"): "Machinery_Europe",
        },
    )
    return c.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_union",
    """
    WITH u AS (SELECT 'customer ' || c_custkey AS unit, c_nationkey AS nation,
                      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'heavy'
                           ELSE 'light' END AS kind, c_acctbal AS balance FROM customer
               UNION ALL
               SELECT 'supplier ' || s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier)
    SELECT nation, kind, count(*) AS n, count(DISTINCT unit) AS units,
           round(sum(balance), 4) AS balance FROM u GROUP BY 1, 2
    """,
)
def label_union(spark, d):
    """Tables with different columns united by name, labels unified, composite unit key."""
    heavy = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    c = table(spark, d, "customer").select(
        F.lit("customer").alias("study"), F.col("c_custkey").alias("subject"),
        F.col("c_nationkey").alias("nation"), if_else(heavy, "heavy", "light").alias("kind"),
        F.col("c_acctbal").alias("balance"),
    )
    s = table(spark, d, "supplier").select(
        F.lit("supplier").alias("study"), F.col("s_suppkey").alias("subject"),
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
    )
    both = derive.composite_key(union_logs([c, s]), ["study", "subject"], "unit")
    units = both.groupBy("nation", "kind", "unit").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("balance").alias("_b")
    )
    return units.groupBy("nation", "kind").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("units"),
        F.round(F.sum("_b"), 4).alias("balance"),
    )


@query(
    "corrections",
    """
    SELECT event_id, CASE WHEN user_id = 3 THEN 'click' ELSE event_type END AS event_type,
           CASE WHEN user_id = 3 THEN 1.5 WHEN user_id = 11 THEN 2.5 ELSE value END AS value
    FROM events
    """,
)
def corrections(spark, d):
    fixes = spark.createDataFrame(
        [(3, "click", 1.5), (11, None, 2.5)], "user_id bigint, event_type string, value double"
    )
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return derive.apply_corrections(e, fixes, USER).select("event_id", "event_type", "value")


@query(
    "compare_keys",
    """
    SELECT doc_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS "where"
    FROM (SELECT doc_id, bool_or(src = 1) AS a, bool_or(src = 2) AS b
          FROM (SELECT doc_id, 1 AS src FROM documents UNION ALL SELECT doc_id, 2 FROM labels)
          GROUP BY 1)
    """,
)
def compare_keys(spark, d):
    return summarise.compare_key_sets(
        table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]
    )


@query(
    "distinct_keys",
    """SELECT DISTINCT user_id, event_type FROM events""",
)
def distinct_keys(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


@query(
    "natural_join",
    """
    SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    """,
)
def natural_join(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return natural_left_join(orders, people).select("o_orderkey", "c_mktsegment")


@query(
    "column_tools",
    """
    SELECT 'lineitem' AS study, l_orderkey AS subject, l_linenumber AS trial, l_shipdate
    FROM lineitem WHERE l_returnflag = 'R' AND NOT (l_quantity BETWEEN 10 AND 40)
    """,
)
def column_tools(spark, d):
    """Constant tag, renaming, dropping a range of columns, closed range filter."""
    l = table(spark, d, "lineitem")
    l = l.filter((F.col("l_returnflag") == "R") & ~F.col("l_quantity").between(10, 40))
    l = derive.drop_range(l, "l_quantity", "l_linestatus").drop("l_partkey", "l_suppkey")
    l = l.withColumnsRenamed({"l_orderkey": "subject", "l_linenumber": "trial"})
    return l.select(F.lit("lineitem").alias("study"), "subject", "trial", "l_shipdate")


@query(
    "pseudonymise",
    """
    SELECT c_custkey, 'anonymised' AS c_name, sha256(c_mktsegment) AS c_mktsegment FROM customer
    """,
)
def pseudonymised(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return pseudonymise(pseudonymise(c, ["c_name"]), ["c_mktsegment"], how="sha2")


@query(
    "csv_log_scan",
    """
    SELECT event_type, role, count(*) AS n, count(rt) AS n_rt, round(sum(rt), 4) AS total
    FROM (SELECT event_type, NULL AS role, value AS rt FROM events
          UNION ALL SELECT NULL, role, NULL FROM conversations) GROUP BY 1, 2
    """,
)
def csv_log_scan(spark, d):
    """Logs with different headers written as CSV, read back as text and united by name."""
    events = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.col("value").alias("rt"), "props"
    )
    talk = table(spark, d, "conversations").select("conv_id", "turn", "role")
    folders = []
    for name, part in (("events", events), ("talk", talk)):
        path = scratch_path(spark, name)
        write_csv(part, path)
        folders.append((path, part.columns))
    parts = [read_log(spark, path, columns) for path, columns in folders]
    log = union_logs(parts).withColumn("rt", num("rt"))
    return log.groupBy("event_type", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count("rt").alias("n_rt"),
        F.round(F.sum("rt"), 4).alias("total"),
    )


# --- matches --------------------------------------------------------------------------------------

SALES_SQL = """
    sales AS (SELECT l.l_returnflag, l.l_orderkey, l.l_linenumber, c.c_custkey, c.c_mktsegment,
                     cn.n_name AS ppt_race, cr.r_name AS ppt_gender, sn.n_name AS actor_race,
                     sr.r_name AS actor_gender
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
              JOIN customer c ON o.o_custkey = c.c_custkey
              JOIN nation cn ON c.c_nationkey = cn.n_nationkey
              JOIN region cr ON cn.n_regionkey = cr.r_regionkey
              JOIN supplier s ON l.l_suppkey = s.s_suppkey
              JOIN nation sn ON s.s_nationkey = sn.n_nationkey
              JOIN region sr ON sn.n_regionkey = sr.r_regionkey)
"""


def sales(spark, d) -> DataFrame:
    """Line items with nation (as race) and region (as gender) of customer and of supplier."""
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )
    # row counts and profiles are taken from the stored tables, not from what is joined of them
    size = {t: table(spark, d, t).count() for t in ("nation", "customer", "orders", "supplier")}
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"
    )
    people = lookup_join(
        people, places.toDF("c_nationkey", "ppt_race", "ppt_gender"), ["c_nationkey"],
        rows=size["nation"],
    )
    actors = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    actors = lookup_join(
        actors, places.toDF("s_nationkey", "actor_race", "actor_gender"), ["s_nationkey"],
        rows=size["nation"],
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    orders = lookup_join(orders, people, ["o_custkey"], "inner", size["customer"])
    stored = table(spark, d, "lineitem")
    lines = stored.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    lines = lookup_join(lines, orders, ["l_orderkey"], "inner", size["orders"])
    return lookup_join(lines, actors, ["l_suppkey"], "inner", size["supplier"]).withColumnRenamed("o_custkey", "c_custkey")


@query(
    "like_me",
    f"""
    WITH {SALES_SQL},
    u AS (SELECT c_custkey, c_mktsegment,
                 100 * avg(CASE WHEN l_returnflag = 'R' THEN (ppt_race = actor_race)::INT
                                ELSE (ppt_gender = actor_gender)::INT END) AS v
          FROM sales GROUP BY 1, 2)
    SELECT c_mktsegment, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd,
           round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n
    FROM u GROUP BY 1
    """,
)
def like_me(spark, d):
    s = derive.like_me(
        sales(spark, d), "actor_gender", "actor_race", use_race=F.col("l_returnflag") == "R"
    )
    out = summarise.multi_stage(
        s, [["c_custkey", "c_mktsegment"]], ["c_mktsegment"], "OverallLikeMe", 100.0
    )
    return rounded(out, "mean", "sd", "se")


@query(
    "match_class",
    f"""
    WITH {SALES_SQL}
    SELECT CASE WHEN ppt_gender = actor_gender THEN 'Gender Match' ELSE 'Gender No-Match' END
             || ' / ' || CASE WHEN ppt_race = actor_race THEN 'Race Match' ELSE 'Race No-Match' END
             AS feature,
           1 - (ppt_gender = actor_gender)::INT - (ppt_race = actor_race)::INT AS score,
           count(*) AS n
    FROM sales GROUP BY 1, 2
    """,
)
def match_classes(spark, d):
    g = F.col("ppt_gender") == F.col("actor_gender")
    r = F.col("ppt_race") == F.col("actor_race")
    return sales(spark, d).groupBy(
        match_class(g, r).alias("feature"), match_score(g, r).alias("score")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "trial_types",
    f"""
    WITH {SALES_SQL}
    SELECT CASE WHEN ppt_gender = actor_gender THEN 'RaceTrial' ELSE 'GenderTrial' END AS "TrialType",
           CASE WHEN ppt_race = 'black' AND actor_race = 'black' THEN 'BlackTrial'
                ELSE 'WhiteTrial' END AS "GenderTrialType",
           CASE WHEN ppt_gender = 'woman' AND actor_gender = 'woman' THEN 'WomanTrial'
                ELSE 'ManTrial' END AS "RaceTrialType", count(*) AS n
    FROM sales GROUP BY 1, 2, 3
    """,
)
def trial_types(spark, d):
    s = sales(spark, d).withColumnsRenamed({
        "ppt_gender": "left_gender", "ppt_race": "left_race",
        "actor_gender": "right_gender", "actor_race": "right_race",
    })
    return summarise.value_counts(
        derive.trial_types(s), ["TrialType", "GenderTrialType", "RaceTrialType"]
    )


@query(
    "memory_trials",
    f"""
    WITH {BAD_UNITS_SQL}, {SHARES_SQL},
    o AS (SELECT user_id FROM b WHERE NOT (bias BETWEEN 0.4 AND 0.6)),
    t AS (SELECT * FROM events WHERE user_id NOT IN (SELECT user_id FROM x)
            AND user_id NOT IN (SELECT user_id FROM o))
    SELECT 'naming' AS study, event_id, user_id, value FROM t WHERE event_type = 'click'
    UNION ALL SELECT 'other', event_id, user_id, value FROM t WHERE event_type = 'view'
    """,
)
def memory_trials(spark, d):
    """Trials of another task, of the participants surviving the first two exclusion rules."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    profile = profile_units(e, USER)
    biased = exclude.by_share_bounds(shares(spark, d), USER, 0.4, 0.6)
    parts = []
    for study, kind in (("naming", "click"), ("other", "view")):
        t = e.filter(F.col("event_type") == kind)
        t = exclude.remove_units(t, bad_units(e), USER, profile)
        t = exclude.remove_units(t, biased, USER, profile)
        parts.append(t.select(F.lit(study).alias("study"), "event_id", "user_id", "value"))
    return union_logs(parts)


@query(
    "participant_answers",
    """
    SELECT user_id, event_id, json_extract_string(props, '$.k') AS age, NULL::VARCHAR AS gender
    FROM events WHERE event_type = 'signup'
    """,
)
def participant_answers(spark, d):
    """Questionnaire rows with their answers as columns; a question never asked is missing."""
    return exclude.participant_answers(
        table(spark, d, "events"), USER, {"k": "age", "Q5": "gender"},
        F.col("event_type") == "signup", "props", ["event_id"],
    )


@query(
    "orientation_shares",
    f"""
    WITH {SHARES_SQL}
    SELECT user_id, round(l, 6) AS left_share, round(r, 6) AS right_share,
           round(bias, 6) AS orientation_bias FROM b
    """,
)
def orientation_shares(spark, d):
    return rounded(shares(spark, d), "left_share", "right_share", "orientation_bias")


@query(
    "memory_features",
    """
    WITH g AS (SELECT o_totalprice AS rt,
                      CASE o_orderpriority WHEN '1-URGENT' THEN 'WW1.jpg' WHEN '2-HIGH' THEN 'WM2.jpg'
                           WHEN '3-MEDIUM' THEN 'BW1.jpg' ELSE 'BM1.jpg' END AS stimulus,
                      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'woman' ELSE 'man' END
                        AS pg, CASE WHEN c_acctbal < 5000 THEN 'white' ELSE 'black' END AS pr,
                      CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'FALSE' END AS fg,
                      o_orderkey % 2 AS pressed, o_custkey % 2 AS correct
               FROM orders JOIN customer ON o_custkey = c_custkey),
    h AS (SELECT *, CASE WHEN regexp_matches(stimulus, 'W[1-2].jpg') THEN 'woman' ELSE 'man' END AS g,
                 CASE WHEN regexp_matches(stimulus, 'W[MW][1-2].jpg') THEN 'white' ELSE 'black' END
                   AS r FROM g)
    SELECT CASE WHEN pg = g THEN 'Gender Match' ELSE 'Gender No-Match' END || ' / ' ||
           CASE WHEN pr = r THEN 'Race Match' ELSE 'Race No-Match' END AS "LikeMeFeature",
           1 - (pg = g)::INT - (pr = r)::INT AS "LikeMeFeatureNumeric",
           sum((fg = 'TRUE')::INT)::BIGINT AS first_guesses,
           sum((pressed = correct)::INT)::BIGINT AS correct,
           sum((pg = g AND pr = r)::INT)::BIGINT AS overall, count(*) AS n,
           round(avg(rt), 4) AS mean_rt
    FROM h GROUP BY 1, 2
    """,
)
def memory_features(spark, d):
    """Actor attributes from picture names, match flags, class and score; orders as the game."""
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        if_else(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "woman", "man").alias(
            "ppt_gender"
        ),
        if_else(F.col("c_acctbal") < 5000, "white", "black").alias("ppt_race"),
    )
    pictures = {"1-URGENT": "WW1.jpg", "2-HIGH": "WM2.jpg", "3-MEDIUM": "BW1.jpg"}
    game = table(spark, d, "orders").select(
        "o_custkey",
        F.col("o_totalprice").alias("rt"),
        map_values("o_orderpriority", pictures, "BM1.jpg").alias("stimulus"),
        map_values("o_orderstatus", {"F": "TRUE", "O": "FALSE"}).alias("first_guess"),
        (F.col("o_orderkey") % 2).alias("button_pressed"),
        (F.col("o_custkey") % 2).alias("correct"),
    )
    game = lookup_join(game, people, ["o_custkey"], "inner")
    return (
        derive.memory_match_features(game)
        .groupBy("LikeMeFeature", "LikeMeFeatureNumeric")
        .agg(
            F.sum("first_guess_num").alias("first_guesses"),
            F.sum("correct_response").alias("correct"),
            F.sum("OverallLikeMe").alias("overall"),
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("rt"), 4).alias("mean_rt"),
        )
    )


# --- resampling -----------------------------------------------------------------------------------

BOOT_SQL = """
    u AS ({units}),
    k AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY md5(id), id) - 1 AS i,
                 count(*) OVER (PARTITION BY g) AS n FROM u),
    s AS (SELECT DISTINCT g, n FROM k),
    d AS (SELECT g, n, b, ('0x' || substr(md5(concat_ws(':', '{seed}', g, b::VARCHAR,
                 (j // 4)::VARCHAR)), (8 * (j % 4) + 1)::INT, 8))::BIGINT % n AS i
          FROM s, range({replicates}) rb(b), range((SELECT max(n) FROM s)) rj(j) WHERE j < n),
    m AS (SELECT d.g, d.n, b, avg(v) AS m FROM d JOIN k ON k.g = d.g AND k.i = d.i GROUP BY 1, 2, 3),
    ci AS (SELECT g, n, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high
           FROM m GROUP BY 1, 2)
"""


@query(
    "bootstrap_ci",
    "WITH "
    + BOOT_SQL.format(
        units="SELECT event_type AS g, user_id::VARCHAR AS id, avg(value) AS v FROM events "
        "GROUP BY 1, 2",
        seed=999,
        replicates=1000,
    )
    + "SELECT g AS event_type, n, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci",
)
def bootstrap_ci(spark, d):
    means = summarise.stage_means(
        table(spark, d, "events"), [["user_id", "event_type"]], "value"
    )
    ci = bootstrap.percentile_ci(means, ["event_type"], USER, "value")
    return rounded(ci, "ci_low", "ci_high")


@query(
    "bootstrap_missing",
    "WITH "
    + BOOT_SQL.format(
        units="SELECT '' AS g, user_id::VARCHAR AS id, CASE WHEN count(*) = count(v) THEN avg(v) "
        "END AS v FROM (SELECT user_id, CASE WHEN value >= 0.5 THEN value END AS v FROM events) "
        "GROUP BY 2",
        seed=7,
        replicates=200,
    )
    + "SELECT n, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci",
)
def bootstrap_missing(spark, d):
    """One global group whose unit means are partly missing: drawn like the others, not averaged."""
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") >= 0.5, F.col("value")))
    means = summarise.stage_means(e, [USER], "v", na_rm=False)
    return rounded(
        bootstrap.percentile_ci(means, [], USER, "v", replicates=200, seed=7), "ci_low", "ci_high"
    )


@query(
    "group_report",
    "WITH "
    + BOOT_SQL.format(
        units="SELECT role AS g, conv_id::VARCHAR AS id, avg(length(text)) AS v "
        "FROM conversations GROUP BY 1, 2",
        seed=999,
        replicates=300,
    )
    + """
    , a AS (SELECT g, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(count(*)) AS se,
                   count(*) AS n FROM u GROUP BY 1)
    SELECT a.g AS role, round_even(mean, 1) AS mean, round_even(sd, 1) AS sd,
           round_even(se, 1) AS se, a.n, round_even(ci_low, 1) AS ci_low,
           round_even(ci_high, 1) AS ci_high
    FROM a JOIN ci ON a.g = ci.g
    """,
)
def group_report(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "role", F.char_length("text").alias("length")
    )
    return summarise.group_report(
        c, ["conv_id"], ["role"], "length", scale=1.0, replicates=300, digits=1
    )
