"""Queries of the readers, writers and scale paths, each on tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bootstrap, derive, order, summarise
from ..operators.bootstrap import poisson_limits
from ..operators.units import profile_units, unit_join
from ..sources import read_intermediate, read_log, read_lookup, write_csv, write_numbered_csv, write_table
from ..sources.logs import read_mixed
from ..sources.work import scratch_path
from . import production
from .production import VALENCE_FIRST, ProductionStudy
from .table_queries import USER, query, rounded, table

POISSON_SQL = """
    u AS (SELECT event_type AS g, user_id::VARCHAR AS id, CASE WHEN min(value) < 60 THEN avg(value) END AS v
          FROM events GROUP BY 1, 2),
    d AS (SELECT g, v, 4 * q + w AS b,
                 ('0x' || substr(md5(concat_ws(':', '999', g, id, q::VARCHAR)), (8 * w + 1)::INT, 8))::BIGINT AS x
          FROM u, range(250) rq(q), range(4) rw(w)),
    c AS (SELECT g, v, b, {count} AS c FROM d),
    m AS (SELECT g, b, count(*) AS n,
                 sum(c * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN c END), 0) AS m FROM c GROUP BY 1, 2)
    SELECT g AS event_type, n, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
    FROM m GROUP BY 1, 2
""".format(count=" + ".join(f"(x >= {limit})::INT" for limit in poisson_limits()))


@query("bootstrap_poisson", "WITH " + POISSON_SQL)
def bootstrap_poisson(spark, d):
    """Intervals of user means per type from one pass; some users' means are missing."""
    e = table(spark, d, "events")
    seen = F.when(F.min("value") < 60, F.avg("value"))
    means = e.groupBy("user_id", "event_type").agg(seen.alias("v"))
    return rounded(bootstrap.poisson_ci(means, ["event_type"], USER, "v"), "ci_low", "ci_high")


@query(
    "hot_unit_join",
    """
    WITH s AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_id, round(value - m, 6) AS away FROM events JOIN s USING (user_id, event_type) WHERE n > 3
    """,
)
def hot_unit_join(spark, d):
    """Rows beside aggregates of their (user, type), on the way for a unit table too large to broadcast
    and units of more rows than a task should get (here above ten): keys of two columns, salted by row number."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    keys = ["user_id", "event_type"]
    side = e.groupBy(*keys).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 3")
    profile = profile_units(e, keys, rows_per_task=10, broadcast_bytes=0)
    joined = unit_join(e, side, keys, "inner", profile)
    return joined.select("event_id", F.round(F.col("value") - F.col("m"), 6).alias("away"))


@query(
    "chunked_order",
    """
    SELECT event_id, user_id, (row_number() OVER w - 1) % 8 + 1 AS trial_number,
           last_value(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS) OVER
             (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS carried
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    """,
)
def chunked_order(spark, d):
    """Trial numbers and carried values by time stamp, users cut into chunks of about twenty rows."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    profile = profile_units(e, USER, rows_per_task=20, broadcast_bytes=0)
    out = order.cycle_number(e, USER, "ts", 8, profile=profile)
    out = order.carry_forward(out, USER, "ts", "v", "carried", profile)
    return out.select("event_id", "user_id", "trial_number", "carried")


@query(
    "csv_reader",
    """
    SELECT lang, doc_id, n_chars, text, CASE WHEN n_chars % 2 = 0 THEN n_chars END AS even_chars
    FROM (SELECT lang, doc_id, n_chars,
                 CASE WHEN trim(text, ' ') NOT IN ('', 'NA') THEN trim(text, ' ') END AS text
          FROM documents WHERE lang IN ('en', 'de') AND text NOT LIKE '%\t%' AND text NOT LIKE '%' || chr(13) || '%')
    WHERE text IS NOT NULL AND text = trim(text, E' \\n\\t')
    """,
)
def csv_reader(spark, d):
    """Texts with quotes and line breaks written with row numbers, one folder per language, read back by
    file pattern with types; the folder comes from the file path, unreadable numbers become missing."""
    docs = table(spark, d, "documents").filter("lang in ('en', 'de')")
    docs = docs.filter(~F.contains("text", F.lit("\t")) & ~F.contains("text", F.lit("\r")))
    docs = docs.filter(F.col("text") == F.regexp_replace("text", r"^[ \n\t]+|[ \n\t]+$", ""))
    even = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise("odd")
    docs = docs.select("doc_id", "n_chars", "text", even.alias("even_chars"), "lang")
    path = scratch_path(spark, "reader")
    for lang in ("en", "de"):
        write_numbered_csv(docs.filter(F.col("lang") == lang).drop("lang"), f"{path}/{lang}", ["doc_id"])
    types = {"doc_id": "long", "n_chars": "long", "even_chars": "long", "_row": "long"}
    columns = ["_row", "doc_id", "n_chars", "text", "even_chars"]
    log = read_log(spark, path, columns, types, pattern="*.csv", multi_line=True)
    return log.select(F.regexp_extract("id", "/(en|de)/", 1).alias("lang"), *columns[1:]).filter("text is not null")


@query(
    "csv_row_numbers",
    """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders
    """,
)
def csv_row_numbers(spark, d):
    """Consecutive row numbers over many partitions, written and read back; the unnamed column is the row number."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition(7)
    path = scratch_path(spark, "numbered")
    write_numbered_csv(orders, path, ["o_totalprice", "o_orderkey"])
    types = {"_row": "long", "o_orderkey": "long", "o_totalprice": "double"}
    log = read_log(spark, path, ["_row", "o_orderkey", "o_totalprice"], types, id_column=None).withColumnRenamed("_row", "place")
    without = read_intermediate(spark, path, ["o_orderkey", "o_totalprice"], {"o_orderkey": "long"})
    return log.join(without.select("o_orderkey"), "o_orderkey").select("o_orderkey", "o_totalprice", "place")


@query(
    "csv_corrupt_rows",
    """
    SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 10 = 3) AS corrupt,
           count(*) FILTER (event_id % 10 <> 3) AS readable
    FROM events GROUP BY 1
    """,
)
def csv_corrupt_rows(spark, d):
    """Rows of too many cells are kept with their text instead of stopping the read."""
    e = table(spark, d, "events")
    more = F.when(F.col("event_id") % 10 == 3, F.lit(",surplus,cells")).otherwise("")
    lines = e.select(F.concat_ws(",", "event_id", "event_type", "value").alias("v"), more.alias("m"))
    path = scratch_path(spark, "corrupt")
    lines.select(F.concat("v", "m").alias("event_id,event_type,value")).write.option("header", "true").option("sep", "\u0001").csv(path)
    log = read_log(spark, path, ["event_id", "event_type", "value"], corrupt="broken")
    kind = F.coalesce(F.regexp_extract("broken", r"^[0-9]+,([a-z]+),", 1), F.col("event_type"))
    return log.groupBy(kind.alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count("broken").alias("corrupt"),
        F.count_if(F.col("broken").isNull()).alias("readable"),
    )


@query(
    "csv_mixed_headers",
    """
    SELECT source, count(*) AS n, count(rt) AS n_rt, count(role) AS n_role, round(sum(rt), 4) AS total
    FROM (SELECT 'events' AS source, value AS rt, NULL AS role FROM events
          UNION ALL SELECT 'talk', NULL, role FROM conversations
          UNION ALL SELECT 'both', turn::DOUBLE, role FROM conversations) GROUP BY 1
    """,
)
def csv_mixed_headers(spark, d):
    """Files of three headers in one tree: grouped by header in one pass, read and united by name."""
    talk = table(spark, d, "conversations")
    parts = {
        "events": table(spark, d, "events").select("event_id", F.col("value").alias("rt")),
        "talk": talk.select("role", "turn"),
        "both": talk.select(F.col("turn").alias("rt"), "role"),
    }
    path = scratch_path(spark, "mixed")
    for name, part in parts.items():
        write_csv(part, f"{path}/{name}")
    log = read_mixed(spark, path, {"rt": "double"}, pattern="*.csv")
    return log.groupBy(F.regexp_extract("id", "/(events|talk|both)/", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count("rt").alias("n_rt"), F.count("role").alias("n_role"),
        F.round(F.sum("rt"), 4).alias("total"),
    )


@query(
    "csv_lookup",
    "SELECT lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_partkey, length(p_type) AS width FROM part",
)
def csv_lookup(spark, d):
    """A lookup read from CSV with two columns in lower case and one computed."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    path = scratch_path(spark, "lookup")
    write_csv(part, path)
    found = read_lookup(
        spark, path, ["p_partkey", "p_brand", "p_type"], lower=["p_brand", "p_type"],
        computed={"p_partkey": F.col("p_partkey").cast("long"), "width": F.length("p_type").cast("long")},
    )
    return found.select("p_brand", "p_type", "p_partkey", "width")


@query(
    "partition_overwrite",
    """
    SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_type IN ('click', 'view') THEN -value ELSE value END), 4) AS total
    FROM events GROUP BY 1
    """,
)
def partition_overwrite(spark, d):
    """A partitioned table of which two partitions are written anew, read back."""
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    path = scratch_path(spark, "partitioned")
    write_table(e, path, ["event_type"])
    again = e.filter(F.col("event_type").isin("click", "view")).withColumn("value", -F.col("value"))
    write_table(again.select("event_id", "value", "event_type"), path, ["event_type"], mode="overwrite")
    back = spark.read.parquet(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


MESSY_SQL = """
    messy AS (SELECT event_id, event_type,
                     CASE event_id % 6 WHEN 0 THEN substr(props, 1, length(props) - 1)
                                       WHEN 1 THEN '{"k": null}'
                                       WHEN 2 THEN '{"k": 5, "more": {"deep": ' || props || '}}'
                                       WHEN 3 THEN NULL
                                       ELSE props END AS answer FROM events)
"""


def messy(spark, d):
    """Answers of which some are cut off, empty, nested or missing."""
    e = table(spark, d, "events")
    kind = F.col("event_id") % 6
    nested = F.concat(F.lit('{"k": 5, "more": {"deep": '), F.col("props"), F.lit("}}"))
    answer = (
        F.when(kind == 0, F.expr("substring(props, 1, length(props) - 1)"))
        .when(kind == 1, F.lit('{"k": null}')).when(kind == 2, nested)
        .when(kind == 3, F.lit(None)).otherwise(F.col("props"))
    )
    return e.select("event_id", "event_type", answer.alias("answer"))


@query(
    "json_quality",
    "WITH " + MESSY_SQL + """,
    read AS (SELECT event_type, answer, CASE WHEN json_valid(answer) THEN answer END AS good FROM messy)
    SELECT event_type, count(answer) - count(good) AS corrupt,
           count(*) FILTER (json_extract_string(good, '$.k') IS NOT NULL AND len(json_keys(good)) = 1) AS round_trips,
           sum(json_extract_string(good, '$.k')::BIGINT)::BIGINT AS total
    FROM read GROUP BY 1
    """,
)
def json_quality(spark, d):
    """Unreadable answers keep their text beside the parsed fields; which answers come back unchanged."""
    rows = messy(spark, d)
    fields = {"k": "bigint"}
    rows = rows.select("event_type", text.parsed_answer("answer", fields).alias("a"), text.round_trips("answer", fields).alias("same"))
    return rows.groupBy("event_type").agg(
        F.count(F.col("a")[text.CORRUPT]).alias("corrupt"),
        F.count_if("same").alias("round_trips"), F.sum("a.k").alias("total"),
    )


@query(
    "json_fields",
    "WITH " + MESSY_SQL + """
    SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(answer)) AS field FROM messy WHERE json_valid(answer)) GROUP BY 1
    """,
)
def json_fields(spark, d):
    """Names of the fields that occur, with counts."""
    return text.discovered_fields(messy(spark, d), "answer")


MENTION_SQL = """
    t AS (SELECT doc_id, lower(text) AS text, lower(split_part(text, ' ', 5)) AS l, lower(split_part(text, ' ', 3)) AS r
          FROM documents WHERE text NOT LIKE '%' || chr(10) || '%' OR length(split_part(text, ' ', 5)) > 0)
"""


@query(
    "column_mention",
    "WITH " + MENTION_SQL + """
    SELECT doc_id, contains(text, l) AS left_there, contains(text, r || 'x') AS right_there,
           CASE WHEN contains(text, l) AND contains(text, r) THEN instr(text, l) < instr(text, r) END AS left_first
    FROM t WHERE l <> '' AND r <> ''
    """,
)
def column_mention(spark, d):
    """Containment and place of texts of other columns, which differ from row to row."""
    docs = table(spark, d, "documents")
    part = lambda n: F.lower(F.split_part("text", F.lit(" "), F.lit(n)))
    t = docs.select("doc_id", F.lower("text").alias("text"), part(5).alias("l"), part(3).alias("r"))
    t = t.filter("l <> '' and r <> ''").withColumn("rx", F.concat("r", F.lit("x")))
    both = derive.contains_text("text", "l") & derive.contains_text("text", "r")
    first = derive.place_of_text("text", "l") < derive.place_of_text("text", "r")
    return t.select(
        "doc_id", derive.contains_text("text", "l").alias("left_there"),
        derive.contains_text("text", "rx").alias("right_there"), F.when(both, first).alias("left_first"),
    )


@query(
    "trial_subtypes",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'woman' ELSE 'man' END AS lg,
                      CASE WHEN l_suppkey % 2 = 0 THEN 'woman' ELSE 'man' END AS rg,
                      CASE WHEN l_partkey % 3 = 0 THEN 'black' ELSE 'white' END AS lr,
                      CASE WHEN l_suppkey % 3 = 0 THEN 'black' ELSE 'white' END AS rr FROM lineitem)
    SELECT CASE WHEN lg = rg THEN 'RaceTrial' ELSE 'GenderTrial' END AS trial,
           CASE WHEN lr = 'black' AND rr = 'black' THEN 'BlackTrial' ELSE 'WhiteTrial' END AS race,
           CASE WHEN lg = 'woman' AND rg = 'woman' THEN 'WomanTrial' ELSE 'ManTrial' END AS gender, count(*) AS n
    FROM a GROUP BY 1, 2, 3
    """,
)
def trial_subtypes(spark, d):
    """Trial types and both sub-types from four attributes that take all their values."""
    pick = lambda c, n, yes, no: F.when(F.col(c) % n == 0, yes).otherwise(no)
    rows = table(spark, d, "lineitem").select(
        pick("l_partkey", 2, "woman", "man").alias("left_gender"), pick("l_suppkey", 2, "woman", "man").alias("right_gender"),
        pick("l_partkey", 3, "black", "white").alias("left_race"), pick("l_suppkey", 3, "black", "white").alias("right_race"),
    )
    rows = derive.trial_types(rows)
    names = [F.col("TrialType").alias("trial"), F.col("GenderTrialType").alias("race"), F.col("RaceTrialType").alias("gender")]
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_characters",
    "SELECT p_type, replace(p_type, ' ', '_') AS label, replace(replace(p_type, ' ', '_'), '_', ' ') AS back, replace(p_type, ' BRUSHED', '') AS short FROM part",
)
def label_characters(spark, d):
    """Characters of labels replaced, and a suffix removed."""
    label = text.replace_literals(F.col("p_type"), {" ": "_"})
    return table(spark, d, "part").select(
        "p_type", label.alias("label"), text.replace_literals(label, {"_": " "}).alias("back"),
        text.strip_literals(F.col("p_type"), [" BRUSHED"]).alias("short"),
    )


@query(
    "contingency_exact",
    """
    WITH g AS (SELECT * FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT k FROM e), (SELECT DISTINCT event_type FROM events)),
    c AS (SELECT user_id, k, event_type, count(*) AS n FROM e GROUP BY 1, 2, 3)
    SELECT event_type, count(*) AS cells, count(*) FILTER (coalesce(n, 0) = 0) AS empty, sum(coalesce(n, 0))::BIGINT AS n
    FROM g LEFT JOIN c USING (user_id, k, event_type) GROUP BY 1
    """.replace("WITH g", "WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::INT AS k, event_type FROM events), g"),
)
def contingency_exact(spark, d):
    """A large, mostly empty table of counts, its grid built on the cluster; summed per type."""
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    cells = summarise.contingency(e, ["user_id", "k", "event_type"])
    return cells.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("n")
    )


# fixed values of the derived log: people on the pictures, and the verbs by number
PEOPLE = (("ann", "woman", "white"), ("bob", "man", "white"), ("eve", "woman", "black"), ("jim", "man", "black"))
VERBS = tuple(VALENCE_FIRST)
STUDY = ProductionStudy("study1", valence=VALENCE_FIRST, bad_limit=14, share_bounds=(0.1, 0.6))

CLEAN_SQL = """
    p AS (SELECT * FROM (VALUES {people}) p(i, name, gender, race)),
    raw AS (SELECT user_id, event_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events),
    t AS (SELECT r.user_id, event_id, value, list_value({verbs})[k % 10 + 1] AS event,
                 CASE WHEN k % 3 = 1 THEN 'conjoined' ELSE 'transitive' END AS syntax,
                 l.name AS l, q.name AS r, l.gender AS lg, q.gender AS rg, o.gender AS pg, o.race AS pr,
                 CASE WHEN r.user_id = 7 OR event_id % 2 = 0 THEN l.name ELSE q.name END
                 || CASE WHEN event_type = 'error' THEN ' waves'
                         WHEN event_type = 'view' AND event_id % 3 = 0 THEN ' hugging ' ELSE ' is hugging ' END
                 || CASE WHEN event_type = 'error' THEN ''
                         WHEN r.user_id = 7 OR event_id % 2 = 0 THEN q.name ELSE l.name END AS said
          FROM raw r JOIN p l ON l.i = k % 10 % 4 JOIN p q ON q.i = (k % 10 + k % 3 + 1) % 4 JOIN p o ON o.i = r.user_id % 4),
    m AS (SELECT *, contains(said, l) AND contains(said, r) AS named,
                 CASE WHEN contains(said, l) AND contains(said, r)
                      THEN CASE WHEN instr(said, l) < instr(said, r) THEN 'left' ELSE 'right' END END AS first,
                 (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 80 + 1 AS trial_number FROM t),
    x AS (SELECT *, NOT (named AND contains(said, 'is')) AS bad FROM m),
    out1 AS (SELECT DISTINCT user_id FROM (SELECT user_id, syntax, count(*) AS n FROM x WHERE bad GROUP BY 1, 2) WHERE n > 14),
    out2 AS (SELECT user_id FROM (SELECT user_id, greatest(avg(coalesce(first = 'left', false)::INT), avg(coalesce(first = 'right', false)::INT)) AS s
                                  FROM x GROUP BY 1) WHERE NOT (s BETWEEN 0.1 AND 0.6)),
    kept AS (SELECT * FROM x WHERE NOT bad AND user_id NOT IN (FROM out1) AND user_id NOT IN (FROM out2)),
    lim AS (SELECT user_id, avg(value) + 3 * stddev_samp(value) AS top FROM kept GROUP BY 1),
    clean AS (SELECT kept.*, CASE first WHEN 'left' THEN lg ELSE rg END AS fg FROM kept JOIN lim USING (user_id)
              WHERE NOT coalesce(value > top, false))
""".format(
    people=", ".join(f"({i}, '{n}', '{g}', '{r}')" for i, (n, g, r) in enumerate(PEOPLE)),
    verbs=", ".join(f"'{v}'" for v in VERBS),
)
VALENCE_SQL = "CASE event " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in VALENCE_FIRST.items()) + " END"


def derived_log(spark, d):
    """A raw log of picture descriptions made of the events, and its stimulus table, in the raters' format."""
    from .table_queries import with_k

    e = with_k(table(spark, d, "events"))
    who = lambda i, c: F.array(*[F.lit(p[c]) for p in PEOPLE])[i.cast("int")]
    k = F.col("k")
    left, right, own = k % 10 % 4, (k % 10 + k % 3 + 1) % 4, F.col("user_id") % 4
    verb = F.concat(F.array(*[F.lit(v) for v in VERBS])[(k % 10).cast("int")], (k % 3).cast("string"))
    side = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    stimuli = e.select(
        verb.alias("verb"), F.concat(F.lit("List"), side).alias("list"), who(left, 0).alias("left"), who(right, 0).alias("right"),
        who(left, 1).alias("left_gender"), who(left, 2).alias("left_race"), who(right, 1).alias("right_gender"),
        who(right, 2).alias("right_race"), F.when(k % 3 == 1, "intransitive").otherwise("transitive").alias("syntax"),
        F.lit("is").alias("auxiliary"),
    ).distinct()
    left_first = (F.col("user_id") == 7) | (F.col("event_id") % 2 == 0)
    one, two = F.when(left_first, who(left, 0)).otherwise(who(right, 0)), F.when(left_first, who(right, 0)).otherwise(who(left, 0))
    silent = (F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)
    said = F.when(F.col("event_type") == "error", F.concat(one, F.lit(" waves"))).otherwise(
        F.concat(one, F.when(silent, " hugging ").otherwise(" is hugging "), two)
    )
    log = e.select(
        F.col("user_id").cast("string").alias("subject"), F.col("event_id").cast("string").alias("trial_index"),
        F.col("value").cast("string").alias("rt"), F.lit("survey-text").alias("trial_type"), F.lit("describe").alias("test_part"),
        F.concat(F.lit("LIST"), side).alias("list"), F.concat(F.lit('{"Q0":"'), F.initcap(said), F.lit('"}')).alias("responses"),
        F.concat(F.lit('<img src="stim_list'), side, F.lit("/"), verb, F.lit('.gif"</stim_list'), side, F.lit(">")).alias("image_type"),
        who(own, 1).alias("ppt_gender"), who(own, 2).alias("ppt_race"),
    )
    return log, stimuli


@query(
    "clean_log",
    "WITH " + CLEAN_SQL + f"""
    SELECT user_id::VARCHAR AS subject, event_id AS trial_index, trial_number, syntax, event, {VALENCE_SQL} AS valence,
           CASE pg WHEN 'man' THEN CASE pr WHEN 'white' THEN 'White_Man' ELSE 'Black_Man' END
                   ELSE CASE pr WHEN 'white' THEN 'White_Woman' ELSE 'Black_Woman' END END AS ppt_demog,
           first AS first_person, (fg = 'man')::INT AS man_first, value AS rt
    FROM clean
    """,
)
def clean_log(spark, d):
    """The whole cleaning of a production study: extraction, first mention, validity, recoding, trial numbers,
    participants with too many bad trials or one-sided descriptions, and the time limit."""
    log, stimuli = derived_log(spark, d)
    clean = production.clean_log(log, stimuli, STUDY)
    return clean.select(
        "subject", "trial_index", "trial_number", "syntax", "event", "valence", "ppt_demog", "first_person", "man_first", "rt"
    )


@query(
    "construction_shares",
    "WITH " + CLEAN_SQL + """,
    o AS (SELECT user_id, syntax, CASE WHEN lg = rg THEN NULL ELSE (fg = pg)::INT END AS like_me FROM clean),
    u AS (SELECT user_id, syntax, 100 * avg(like_me) AS v FROM o GROUP BY 1, 2)
    SELECT syntax, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM u GROUP BY 1
    """,
)
def construction_shares(spark, d):
    """The cleaned log carried on to the share of descriptions that begin with someone of the own gender, per
    construction: means of participant percentages over trials with two genders."""
    log, stimuli = derived_log(spark, d)
    trials = derive.like_me(derive.trial_types(production.clean_log(log, stimuli, STUDY)))
    trials = trials.withColumn("like_me", F.when(F.col("TrialType") == "GenderTrial", 100 * F.col("OverallLikeMe")))
    units = summarise.stage_means(trials, [["subject", "syntax"]], "like_me")
    out = units.groupBy("syntax").agg(F.avg("like_me").alias("mean"), F.stddev_samp("like_me").alias("sd"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "mean", "sd")
