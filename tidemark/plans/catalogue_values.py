"""Queries over single values: text, ids, times, numbers, maps, JSON and hashes, with the same in SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, timekeys, vectors
from ..operators import episodes, search
from ..sources import tables
from .catalogue import _EV, _TURNS, ms, query, r6

# Text.

_CUT = "CASE WHEN strlen(text) > {n} THEN substr(text, 1, CAST(list_max(list_filter(range(0, {n} + 1), lambda k: strlen(substr(text, 1, CAST(k AS INT))) <= {n})) AS INT)) || '...' ELSE text END"


@query(
    "text_truncation",
    f"""SELECT doc_id, {_CUT.format(n=50)} AS cut, CASE WHEN length(text) <= 40 THEN text WHEN regexp_extract(substr(text, 1, 40), '(?s)^(.*) [^ ]*$', 1) <> ''
      THEN regexp_extract(substr(text, 1, 40), '(?s)^(.*) [^ ]*$', 1) ELSE substr(text, 1, 40) END AS at_word FROM documents""",
)
def text_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "documents").select("doc_id", text.ellipsis(F.col("text"), 50).alias("cut"), text.cut_at_word(F.col("text"), 40).alias("at_word"))


_ANSWERS = """CASE doc_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"id": ' || doc_id || '}' || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || '{"id": ' || doc_id || '}' || chr(10) || '```'
    WHEN 2 THEN 'It is {"id": ' || doc_id || '} as asked' ELSE '  none ' END"""


@query(
    "model_answers",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'none' ELSE '{"id": ' || doc_id || '}' END AS found, 'Topic ' || doc_id AS label FROM documents""",
)
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "documents").select("doc_id", F.expr(_ANSWERS.replace("chr(", "char(")).alias("answer"))
    label = F.concat(F.lit(' "Topic '), F.col("doc_id").cast("string"), F.lit("\" '"))
    return rows.select("doc_id", text.extract_json(F.col("answer")).alias("found"), text.clean_label(label).alias("label"))


@query(
    "id_parts",
    f"""WITH {_EV} SELECT event_id, 'day' AS level, epoch_us(ts) // 1000 AS grip_ms, event_id % 2 = 0 AS valid, epoch_us(ts) // 1000 AS key_ms, 'u' || event_id AS key_ulid, CASE WHEN event_id % 3 = 0 THEN NULL ELSE agent END AS agent FROM ev""",
)
def id_parts(spark: SparkSession, sf: str) -> DataFrame:
    e, number = tables.events(spark, sf), F.col("event_id").cast("string")
    grip = F.concat(F.lit("grip:"), ms("ts").cast("string"), F.lit(":"), F.lpad(number, 26, "0"))
    odd = F.concat(F.lit("grip:"), ms("ts").cast("string"), F.lit(":short"))
    key = text.event_key_parts(F.concat(F.lit("evt:"), ms("ts").cast("string"), F.lit(":u"), number))
    agent = F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.upper("agent"), F.lit(" ")))
    return e.select(
        "event_id",
        text.node_level(timekeys.node_id("day", F.col("ts"))).alias("level"),
        text.grip_ms(grip).alias("grip_ms"),
        text.valid_grip_id(F.when(F.col("event_id") % 2 == 0, grip).otherwise(odd)).alias("valid"),
        key["ms"].alias("key_ms"),
        key["ulid"].alias("key_ulid"),
        text.normalise_agent(agent).alias("agent"),
    )


@query("episode_texts", "SELECT doc_id, 'Task ' || doc_id || '. lesson a. lesson ' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '. failed' ELSE '' END AS embedded FROM documents")
def episode_texts(spark: SparkSession, sf: str) -> DataFrame:
    lessons = F.array(F.lit("lesson a"), F.concat(F.lit("lesson "), (F.col("doc_id") % 3).cast("string")))
    failures = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("failed"))).otherwise(F.array().cast("array<string>"))
    return tables.read(spark, sf, "documents").select("doc_id", episodes.embedding_text(F.concat(F.lit("Task "), F.col("doc_id").cast("string")), lessons, failures).alias("embedded"))


@query("label_confidences", "SELECT doc_id, round(CASE doc_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN least((doc_id % 20) / 10.0, 1.0) ELSE 0.5 + 0.5 * (1 + doc_id % 5) / (1 + doc_id % 5 + 2.0) END, 6) AS confidence FROM documents")
def label_confidences(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    scores = F.when(d % 3 == 0, F.array().cast("array<double>")).when(d % 3 == 1, F.array(d % 20 / 10.0)).otherwise(F.array((1 + d % 5).cast("double"), F.lit(2.0)))
    return tables.read(spark, sf, "documents").select("doc_id", r6(text.label_confidence(scores)).alias("confidence"))


@query("keyword_union", f"WITH {_TURNS}, k AS (SELECT conv_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM tu) SELECT conv_id, array_to_string(list_sort(list_distinct(list(w)))[1:7], ',') AS keywords FROM k GROUP BY conv_id")
def keyword_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.turns(spark, sf).select("conv_id", F.split(F.lower("text"), " ").alias("k"))
    return rows.groupBy("conv_id").agg(text.merged_keywords(F.collect_list("k")).alias("keywords")).select("conv_id", F.array_join("keywords", ",").alias("keywords"))


# Times.


@query("ulid_times", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def ulid_times(spark: SparkSession, sf: str) -> DataFrame:
    alphabet = F.lit(timekeys._CROCKFORD)
    digits = [F.substring(alphabet, (F.shiftright(ms("ts"), 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(9, -1, -1)]
    ulid = F.concat(*digits, F.lit("ABCDEFGHJKMNPQRS"))
    return tables.events(spark, sf).select("event_id", timekeys.ulid_ms(F.lower(ulid)).alias("ms"))


@query("range_arguments", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN greatest(event_id % 50, 1) WHEN 1 THEN greatest(event_id % 9 * 7, 1) WHEN 2 THEN 1 WHEN 3 THEN 7 WHEN 4 THEN 30 ELSE 7 END AS days FROM events")
def range_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Range arguments that follow from event ids: days, weeks, names, and an odd one."""
    i = F.col("event_id")
    argument = F.when(i % 6 == 0, F.concat((i % 50).cast("string"), F.lit("d"))).when(i % 6 == 1, F.concat((i % 9).cast("string"), F.lit("W ")))
    argument = argument.when(i % 6 == 2, "yesterday").when(i % 6 == 3, "Last week").when(i % 6 == 4, "this month").otherwise("odd")
    return tables.read(spark, sf, "events").select("event_id", timekeys.range_days(argument).cast("bigint").alias("days"))


@query("time_arguments", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN epoch_us(date_trunc('day', CAST(ts AS TIMESTAMP))) // 1000 WHEN event_id % 4 = 2 THEN epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) // 1000 ELSE epoch_us(CAST(ts AS TIMESTAMP)) // 1000 END AS ms FROM events")
def time_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Times of events as arguments: milliseconds, dates, dates with a time, and what is none."""
    e = tables.events(spark, sf)
    argument = F.when(F.col("event_id") % 4 == 0, F.unix_millis("ts").cast("string")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("soon"))
    return e.select("event_id", timekeys.time_ms(argument).alias("ms"))


@query(
    "time_phrases",
    "SELECT doc_id, round(CASE doc_id % 8 WHEN 0 THEN doc_id / 1440.0 WHEN 1 THEN doc_id / 24.0 WHEN 2 THEN doc_id * 1.0 WHEN 3 THEN 1 WHEN 4 THEN 7 WHEN 5 THEN 30 WHEN 6 THEN 3 END, 6) AS days FROM documents",
)
def time_phrases(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    phrases = ["minutes ago", "hours ago", "days ago", "what did we say Yesterday", "notes of last week", "this month", "the latest news", "nothing of time"]
    asked = F.lit(None).cast("string")
    for k, p in enumerate(phrases):
        asked = F.when(d % 8 == k, F.concat(F.lit("from "), d.cast("string"), F.lit(f" {p}")) if k < 3 else F.lit(p)).otherwise(asked)
    return tables.read(spark, sf, "documents").select("doc_id", r6(timekeys.lookback_days(asked)).alias("days"))


# Numbers, maps, JSON and hashes.


@query(
    "unit_vectors",
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS size, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first, round(greatest(0, least(1, 3 * e[2])), 6) AS clamped FROM v",
)
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return tables.read(spark, sf, "embeddings").select(
        "vec_id", r6(vectors.norm(e)).alias("size"), r6(F.element_at(vectors.normalise(e), 1)).alias("first"), r6(scoring.clamp01(3 * F.element_at(vectors.as_doubles(e), 2))).alias("clamped")
    )


@query("metadata_numbers", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id / 4.0 ELSE 0.5 END AS salience FROM documents")
def metadata_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    held = F.when(d % 3 == 0, F.create_map(F.lit("salience"), (d / 4.0).cast("string"))).when(d % 3 == 1, F.create_map(F.lit("salience"), F.lit("much"))).otherwise(F.create_map(F.lit("kind"), F.lit("x")))
    return tables.read(spark, sf, "documents").select("doc_id", search.metadata_number(held, "salience", 0.5).alias("salience"))


@query("json_round_trip", "SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "events").select("event_id", F.to_json(F.struct("event_type", "value", F.from_json("props", "k bigint").alias("props"))).alias("j"))
    back = F.from_json("j", "event_type string, value double, props struct<k: bigint>")
    return e.select("event_id", back["event_type"].alias("event_type"), back["value"].alias("value"), back["props"]["k"].alias("k"))


@query("text_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("array_operations", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, len(list(role)) AS n, list_contains(list(role), 'user') AS asked FROM conversations GROUP BY conv_id")
def array_operations(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return rows.select("conv_id", F.array_join(text.sorted_agents(F.col("r")), ",").alias("roles"), F.size("r").alias("n"), F.array_contains("r", "user").alias("asked"))


# Windows, grouping sets and joins of any table store.


@query(
    "window_functions",
    """SELECT o_orderkey, ntile(4) OVER w AS quarter, lead(o_orderkey) OVER w AS next_key, nth_value(o_orderkey, 2) OVER w AS second_key,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS around FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_functions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return tables.read(spark, sf, "orders").select(
        "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.lead("o_orderkey").over(w).alias("next_key"), F.nth_value("o_orderkey", 2).over(w).alias("second_key"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-1, 1)), 2).alias("around")
    )


@query("grouping_sets", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    both, one = [F.col("status"), F.col("priority")], [F.col("status")]
    return o.groupingSets([both, one, []], *both).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("cube_orders", "SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def cube_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y"))
    return o.cube("status", "y").agg(F.count(F.lit(1)).alias("n"))


@query("join_strategies", "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """A sort-merge join of the large tables, asked for by a hint, and a broadcast of the 25 nations."""
    o, c, n = (tables.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.select("o_custkey").hint("merge").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("theta_join", "SELECT a.event_id, count(b.event_id) AS later FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.event_id")
def theta_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the same user within the next hour: an equality narrows the range condition."""
    e = tables.events(spark, sf).select("event_id", "user_id", "ts")
    b = e.select(F.col("user_id").alias("__u"), F.col("ts").alias("__t"))
    near = e.join(b, (F.col("user_id") == F.col("__u")) & (F.col("__t") > F.col("ts")) & (F.col("__t") <= F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    return near.groupBy("event_id").agg(F.count(F.lit(1)).alias("later"))
