"""Answers: ranking, the value channels, coercion, JSON sources, batching, costs and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranking import best_answer as best_of
from ..operators.ranking import best_segment, confidence_rank, first_by, greedy_batches, last_row, near_top
from .model import Graph, query

_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("win01_best_answer", f"SELECT provision_id, question_id, answer_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY provision_id, question_id ORDER BY {_RANK} DESC, answer_id) AS rn FROM a) WHERE rn = 1", "a")
def best_answer(g: Graph) -> DataFrame:
    best = first_by(g.answers, ["provision_id", "question_id"], confidence_rank(F.col("confidence")).desc(), F.col("answer_id").asc())
    return best.select("provision_id", "question_id", "answer_id", "confidence")


@query("win01_best_of_question", f"SELECT question_id, answer_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {_RANK} DESC, answer_id) AS rn FROM a) WHERE rn = 1", "a")
def best_of_question(g: Graph) -> DataFrame:
    return best_of(g.answers, "question_id", "confidence", "answer_id").select("question_id", "answer_id")


def segments(g: Graph) -> DataFrame:
    """Segment maps of texts: events stand for found spans, users for documents."""
    e = F.col("event_id")
    return g.table("events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("segment_type_id"), (e % 7).cast("int").alias("map_idx"), (e % 5 != 0).alias("found"), (e % 11).cast("int").alias("start_page"), (e % 11 + e % 13).cast("int").alias("end_page"), "event_id")


@query(
    "win02_best_segment",
    """WITH s AS (SELECT user_id AS doc_id, event_type AS segment_type_id, event_id % 7 AS map_idx, event_id % 5 <> 0 AS found, event_id % 11 AS sp, event_id % 11 + event_id % 13 AS ep, event_id FROM events)
    SELECT doc_id, segment_type_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, segment_type_id ORDER BY found DESC, ep - sp DESC, map_idx DESC, event_id DESC) AS rn FROM s) WHERE rn = 1""",
)
def widest_segment(g: Graph) -> DataFrame:
    # One map gives a segment once: of its repeats the last stands.
    once = last_row(segments(g), ["doc_id", "segment_type_id", "map_idx", "found", "start_page", "end_page"], "event_id")
    per_span = first_by(once.withColumn("span", F.col("end_page") - F.col("start_page")), ["doc_id", "segment_type_id", "map_idx", "found", "span"], F.col("event_id").desc())
    return best_segment(per_span).select("doc_id", "segment_type_id", "event_id")


@query("win03_score_threshold", "WITH s AS (SELECT provision_id, question_id, count(*) AS score FROM a GROUP BY 1, 2) SELECT provision_id, question_id, score FROM (SELECT *, max(score) OVER (PARTITION BY provision_id) AS m FROM s) WHERE score >= greatest(1, 0.25 * m)", "a")
def score_threshold(g: Graph) -> DataFrame:
    return near_top(g.answers.groupBy("provision_id", "question_id").agg(F.count(F.lit(1)).alias("score")), "provision_id").select("provision_id", "question_id", "score")


@query("win04_last_wins", "SELECT provision_id, question_id, max(answer_id) AS answer_id FROM a GROUP BY 1, 2", "a")
def last_wins(g: Graph) -> DataFrame:
    return g.answers.groupBy("provision_id", "question_id").agg(F.max_by("answer_id", F.struct("extracted_at", "answer_id")).alias("answer_id"))


@query(
    "win05_page_before",
    "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM events",
)
def page_before(g: Graph) -> DataFrame:
    """The most recent marker before each position, within a document."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return g.table("events").select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("page"))


@query(
    "win06_greedy_batches",
    """WITH RECURSIVE q AS (SELECT p_type AS grp, p_brand AS item, count(*) * 600 / 3.5 AS cost FROM part GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY item) AS i FROM q),
    r AS (SELECT grp, item, i, 0 AS batch, CAST(cost AS DOUBLE) AS used FROM n WHERE i = 1
      UNION ALL SELECT n.grp, n.item, n.i, CASE WHEN r.used > 0 AND r.used + n.cost > 10000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used > 0 AND r.used + n.cost > 10000 THEN n.cost ELSE r.used + n.cost END
      FROM r JOIN n ON n.grp = r.grp AND n.i = r.i + 1)
    SELECT grp, item, CAST(batch AS INT) AS batch FROM r""",
)
def batches(g: Graph) -> DataFrame:
    items = g.table("part").groupBy(F.col("p_type").alias("grp"), F.col("p_brand").alias("item")).agg((F.count(F.lit(1)) * 600 / 3.5).alias("cost"))
    return greedy_batches(items, "grp", "item", "cost", 10_000)


@query("win09_list_index", "SELECT provision_id, entity_id, row_number() OVER (PARTITION BY provision_id ORDER BY entity_id, suppkey, line, amount) AS idx FROM b", "b")
def list_index(g: Graph) -> DataFrame:
    w = Window.partitionBy("provision_id").orderBy("entity_id", "suppkey", "line", "amount")
    return g.baskets.select("provision_id", "entity_id", F.row_number().over(w).cast("long").alias("idx"))


@query("qry04_provision_row", "SELECT provision_id, max_by(number, answer_id) FILTER (WHERE answer_type = 'click') AS click, max_by(number, answer_id) FILTER (WHERE answer_type = 'view') AS viewed FROM a GROUP BY 1", "a")
def provision_row(g: Graph) -> DataFrame:
    """Attribute-value rows to one row a provision; the last answer of a kind wins."""
    last = lambda k: F.max_by(F.when(F.col("answer_type") == k, F.col("number")), F.when(F.col("answer_type") == k, F.col("answer_id")))
    return g.answers.groupBy("provision_id").agg(last("click").alias("click"), last("view").alias("viewed"))


_RAW = "CASE answer_id % 8 WHEN 0 THEN '$' || CAST(answer_id AS VARCHAR) WHEN 1 THEN '1,' || lpad(CAST(answer_id % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN CAST(answer_id % 100 AS VARCHAR) || '%' WHEN 3 THEN 'N/A' WHEN 4 THEN 'yes' WHEN 5 THEN '''' || CAST(answer_id AS VARCHAR) || '.5''' WHEN 6 THEN 'not_found' ELSE 'text ' || CAST(answer_id AS VARCHAR) END"


def raw_values(g: Graph) -> DataFrame:
    i, s = F.col("answer_id"), F.col("answer_id").cast("string")
    m = i % 8
    value = F.when(m == 0, F.concat(F.lit("$"), s)).when(m == 1, F.concat(F.lit("1,"), F.lpad((i % 1000).cast("string"), 3, "0"))).when(m == 2, F.concat((i % 100).cast("string"), F.lit("%"))).when(m == 3, "N/A").when(m == 4, "yes").when(m == 5, F.concat(F.lit("'"), s, F.lit(".5'"))).when(m == 6, "not_found").otherwise(F.concat(F.lit("text "), s))
    return g.answers.select("answer_id", value.alias("raw"))


@query(
    "cst01_coerce",
    f"""WITH r AS (SELECT answer_id, {_RAW} AS raw FROM a), v AS (SELECT answer_id, CASE WHEN lower(raw) IN ('not_found', 'n/a', 'none', 'null') THEN NULL ELSE raw END AS raw FROM r)
    SELECT answer_id, TRY_CAST(trim(raw, '''"$%,') AS DOUBLE) AS number, CAST(trunc(TRY_CAST(trim(raw, '''"$%,') AS DOUBLE)) AS BIGINT) AS whole, CASE WHEN raw IS NULL THEN NULL ELSE lower(raw) IN ('true', 'yes', '1') END AS flag FROM v""",
    "a",
)
def coerce(g: Graph) -> DataFrame:
    raw = F.col("raw")
    return raw_values(g).select("answer_id", T.coerce_number(raw).alias("number"), T.coerce_integer(raw).alias("whole"), T.coerce_boolean(raw).alias("flag"))


@query("cst02_coerce_legacy", f"SELECT answer_id, CAST(trunc(TRY_CAST(trim(CASE WHEN lower(raw) IN ('not_found', 'n/a', 'none', 'null') THEN NULL ELSE raw END, '''\"') AS DOUBLE)) AS BIGINT) AS whole FROM (SELECT answer_id, {_RAW} AS raw FROM a)", "a")
def coerce_legacy(g: Graph) -> DataFrame:
    return raw_values(g).select("answer_id", T.coerce_legacy_integer(F.col("raw")).alias("whole"))


@query(
    "cst04_typed_channels",
    f"""WITH r AS (SELECT answer_id, {_RAW} AS raw, CASE answer_id % 3 WHEN 0 THEN 'double' WHEN 1 THEN 'string' ELSE 'boolean' END AS kind FROM a), v AS (SELECT answer_id, kind, CASE WHEN lower(raw) IN ('not_found', 'n/a', 'none', 'null') THEN NULL ELSE raw END AS raw FROM r)
    SELECT answer_id, CASE WHEN kind = 'boolean' AND raw IS NOT NULL THEN lower(raw) IN ('true', 'yes', '1') END AS answer_boolean, CASE WHEN kind = 'double' THEN TRY_CAST(trim(raw, '''"$%,') AS DOUBLE) END AS answer_double, CASE WHEN kind = 'string' THEN raw END AS answer_string FROM v""",
    "a",
)
def typed_channels(g: Graph) -> DataFrame:
    kind = F.when(F.col("answer_id") % 3 == 0, "double").when(F.col("answer_id") % 3 == 1, "string").otherwise("boolean")
    return raw_values(g).select("answer_id", *T.typed_answer(F.col("raw"), kind)).select("answer_id", "answer_boolean", "answer_double", "answer_string")


@query("cst05_storage_type", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'double' WHEN event_type = 'error' THEN 'boolean' ELSE 'string' END AS storage FROM events")
def storage_type(g: Graph) -> DataFrame:
    as_answer = F.when(F.col("event_type").isin("click", "view"), "currency").when(F.col("event_type") == "error", "boolean").otherwise("multiselect")
    return g.table("events").select("event_id", T.storage_type(as_answer).alias("storage"))


@query("src12_json_answers", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_answers(g: Graph) -> DataFrame:
    """Model output as a source: JSON in fenced text, from the first { to the last }."""
    fenced = F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))
    return g.table("events").select("event_id", F.from_json(T.json_block(fenced), "k long")["k"].alias("k"))


@query(
    "jsn02_array_repair",
    "SELECT answer_id, question_id, number FROM a WHERE question_id IN (SELECT DISTINCT question_id FROM a WHERE confidence = 'high')",
    "a",
)
def array_repair(g: Graph) -> DataFrame:
    """A JSON array with a trailing comma, mended, parsed and kept to known question ids."""
    row = F.to_json(F.struct("question_id", F.col("number").alias("value")))
    reply = F.concat(F.lit("text ["), row, F.lit(",] more"))
    parsed = g.answers.select("answer_id", F.explode(F.from_json(T.json_array_block(reply), "array<struct<question_id: string, value: double>>")).alias("x"))
    known = g.answers.filter("confidence = 'high'").select("question_id").distinct()
    return parsed.select("answer_id", "x.question_id", F.col("x.value").alias("number")).join(known, "question_id", "left_semi").select("answer_id", "question_id", "number")


@query("arr01_multiselect_join", "SELECT provision_id, string_agg(DISTINCT answer_type, ', ' ORDER BY answer_type) AS chosen FROM a GROUP BY 1", "a")
def multiselect_join(g: Graph) -> DataFrame:
    return g.answers.groupBy("provision_id").agg(F.array_join(F.array_sort(F.collect_set("answer_type")), ", ").alias("chosen"))


@query("arr02_flags", "SELECT provision_id, bool_or(answer_type = 'click') AS has_click, bool_or(answer_type = 'error') AS has_error FROM a GROUP BY 1", "a")
def flags(g: Graph) -> DataFrame:
    """List values to boolean attributes through the routing map."""
    routed = g.answers.select("provision_id", F.explode(F.array("answer_type")).alias("v"))
    return routed.groupBy("provision_id").agg(F.bool_or(F.col("v") == "click").alias("has_click"), F.bool_or(F.col("v") == "error").alias("has_error"))


@query(
    "mth01_token_cost",
    """WITH prices(model, i, o) AS (VALUES ('click', 0.003, 0.015), ('view', 0.0008, 0.004), ('error', 0.015, 0.075))
    SELECT event_id, round(coalesce((event_id % 5000) / 1000.0 * i + (event_id % 700) / 1000.0 * o, 0), 6) AS cost FROM events LEFT JOIN prices ON model = event_type""".replace("0.003, 0.015", "0.003::DOUBLE, 0.015::DOUBLE").replace("0.0008, 0.004", "0.0008::DOUBLE, 0.004::DOUBLE").replace("('error', 0.015, 0.075)", "('error', 0.015::DOUBLE, 0.075::DOUBLE)"),
)
def token_cost(g: Graph) -> DataFrame:
    """Unknown models cost nothing."""
    prices = g.spark.createDataFrame([("click", 0.003, 0.015), ("view", 0.0008, 0.004), ("error", 0.015, 0.075)], "model string, i double, o double")
    used = g.table("events").select("event_id", "event_type", (F.col("event_id") % 5000).alias("tin"), (F.col("event_id") % 700).alias("tout"))
    cost = F.col("tin") / 1000 * F.col("i") + F.col("tout") / 1000 * F.col("o")
    return used.join(prices, F.col("event_type") == F.col("model"), "left").select("event_id", F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"))


@query("qry22_tier_split", "SELECT entity_id, CASE WHEN type_name IN ('Brand#1', 'Brand#2') THEN 'primary' WHEN type_name IN ('Brand#3') THEN 'supplementary' WHEN super_type = 'PROMO' THEN 'primary' WHEN super_type IN ('LARGE', 'SMALL') THEN 'supplementary' ELSE 'excluded' END AS tier FROM b", "b")
def tier_split(g: Graph) -> DataFrame:
    """Own type first, linked types next, primary before supplementary."""
    own, linked = F.col("type_name"), F.array("super_type")
    arr = lambda *x: F.array(*map(F.lit, x))
    tier = F.when(own.isin("Brand#1", "Brand#2"), "primary").when(own.isin("Brand#3"), "supplementary").when(F.arrays_overlap(linked, arr("PROMO")), "primary").when(F.arrays_overlap(linked, arr("LARGE", "SMALL")), "supplementary").otherwise("excluded")
    return g.baskets.select("entity_id", tier.alias("tier"))


@query("qry25_eval_join", "SELECT d.doc_id, quality, lang, CASE WHEN quality = 1 THEN 'expected' ELSE 'other' END AS gold FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def eval_join(g: Graph) -> DataFrame:
    """Gold rows beside the outputs; they are put side by side, not scored."""
    gold = g.table("labels").select("doc_id", "quality", F.when(F.col("quality") == 1, "expected").otherwise("other").alias("gold"))
    return g.table("documents").select("doc_id", "lang").join(gold, "doc_id").select("doc_id", "quality", "lang", "gold")


@query("oth11_unanswered", "SELECT question_id FROM a GROUP BY 1 HAVING count(*) FILTER (WHERE confidence = 'high') = 0", "a")
def unanswered(g: Graph) -> DataFrame:
    return g.answers.groupBy("question_id").agg(F.count_if(F.col("confidence") == "high").alias("n")).filter("n = 0").select("question_id")
