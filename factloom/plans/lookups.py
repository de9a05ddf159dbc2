"""Plain filters, sums, orders, differences, lookups and renderings of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import type_closure
from ..functions import text as T
from ..operators import match
from ..operators.ranking import first_by
from .model import BUILDER, EBITDA, RATIO, Graph, dollars, query

#: Searched as substrings of lower-case texts.
KEYWORDS = ("the", "model", "data", "how")
#: Characters of a chunk, and how far a boundary may be moved to a line end.
CHUNK, REACH = 5_000, 200


@query("src09_statement_lines", r"SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '^[ \t]*(#|$)')")
def statement_lines(g: Graph) -> DataFrame:
    """Lines of a script without comments and blank lines."""
    return g.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(~F.col("line").rlike(r"^[ \t]*(#|\z)"))


@query("src14_segment_types", "SELECT p_partkey AS segment_id, CASE WHEN p_size % 3 = 0 THEN p_type END AS rp_field, CASE WHEN p_size % 3 = 1 THEN p_type END AS mfn_field, p_size AS display_order FROM part")
def segment_types(g: Graph) -> DataFrame:
    field = lambda k: F.when(F.col("p_size") % 3 == k, F.col("p_type"))
    return g.table("part").select(F.col("p_partkey").alias("segment_id"), field(0).alias("rp_field"), field(1).alias("mfn_field"), F.col("p_size").alias("display_order")).orderBy("display_order", "segment_id")


@query("flt01_attribute_equals", f"SELECT entity_id, type_name FROM b WHERE is_grower AND type_name = '{BUILDER}'", "b")
def attribute_equals(g: Graph) -> DataFrame:
    return g.baskets.filter(F.col("is_grower") & (F.col("type_name") == BUILDER)).select("entity_id", "type_name")


@query("flt02_value_inequality", "SELECT provision_id, entity_id FROM b WHERE category <> 'other' AND status = 'O'", "b")
def value_inequality(g: Graph) -> DataFrame:
    return g.baskets.filter("category <> 'other' AND status = 'O'").select("provision_id", "entity_id")


@query("prj04_type_label", "SELECT entity_id, type_name AS type_label FROM b", "b")
def type_label(g: Graph) -> DataFrame:
    return g.baskets.select("entity_id", F.col("type_name").alias("type_label"))


@query("jon04_polymorphic_relation", f"SELECT provision_id, entity_id, super_type || '/' || type_name AS rel_type FROM b WHERE super_type = '{RATIO}'", "b")
def polymorphic_relation(g: Graph) -> DataFrame:
    """Edges of every relation below a parent relation."""
    below = type_closure(g.sub()).filter(F.col("super") == RATIO).select(F.col("sub").alias("rel_type")).distinct()
    edges = g.baskets.select("provision_id", "entity_id", F.concat_ws("/", "super_type", "type_name").alias("rel_type"))
    return match.having(edges, below, "rel_type").select("provision_id", "entity_id", "rel_type")


@query("jon07_optional_attributes", "SELECT p.provision_id, " + ", ".join(f"bool_or(category = '{c}') AS has_{c}" for c in ("general_purpose", "ratio", "fixed")) + " FROM p LEFT JOIN b USING (provision_id) GROUP BY 1", "bp")
def optional_attributes(g: Graph) -> DataFrame:
    """One optional column for each entry of a metadata list."""
    flags = [F.bool_or(F.col("category") == c).alias(f"has_{c}") for c in ("general_purpose", "ratio", "fixed")]
    found = g.baskets.groupBy("provision_id").agg(*flags)
    return match.optional(g.provisions.select("provision_id"), found, "provision_id")


@query(
    "jon11_question_metadata",
    """SELECT question_id, answer_type, n_answers, n_sure FROM (SELECT DISTINCT question_id, answer_type FROM a)
    JOIN (SELECT answer_type, count(*) AS n_answers FROM a GROUP BY 1) USING (answer_type)
    LEFT JOIN (SELECT question_id, count(*) AS n_sure FROM a WHERE confidence = 'high' GROUP BY 1) USING (question_id)""",
    "a",
)
def question_metadata(g: Graph) -> DataFrame:
    """Questions with their category's figures and, where there are any, their own; one pass, no lookups by question."""
    count = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    questions = g.answers.select("question_id", "answer_type").distinct()
    joined = questions.join(count(g.answers, "answer_type", "n_answers"), "answer_type")
    return match.optional(joined, count(g.answers.filter("confidence = 'high'"), "question_id", "n_sure"), "question_id")


@query("jon15_keyword_match", f"SELECT conv_id, turn, keyword FROM conversations JOIN (SELECT unnest({list(KEYWORDS)}) AS keyword) ON contains(lower(text), keyword)")
def keyword_match(g: Graph) -> DataFrame:
    """Substring matches against a fixed list, without a join."""
    hits = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower("text"), k))
    return g.table("conversations").select("conv_id", "turn", F.explode(hits).alias("keyword"))


@query("agg01_sum", "SELECT provision_id, CAST(sum(amount) AS DOUBLE) AS total FROM b GROUP BY 1", "b")
def sum_amount(g: Graph) -> DataFrame:
    return g.baskets.groupBy("provision_id").agg(dollars("amount", "total"))


@query("agg02_sum_arithmetic", f"SELECT type_name, CAST(sum(pct) AS DOUBLE) * {EBITDA} / 100 AS capacity FROM b WHERE is_grower GROUP BY 1", "b")
def sum_arithmetic(g: Graph) -> DataFrame:
    return g.baskets.filter("is_grower").groupBy("type_name").agg((F.sum("pct").cast("double") * EBITDA / 100).alias("capacity"))


@query("agg03_count", "SELECT type_name, count(*) AS n FROM b GROUP BY 1", "b")
def count_entities(g: Graph) -> DataFrame:
    return g.baskets.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))


@query("agg04_exists", "SELECT deal_id, bool_or(ptype = 'mfn') AS has_mfn FROM p GROUP BY 1", "p")
def any_mfn(g: Graph) -> DataFrame:
    return g.provisions.groupBy("deal_id").agg(F.bool_or(F.col("ptype") == "mfn").alias("has_mfn"))


@query("agg05_first", "SELECT provision_id, CAST(min(cap) AS DOUBLE) AS first_cap FROM b WHERE cap IS NOT NULL GROUP BY 1", "b")
def first_cap(g: Graph) -> DataFrame:
    """`first` has no order of its own; the least value makes it repeatable."""
    return g.baskets.filter("cap IS NOT NULL").groupBy("provision_id").agg(F.min("cap").cast("double").alias("first_cap"))


@query("agg07_count_per_covenant", "SELECT ptype, count(*) AS n FROM p GROUP BY 1", "p")
def count_per_covenant(g: Graph) -> DataFrame:
    return g.provisions.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"))


@query("agg10_annotation_map", "SELECT answer_type, string_agg(question_id || '=' || CAST(last_id AS VARCHAR), ',' ORDER BY question_id) AS entries FROM (SELECT answer_type, question_id, max(answer_id) AS last_id FROM a GROUP BY 1, 2) GROUP BY 1", "a")
def annotation_map(g: Graph) -> DataFrame:
    """Type -> question -> last entry; groups are as large as the catalog, not the data."""
    last = g.answers.groupBy("answer_type", "question_id").agg(F.max("answer_id").alias("last_id"))
    entries = F.array_sort(F.collect_list(F.struct("question_id", "last_id")))
    shown = F.transform(entries, lambda e: F.concat(e["question_id"], F.lit("="), e["last_id"].cast("string")))
    return last.groupBy("answer_type").agg(F.concat_ws(",", shown).alias("entries"))


@query("win07_page_citations", "SELECT DISTINCT provision_id, answer_id % 40 AS page FROM a x WHERE confidence = 'low' AND NOT EXISTS (SELECT 1 FROM a y WHERE y.confidence = 'high' AND y.provision_id = x.provision_id AND y.answer_id % 40 = x.answer_id % 40)", "a")
def page_citations(g: Graph) -> DataFrame:
    """Page-only citations whose page no full citation has named."""
    cited = g.answers.select("provision_id", (F.col("answer_id") % 40).alias("page"), "confidence")
    full = cited.filter("confidence = 'high'").select("provision_id", "page")
    return match.without(cited.filter("confidence = 'low'").select("provision_id", "page").distinct(), full, ["provision_id", "page"])


@query("win08_bucket_matches", "SELECT provision_id, bucket, term, start FROM (SELECT provision_id, (answer_id % 1000) // 200 AS bucket, answer_type AS term, answer_id % 1000 AS start, row_number() OVER (PARTITION BY provision_id, (answer_id % 1000) // 200 ORDER BY answer_type, answer_id % 1000) AS rn FROM a) WHERE rn = 1", "a")
def bucket_matches(g: Graph) -> DataFrame:
    """One match for each bucket of 200 characters; the first term wins."""
    found = g.answers.select("provision_id", F.col("answer_type").alias("term"), (F.col("answer_id") % 1000).alias("start")).withColumn("bucket", F.floor(F.col("start") / 200))
    return first_by(found, ["provision_id", "bucket"], F.col("term"), F.col("start"))


@query("ord01_by_score", "SELECT question_id, count(*) AS score FROM a GROUP BY 1", "a")
def by_score(g: Graph) -> DataFrame:
    return g.answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "question_id")


@query("ord02_category_display", "SELECT p_type AS category_id, p_size AS display_order, p_partkey AS question_id FROM part")
def category_display(g: Graph) -> DataFrame:
    return g.table("part").select(F.col("p_type").alias("category_id"), F.col("p_size").alias("display_order"), F.col("p_partkey").alias("question_id")).orderBy("category_id", "display_order", "question_id")


@query("ord03_category_question", "SELECT DISTINCT answer_type AS category_id, question_id FROM a", "a")
def category_question(g: Graph) -> DataFrame:
    return g.answers.select(F.col("answer_type").alias("category_id"), "question_id").distinct().orderBy("category_id", "question_id")


@query("ord04_null_first_display", "SELECT p_partkey AS segment_id, coalesce(nullif(p_size, 1), 0) AS display_order FROM part")
def null_first_display(g: Graph) -> DataFrame:
    return g.table("part").select(F.col("p_partkey").alias("segment_id"), F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0)).alias("display_order")).orderBy("display_order", "segment_id")


@query("set04_in_every_set", "SELECT question_id FROM a GROUP BY 1 HAVING count(DISTINCT confidence) = (SELECT count(DISTINCT confidence) FROM a)", "a")
def in_every_set(g: Graph) -> DataFrame:
    """Members common to all of N sets."""
    need = g.answers.agg(F.count_distinct("confidence").alias("need"))
    have = g.answers.groupBy("question_id").agg(F.count_distinct("confidence").alias("have"))
    return have.join(need, F.col("have") == F.col("need")).select("question_id")


@query("set06_unlinked", "SELECT p_partkey AS question_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def unlinked(g: Graph) -> DataFrame:
    return match.without(g.table("part").select(F.col("p_partkey").alias("question_id")), g.table("lineitem").select(F.col("l_partkey").alias("question_id")), "question_id")


@query("set07_missing_annotated", "SELECT DISTINCT question_id FROM a WHERE question_id NOT IN (SELECT question_id FROM a WHERE confidence = 'high')", "a")
def missing_annotated(g: Graph) -> DataFrame:
    return match.without(g.answers.select("question_id").distinct(), g.answers.filter("confidence = 'high'").select("question_id"), "question_id")


@query("set08_unknown_segments", "SELECT DISTINCT user_id AS segment_id FROM events WHERE user_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def unknown_segments(g: Graph) -> DataFrame:
    known = g.table("part").filter("p_size > 25").select(F.col("p_partkey").alias("segment_id"))
    return match.without(g.table("events").select(F.col("user_id").alias("segment_id")).distinct(), known, "segment_id")


@query(
    "str03_chunk_boundaries",
    f"""WITH n AS (SELECT doc_id, text, length(text) AS len, CAST(ceil(length(text) / {CHUNK}.0) AS BIGINT) AS k FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, text, unnest(range(1, k)) AS i, len, k FROM n WHERE k > 1),
    w AS (SELECT doc_id, i, i * len // k AS target, substr(text, i * len // k - {REACH} + 1, {2 * REACH}) AS around FROM t)
    SELECT doc_id, i AS chunk, CASE WHEN contains(around, chr(10)) THEN target - {REACH} + length(around) - position(chr(10) IN reverse(around)) + 1 ELSE target END AS boundary FROM w""",
)
def chunk_boundaries(g: Graph) -> DataFrame:
    """Even cuts of long texts, moved behind the last line end near them."""
    n = F.length("text").cast("long")
    sized = g.table("documents").select("doc_id", "text", n.alias("len"), F.ceil(n / CHUNK).alias("k")).filter("k > 1")
    cuts = sized.select("doc_id", "text", "len", "k", F.explode(F.expr("sequence(1L, k - 1)")).alias("chunk")).withColumn("target", F.expr("chunk * len div k"))
    around = cuts.select("doc_id", "chunk", "target", F.expr(f"substring(text, int(target - {REACH} + 1), {2 * REACH})").alias("around"))
    at = F.instr(F.reverse("around"), F.lit("\n"))
    moved = F.col("target") - REACH + F.length("around") - at + 1
    return around.select("doc_id", "chunk", F.when(at > 0, moved).otherwise(F.col("target")).alias("boundary"))


@query("str10_dollars", "SELECT p_partkey, '$' || format('{:,}', CAST(round_even(p_retailprice, 0) AS BIGINT)) AS shown FROM part")
def shown_dollars(g: Graph) -> DataFrame:
    return g.table("part").select("p_partkey", T.dollars(F.col("p_retailprice")).alias("shown"))


@query("str11_percent", "SELECT p_partkey, CASE WHEN v <= 1 THEN format('{:.0f}%', v * 100.0::DOUBLE) ELSE format('{:.1f}%', v) END AS shown FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size / 40.0::DOUBLE ELSE p_size / 8.0::DOUBLE END AS v FROM part)")
def shown_percent(g: Graph) -> DataFrame:
    """Many values lie just between two numbers."""
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 40).otherwise(F.col("p_size") / 8)
    return g.table("part").select("p_partkey", T.percent(v).alias("shown"))


@query("str14_rendered", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS shown, CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS flag FROM lineitem")
def shown_values(g: Graph) -> DataFrame:
    return g.table("lineitem").select("l_orderkey", "l_linenumber", T.rendered(F.col("l_quantity")).alias("shown"), F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("flag"))


@query("str15_flat_evidence", "SELECT doc_id, '[' || source || '] ' || substr(text, 1, 200) AS shown FROM documents")
def flat_evidence(g: Graph) -> DataFrame:
    """Evidence lines; the source text is cut at 200 characters, as the feature asks."""
    return g.table("documents").select("doc_id", F.concat(F.lit("["), F.col("source"), F.lit("] "), F.substring("text", 1, 200)).alias("shown"))


@query("jsn01_json_block", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_json(g: Graph) -> DataFrame:
    """A JSON object out of a fenced reply with a trailing comma."""
    reply = F.concat(F.lit("Here:\n```json\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\n```\nDone."))
    return g.table("events").select("event_id", F.from_json(T.json_block(reply), "k long")["k"].alias("k"))


@query("jsn03_bad_json", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def bad_json(g: Graph) -> DataFrame:
    """Fences are stripped; broken JSON gives null."""
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```{"), F.col("props"))).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return g.table("events").select("event_id", F.from_json(F.trim(F.regexp_replace(broken, "```(json)?", "")), "k long")["k"].alias("k"))


@query("jsn04_document_json", """SELECT n_nationkey, '{"id":' || CAST(n_nationkey AS VARCHAR) || ',"name":"' || n_name || '"}' AS doc FROM nation""")
def document_json(g: Graph) -> DataFrame:
    return g.table("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("doc"))


@query("map01_segment_sections", "SELECT p_partkey AS segment_id, p_type AS section FROM part WHERE p_size % 3 = 0")
def segment_sections(g: Graph) -> DataFrame:
    return segment_types(g).filter("rp_field IS NOT NULL").select("segment_id", F.col("rp_field").alias("section"))


@query("mth02_trace_cost", "SELECT event_id, (event_id * 15.0::DOUBLE + user_id * 75.0::DOUBLE) / 1000000.0::DOUBLE AS cost FROM events")
def trace_cost(g: Graph) -> DataFrame:
    """Dollars at a price for a million tokens in, and another out."""
    return g.table("events").select("event_id", ((F.col("event_id") * F.lit(15.0) + F.col("user_id") * F.lit(75.0)) / F.lit(1e6)).alias("cost"))


@query("sch06_list_types", "SELECT DISTINCT super_type AS listed, super_type || '/' || type_name AS concrete FROM b WHERE category = 'ratio'", "b")
def list_types(g: Graph) -> DataFrame:
    """Types asked for as lists, with the subtypes that stand for them."""
    listed = g.baskets.filter("category = 'ratio'").select(F.col("super_type").alias("listed"), F.concat_ws("/", "super_type", "type_name").alias("seen")).distinct()
    closure = type_closure(g.sub())
    return listed.join(closure, (F.col("listed") == closure.super) & (F.col("seen") == closure.sub)).select("listed", closure.sub.alias("concrete"))


@query("sch10_question_attribute", "SELECT question_id, max_by(answer_type, answer_id) AS attribute FROM a GROUP BY 1", "a")
def question_attribute(g: Graph) -> DataFrame:
    return g.answers.groupBy("question_id").agg(F.max_by("answer_type", "answer_id").alias("attribute"))


@query("sch12_question_target", "SELECT p_partkey AS question_id, coalesce(CASE WHEN p_size <= 12 THEN p_name END, CASE WHEN p_size <= 25 THEN p_type END, CAST(p_partkey AS VARCHAR) || '_answer') AS target FROM part")
def question_target(g: Graph) -> DataFrame:
    """A question's field, else its concept, else its own answer slot."""
    size = F.col("p_size")
    target = F.coalesce(F.when(size <= 12, F.col("p_name")), F.when(size <= 25, F.col("p_type")), F.concat(F.col("p_partkey").cast("string"), F.lit("_answer")))
    return g.table("part").select(F.col("p_partkey").alias("question_id"), target.alias("target"))


@query("qry15_types_by_parent", "SELECT p_type AS parent, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS types FROM part GROUP BY 1")
def types_by_parent(g: Graph) -> DataFrame:
    """Ontology listing; as large as the catalog."""
    return g.table("part").groupBy(F.col("p_type").alias("parent")).agg(F.concat_ws(", ", F.sort_array(F.collect_set("p_brand"))).alias("types"))


@query("qry18_storage_phase", "SELECT answer_id, CASE WHEN confidence = 'not_found' THEN 'skip' WHEN answer_type = 'purchase' THEN 'entity' WHEN number IS NOT NULL THEN 'scalar' ELSE 'text' END AS phase FROM a", "a")
def storage_phase(g: Graph) -> DataFrame:
    """Which branch of the store each answer takes."""
    c = F.col
    return g.answers.select("answer_id", F.when(c("confidence") == "not_found", "skip").when(c("answer_type") == "purchase", "entity").when(c("number").isNotNull(), "scalar").otherwise("text").alias("phase"))


@query("val10_entity_list_targets", "SELECT p_partkey AS question_id FROM part WHERE p_type = 'PROMO' AND (p_size > 40 OR p_size < 5)")
def entity_list_targets(g: Graph) -> DataFrame:
    """List questions that lack their entity or their relation."""
    size = F.col("p_size")
    targets = g.table("part").select(F.col("p_partkey").alias("question_id"), "p_type", F.when(size <= 40, size).alias("entity"), F.when(size >= 5, size).alias("relation"))
    return targets.filter((F.col("p_type") == "PROMO") & (F.col("entity").isNull() | F.col("relation").isNull())).select("question_id")
