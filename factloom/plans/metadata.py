"""Question metadata, lookup maps, maintenance and checks over the catalog; paths, costs and answers in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import store as S
from ..operators.match import optional, reachable
from . import lookups, scripts, storing, tables
from .answers import _RAW, raw_values
from .model import BUILDER, ORACLE_SQL, Graph, query
from .schema import brand_number, relation_config, word

# Metadata: parts are questions, brands categories.


@query(
    "jon11_full_metadata",
    """WITH c AS (SELECT p_brand AS category_id, min(p_name) AS category_name FROM part WHERE p_size > 10 GROUP BY 1), cq AS (SELECT p_brand AS category_id, p_partkey AS question_id FROM part WHERE p_size % 3 <> 0),
    q AS (SELECT p_partkey AS question_id, p_name AS text, p_size AS display_order FROM part WHERE p_retailprice >= 0), pr AS (SELECT p_partkey AS question_id, 'Find ' || p_name AS prompt FROM part WHERE p_size % 4 = 0),
    tf AS (SELECT p_partkey AS question_id, split_part(p_name, ' ', 1) AS field FROM part WHERE p_size % 5 = 0), tc AS (SELECT p_partkey AS question_id, p_type AS concept_type FROM part WHERE p_size % 2 = 0),
    op AS (SELECT p_type AS concept_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS options FROM part WHERE p_size % 10 = 1 GROUP BY 1)
    SELECT category_id, category_name, question_id, text, display_order, prompt, CASE WHEN field IS NOT NULL THEN 'field' WHEN concept_type IS NOT NULL THEN 'concept' ELSE 'answer' END AS target_type, coalesce(field, concept_type, question_id || '_answer') AS target, coalesce(options, '') AS options
    FROM c JOIN cq USING (category_id) JOIN q USING (question_id) LEFT JOIN pr USING (question_id) LEFT JOIN tf USING (question_id) LEFT JOIN tc USING (question_id) LEFT JOIN op USING (concept_type)""",
)
def full_metadata(g: Graph) -> DataFrame:
    """Questions of every category with prompt, target field or concept, and the concept's options: two inner joins and four outer ones, no look-up a question."""
    part, key = g.table("part"), F.col("p_partkey").alias("question_id")
    size = F.col("p_size")
    categories = part.filter(size > 10).groupBy(F.col("p_brand").alias("category_id")).agg(F.min("p_name").alias("category_name"))
    linked = part.filter(size % 3 != 0).select(F.col("p_brand").alias("category_id"), key)
    asked = part.filter("p_retailprice >= 0").select(key, F.col("p_name").alias("text"), size.alias("display_order"))
    prompts = part.filter(size % 4 == 0).select(key, F.concat(F.lit("Find "), "p_name").alias("prompt"))
    fields = part.filter(size % 5 == 0).select(key, word(0).alias("field"))
    concepts = part.filter(size % 2 == 0).select(key, F.col("p_type").alias("concept_type"))
    options = part.filter(size % 10 == 1).groupBy(F.col("p_type").alias("concept_type")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("options"))
    rows = categories.join(linked, "category_id").join(asked, "question_id")
    for more, on in ((prompts, "question_id"), (fields, "question_id"), (concepts, "question_id"), (options, "concept_type")):
        rows = optional(rows, more, on)
    kind = F.when(F.col("field").isNotNull(), "field").when(F.col("concept_type").isNotNull(), "concept").otherwise("answer")
    target = F.coalesce("field", "concept_type", F.concat(F.col("question_id").cast("string"), F.lit("_answer")))
    return rows.select("category_id", "category_name", "question_id", "text", "display_order", "prompt", kind.alias("target_type"), target.alias("target"), F.coalesce("options", F.lit("")).alias("options"))


_MAPS = {
    "storage_type": "SELECT DISTINCT lower(p_type), CASE lower(p_type) WHEN 'small' THEN 'double' WHEN 'large' THEN 'boolean' WHEN 'promo' THEN 'integer' ELSE 'string' END FROM part",
    "capacity_class": "SELECT p_brand, CASE WHEN min(p_size) <= 1 THEN 'general_purpose' ELSE 'ratio' END FROM part GROUP BY 1",
    "cross_covenant": "SELECT DISTINCT p_brand, CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'rp' WHEN 1 THEN 'di' ELSE 'mfn' END FROM part WHERE p_size > 40",
    "question_text": "SELECT CAST(p_partkey AS VARCHAR), p_name FROM part",
    "category_name": "SELECT p_brand, max(p_name) FROM part GROUP BY 1",
}


@query("sch11_lookup_maps", " UNION ALL ".join(f"SELECT '{name}' AS map, k AS key, v AS value FROM ({sql}) AS t(k, v)" for name, sql in _MAPS.items()))
def lookup_maps(g: Graph) -> DataFrame:
    """The catalog's five maps as rows of one table; one map is a filter."""
    part, brand = g.table("part"), F.col("p_brand")
    kind = F.lower("p_type")
    said = F.when(kind == "small", "number").when(kind == "large", "boolean").when(kind == "promo", "integer").otherwise("string")
    maps = {
        "storage_type": part.select(kind.alias("key"), T.storage_type(said).alias("value")).distinct(),
        "capacity_class": part.groupBy(brand.alias("key")).agg(F.when(F.min("p_size") <= 1, "general_purpose").otherwise("ratio").alias("value")),
        "cross_covenant": part.filter("p_size > 40").select(brand.alias("key"), F.element_at(F.array(*map(F.lit, ("rp", "di", "mfn"))), brand_number() % 3 + 1).alias("value")).distinct(),
        "question_text": part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")),
        "category_name": part.groupBy(brand.alias("key")).agg(F.max("p_name").alias("value")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("map"), "key", "value") for name, df in maps.items()])


@query("sch13_list_questions", f"WITH {storing._STEPS} SELECT question, target, qn.relation, tier, parent_role, child_role, coalesce(n, 0) AS n_answers FROM qn LEFT JOIN rc USING (relation) LEFT JOIN (SELECT question, count(*) AS n FROM vl WHERE listed GROUP BY 1) USING (question) WHERE qtype = 'entity_list'")
def list_questions(g: Graph) -> DataFrame:
    """Questions that ask for lists, with the storage of their relation and how many lists were given."""
    asked = storing.questions(g).filter("qtype = 'entity_list'").select("question", "target", "relation")
    given = storing.answers(g).filter("items is not null").groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    rows = optional(optional(asked, relation_config(g), "relation"), given, "question")
    return rows.select("question", "target", "relation", "tier", "parent_role", "child_role", F.coalesce("n", F.lit(0)).alias("n_answers"))


@query(
    "qry28_four_blocks",
    """WITH q AS (SELECT p_type AS category, p_partkey AS id, p_name AS text, p_size AS s, p_brand AS b FROM part), x AS (
    SELECT category, 'questions' AS block, s, id, concat(id, ': ', text) AS line FROM q UNION ALL SELECT category, 'options', s, id, concat(id, ' takes ', b) FROM q WHERE s % 2 = 0
    UNION ALL SELECT category, 'entities', s, id, concat(id, ' lists ', b, ' by ', split_part(text, ' ', 1), ', ', split_part(text, ' ', 2)) FROM q WHERE s % 3 = 0 UNION ALL SELECT category, 'hints', s, id, concat(id, ' is defined near ', s) FROM q WHERE s % 5 = 0)
    SELECT category, block, count(*) AS n, string_agg(line, chr(10) ORDER BY s, id) AS lines FROM x GROUP BY 1, 2""",
)
def four_blocks(g: Graph) -> DataFrame:
    """A category's questions, options, entity fields and hints as text blocks in display order; as large as the catalog."""
    s, key = F.col("p_size"), F.col("p_partkey").cast("string")
    blocks = {
        "questions": (F.lit(True), F.concat(key, F.lit(": "), "p_name")),
        "options": (s % 2 == 0, F.concat(key, F.lit(" takes "), "p_brand")),
        "entities": (s % 3 == 0, F.concat(key, F.lit(" lists "), "p_brand", F.lit(" by "), word(0), F.lit(", "), word(1))),
        "hints": (s % 5 == 0, F.concat(key, F.lit(" is defined near "), s.cast("string"))),
    }
    # One pass over the questions: each gives a row for every block it has a line in.
    lines = F.filter(F.array(*[F.when(has, F.struct(F.lit(name).alias("block"), line.alias("line"))) for name, (has, line) in blocks.items()]), lambda x: x.isNotNull())
    each = g.table("part").select(F.col("p_type").alias("category"), "p_size", "p_partkey", F.inline(lines))
    listed = F.array_sort(F.collect_list(F.struct("p_size", "p_partkey", "line")))
    return each.groupBy("category", "block").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))


# Answers in full.


_FIVE = ("boolean", "integer", "double", "string", "date")


@query(
    "qry04_five_channels",
    f"""WITH k AS (SELECT provision_id, answer_type, max(answer_id) AS answer_id FROM a WHERE confidence <> 'not_found' GROUP BY 1, 2),
    r AS (SELECT k.*, confidence, CASE WHEN answer_id % 5 = 4 THEN strftime(extracted_at, '%Y-%m-%d') ELSE {_RAW} END AS raw, {list(_FIVE)}[answer_id % 5 + 1] AS kind, CASE WHEN answer_id % 3 <> 0 THEN answer_id % 300 END AS page FROM k JOIN (SELECT answer_id, confidence, extracted_at FROM a) USING (answer_id)),
    v AS (SELECT * EXCLUDE (raw), CASE WHEN lower(raw) IN ('not_found', 'n/a', 'none', 'null') THEN NULL ELSE raw END AS raw FROM r)
    SELECT provision_id, answer_type, answer_id, CASE WHEN kind = 'boolean' AND raw IS NOT NULL THEN lower(raw) IN ('true', 'yes', '1') END AS answer_boolean, CASE WHEN kind = 'integer' THEN CAST(trunc(TRY_CAST(trim(raw, '''"$%,') AS DOUBLE)) AS BIGINT) END AS answer_integer,
    CASE WHEN kind = 'double' THEN TRY_CAST(trim(raw, '''"$%,') AS DOUBLE) END AS answer_double, CASE WHEN kind = 'string' THEN raw END AS answer_string, CASE WHEN kind = 'date' THEN raw END AS answer_date, page, confidence FROM v""",
    "a",
)
def five_channels(g: Graph) -> DataFrame:
    """The last answer of every kind that a provision has, in its value channel of five, with where it was found."""
    n = F.col("answer_id")
    last = g.answers.filter(F.col("confidence") != "not_found").groupBy("provision_id", "answer_type").agg(F.max(F.struct("answer_id", "extracted_at", "confidence")).alias("x")).select("provision_id", "answer_type", "x.*")
    kind = F.element_at(F.array(*map(F.lit, _FIVE)), (n % 5 + 1).cast("int"))
    raw = F.when(n % 5 == 4, F.date_format("extracted_at", "yyyy-MM-dd")).otherwise(F.col("raw"))
    rows = last.join(raw_values(g), "answer_id").select("provision_id", "answer_type", "answer_id", *T.typed_answer(raw, kind), F.when(n % 3 != 0, n % 300).alias("page"), "confidence")
    return rows.withColumn("answer_date", F.col("answer_date").cast("string"))


_PRICES = [("m1", 0.003, 0.015), ("m2", 0.003, 0.015), ("m3", 0.015, 0.075), ("m4", 0.015, 0.075), ("m5", 0.003, 0.015), ("m6", 0.015, 0.075), ("m7", 0.0008, 0.004)]


def token_costs(used: DataFrame, prices: DataFrame) -> DataFrame:
    """``used`` (model, tokens_in, tokens_out) with ``cost`` by (model, i, o), prices a thousand tokens; models without a price cost nothing and are marked."""
    cost = F.col("tokens_in") / 1000 * F.col("i") + F.col("tokens_out") / 1000 * F.col("o")
    return used.join(F.broadcast(prices), "model", "left").withColumn("priced", F.col("i").isNotNull()).withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), 6)).drop("i", "o")


@query(
    "mth01_seven_prices",
    f"""WITH prices(model, i, o) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES)}), u AS (SELECT event_id, 'm' || (event_id % 8 + 1) AS model, event_id % 5000 AS tin, event_id % 700 AS tout FROM events)
    SELECT event_id, model, i IS NOT NULL AS priced, round(coalesce(tin / 1000.0::DOUBLE * i + tout / 1000.0::DOUBLE * o, 0), 6) AS cost FROM u LEFT JOIN prices USING (model)""",
)
def seven_prices(g: Graph) -> DataFrame:
    """Cost of every call by the price list of seven models."""
    n = F.col("event_id")
    used = g.table("events").select(n, F.concat(F.lit("m"), (n % 8 + 1).cast("string")).alias("model"), (n % 5000).alias("tokens_in"), (n % 700).alias("tokens_out"))
    return token_costs(used, g.spark.createDataFrame(_PRICES, "model string, i double, o double")).select("event_id", "model", "priced", "cost")


# Linking in full.


@query(
    "qry20_gated_feed",
    f"""WITH l AS ({tables._LINK}), n AS (SELECT DISTINCT di_id, mfn_id FROM l WHERE (di_id + mfn_id) % 4 <> 0), f AS (SELECT provision_id AS di_id, CAST(sum(amount) AS DOUBLE) AS fed FROM b WHERE NOT is_grower GROUP BY 1),
    k AS (SELECT provision_id AS mfn_id, min(entity_id) AS builder_id FROM b WHERE type_name = '{BUILDER}' GROUP BY 1) SELECT n.di_id, n.mfn_id, builder_id, fed FROM n JOIN f USING (di_id) JOIN k USING (mfn_id)""",
    "pb",
)
def gated_feed(g: Graph) -> DataFrame:
    """Contributions that feed a builder, only along links that were made just now."""
    feeds = g.baskets.filter("not is_grower").groupBy(F.col("provision_id").alias("di_id")).agg(F.sum("amount").cast("double").alias("fed"))
    builders = g.baskets.filter(F.col("type_name") == BUILDER).groupBy(F.col("provision_id").alias("mfn_id")).agg(F.min("entity_id").alias("builder_id"))
    made = tables.new_links(g).select("di_id", "mfn_id").distinct()
    return made.join(feeds, "di_id").join(builders, "mfn_id").select("di_id", "mfn_id", "builder_id", "fed")


@query(
    "oth07_ensured_provisions",
    """WITH w AS (SELECT user_id * 100 AS provision_id, user_id AS deal_id, min(event_id) AS first_answer FROM events GROUP BY 1, 2) SELECT provision_id, deal_id, NULL AS first_answer, false AS created FROM p WHERE ptype = 'rp'
    UNION ALL SELECT provision_id, deal_id, first_answer, true FROM w WHERE provision_id NOT IN (SELECT provision_id FROM p WHERE ptype = 'rp')""",
    "p",
)
def ensured_provisions(g: Graph) -> DataFrame:
    """Provisions after an extraction: those that were there, which are cleaned first, and those it creates with their link to the deal."""
    wanted = g.table("events").select((F.col("user_id") * 100).alias("provision_id"), F.col("user_id").alias("deal_id"), F.col("event_id").alias("first_answer"))
    return S.ensured(wanted, g.provisions_of("rp"), ["provision_id"], F.col("first_answer").asc()).select("provision_id", "deal_id", "first_answer", "created")


@query(
    "jon16_chain_reach",
    """WITH RECURSIVE e AS (SELECT c_custkey AS source, unnest([lead(c_custkey) OVER w, lead(c_custkey, 3) OVER w]) AS target FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)),
    h AS (SELECT DISTINCT source, target FROM e WHERE target IS NOT NULL), r AS (SELECT source, target, 1 AS depth FROM h UNION SELECT r.source, h.target, r.depth + 1 FROM r JOIN h ON r.target = h.source WHERE r.depth < 4)
    SELECT source, target, min(depth) AS depth FROM r GROUP BY 1, 2""",
)
def chain_reach(g: Graph) -> DataFrame:
    """Deals reached within four steps, each step to the next or the third next deal of one nation and segment: the frontier moves on with every round."""
    w = Window.partitionBy("nation", "segment").orderBy("deal_id")
    steps = g.deals.withColumn("next", F.array(F.lead("deal_id").over(w), F.lead("deal_id", 3).over(w))).select(F.col("deal_id").alias("source"), F.explode("next").alias("target"))
    return reachable(steps.filter("target is not null"), "source", "target", 4).select("source", "target", F.col("depth").cast("int").alias("depth"))


# Maintenance.


@query(
    "qry27_reload",
    """WITH o AS (SELECT p_partkey AS key, p_name, p_size FROM part WHERE p_size > 5), n AS (SELECT p_partkey AS key, CASE WHEN p_size % 7 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part WHERE p_size < 45)
    SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.p_name IS DISTINCT FROM n.p_name THEN 'changed' ELSE 'kept' END AS status, coalesce(n.p_name, o.p_name) AS name FROM o FULL JOIN n ON o.key = n.key""",
)
def reload(g: Graph) -> DataFrame:
    """What loading the catalog anew does to each of its entries: added, changed, kept or removed."""
    part, size = g.table("part"), F.col("p_size")
    old = part.filter(size > 5).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("before"), F.lit(True).alias("was"))
    new = part.filter(size < 45).select(F.col("p_partkey").alias("key"), F.when(size % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("after"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("kept")
    return old.join(new, "key", "full").select("key", status.alias("status"), F.coalesce("after", "before").alias("name"))


#: Seeds in load order: table, key, least number of entries.
_SEEDS = (
    ("region", "r_regionkey", 5), ("region", "r_name", 5), ("nation", "n_nationkey", 25), ("nation", "n_name", 25), ("nation", "n_regionkey", 5), ("part", "p_type", 6), ("part", "p_brand", 25), ("part", "p_name", 40), ("part", "p_size", 50), ("part", "p_partkey", 300),
    ("supplier", "s_nationkey", 20), ("supplier", "s_suppkey", 50), ("customer", "c_mktsegment", 5), ("customer", "c_nationkey", 25), ("customer", "c_custkey", 1000), ("orders", "o_orderstatus", 3), ("orders", "o_orderpriority", 5), ("events", "event_type", 5), ("events", "user_id", 100),
)


@query("qry31_nineteen_steps", " UNION ALL ".join(f"SELECT {i} AS step, '{t}' AS seed, '{k}' AS entry, count(DISTINCT {k}) AS loaded, count(DISTINCT {k}) >= {n} AS enough FROM {t}" for i, (t, k, n) in enumerate(_SEEDS, 1)))
def nineteen_steps(g: Graph) -> DataFrame:
    """Entries of every step of the seeding in load order, against the least number expected; one pass a table."""
    rows = []
    for name in dict.fromkeys(t for t, _, _ in _SEEDS):
        own = [(i, k, n) for i, (t, k, n) in enumerate(_SEEDS, 1) if t == name]
        counts = g.table(name).agg(*[F.count_distinct(k).alias(k) for _, k, _ in own])
        rows.append(counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("seed"), F.lit(k).alias("entry"), F.col(k).alias("loaded"), (F.col(k) >= n).alias("enough")) for i, k, n in own]))))
    return reduce(DataFrame.unionByName, rows)


# Checks on fields as they are.


_BLANK = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field FROM documents WHERE {c} IS NULL OR trim({c}, ' \t\n') = ''" for c in ("text", "lang", "source"))


@query("val03_blank_fields", _BLANK)
def blank_fields(g: Graph) -> DataFrame:
    """Required fields of documents that are missing or blank, one row a field."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c, F.lit(" \t\n")) == "")
    wrong = F.filter(F.array(*[F.when(blank(c), F.lit(c)) for c in ("text", "lang", "source")]), lambda x: x.isNotNull())
    return g.table("documents").select("doc_id", F.explode(wrong).alias("field"))


@query("val08_prompt_under_40", "SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE length(text) < 40")
def short_turns(g: Graph) -> DataFrame:
    """Texts under forty characters."""
    return g.table("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars")).filter("n_chars < 40")


_ALL = {**tables.SEVERITY, "val07_category_order": "warning", "val10_entity_list_targets": "error", "val03_blank_fields": "error", "val08_prompt_under_40": "warning"}


@query("val13_all_checks", f"SELECT found, severity, count(*) AS n, severity = 'error' AS fails FROM ({' UNION ALL '.join(f"SELECT '{sev}' AS severity, '{name}' AS found FROM ({ORACLE_SQL[name]})" for name, sev in _ALL.items())}) GROUP BY 1, 2")
def all_checks(g: Graph) -> DataFrame:
    """Findings of every check of the validator, by check."""
    functions = {
        "val01_duplicate_ids": tables.duplicate_ids, "val02_snake_case": tables.snake_case, "val03_required_fields": tables.required_fields, "val04_domain": tables.domain, "val05_prefix_covenant": tables.prefix_covenant, "val06_order_range": tables.order_range,
        "val08_short_prompt": tables.short_prompt, "val09_hard_coded_section": tables.hard_coded_section, "val11_dangling_linkage": tables.dangling_linkage, "val12_unlinked": tables.unlinked,
        "val07_category_order": scripts.category_order, "val10_entity_list_targets": lookups.entity_list_targets, "val03_blank_fields": blank_fields, "val08_prompt_under_40": short_turns,
    }
    found = [functions[name](g).select(F.lit(name).alias("found"), F.lit(sev).alias("severity")) for name, sev in _ALL.items()]
    return reduce(DataFrame.union, found).groupBy("found", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("fails", F.col("severity") == "error")


# Sets that are not empty on any of the tables.


@query("set04_common_sizes", "SELECT p_size FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)")
def common_sizes(g: Graph) -> DataFrame:
    """Sizes that parts of every type have."""
    part = g.table("part").select("p_type", "p_size").distinct()
    need = part.select("p_type").distinct().agg(F.count(F.lit(1)).alias("need"))
    return part.groupBy("p_size").agg(F.count(F.lit(1)).alias("have")).join(need, F.col("have") == F.col("need")).select("p_size")


@query("set06_unlinked_deals", "SELECT deal_id FROM d WHERE deal_id NOT IN (SELECT deal_id FROM p WHERE ptype = 'mfn')", "dp")
def unlinked_deals(g: Graph) -> DataFrame:
    """Deals without a provision of one kind."""
    return g.deals.select("deal_id").join(g.provisions_of("mfn"), "deal_id", "left_anti")
