"""Nested documents of entities, the retrieval plan over them, and the views of a provision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import mutate as M
from ..operators.match import optional
from . import texts
from .capacity import priming_risk, trapdoor
from .model import BUILDER, Graph, query

ATTRIBUTES = ("amount", "cap", "pct")


def annotations(g: Graph) -> DataFrame:
    """(type_name, attr, question): what an attribute of a type answers; as large as the catalog."""
    attr = F.element_at(F.array(*map(F.lit, ATTRIBUTES)), F.col("p_size") % 3 + 1)
    return g.table("part").groupBy(F.col("p_brand").alias("type_name"), attr.alias("attr")).agg(F.min("p_name").alias("question"))


def whole(c: Column | str) -> Column:
    return F.floor(c).cast("long").cast("string")


def documents(g: Graph) -> DataFrame:
    """One row an entity: attributes with their annotations, children with theirs, and links."""
    # Annotations of a type as one map, so that entities meet the catalog once and keep their partitioning.
    known = annotations(g).groupBy("type_name").agg(F.map_from_entries(F.collect_list(F.struct("attr", "question"))).alias("asked"))
    note = lambda a: F.coalesce(F.concat(F.lit(" ("), F.try_element_at("asked", F.lit(a)), F.lit(")")), F.lit(""))
    held = F.array(*[F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{a}="), whole(a), note(a))) for a in ATTRIBUTES])
    nation = g.table("nation").select("n_nationkey", "n_name")
    child = g.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("suppkey"), F.concat(F.lit("supplier "), "s_name", F.coalesce(F.concat(F.lit(" ("), "n_name", F.lit(")")), F.lit(""))).alias("child"))
    full = optional(optional(g.baskets, known, "type_name"), child, "suppkey")
    links = F.array_sort(F.array(F.concat(F.lit("part:"), F.col("partkey").cast("string")), F.concat(F.lit("supplier:"), F.col("suppkey").cast("string"))))
    return full.select("provision_id", "entity_id", "type_name", "super_type", "suppkey", F.array_join(F.filter(held, lambda x: x.isNotNull()), "; ").alias("attributes"), F.coalesce("child", F.lit("")).alias("children"), F.array_join(links, ", ").alias("links"))


_SHOWN = ", ".join(f"CASE WHEN {a} IS NOT NULL THEN concat('{a}=', CAST(floor({a}) AS BIGINT), coalesce(' (' || n_{a}.q || ')', '')) END" for a in ATTRIBUTES)
_NOTES = " ".join(f"LEFT JOIN n n_{a} ON n_{a}.t = type_name AND n_{a}.attr = '{a}'" for a in ATTRIBUTES)
_FULL = f"""n AS (SELECT p_brand AS t, ['amount', 'cap', 'pct'][CAST(p_size % 3 + 1 AS INT)] AS attr, min(p_name) AS q FROM part GROUP BY 1, 2),
f AS (SELECT provision_id, entity_id, type_name, super_type, suppkey, concat_ws('; ', {_SHOWN}) AS attributes,
  coalesce(concat('supplier ', s_name, CASE WHEN n_name IS NOT NULL THEN concat(' (', n_name, ')') ELSE '' END), '') AS children, concat('part:', partkey, ', supplier:', suppkey) AS links
  FROM b {_NOTES} LEFT JOIN supplier ON s_suppkey = suppkey LEFT JOIN nation ON n_nationkey = s_nationkey)"""


@query("qry01_full_fetch", f"WITH {_FULL} SELECT provision_id, entity_id, type_name, attributes, children, links FROM f", "b")
def full_fetch(g: Graph) -> DataFrame:
    """Every entity of every provision with attributes, annotations, children and links; one provision is a filter."""
    return documents(g).select("provision_id", "entity_id", "type_name", "attributes", "children", "links")


PRIMARY, SUPPLEMENTARY = ("Brand#11", "Brand#12", "Brand#13", "Brand#21"), ("Brand#14", "Brand#22", "Brand#31")


#: Questions that provisions are asked.
ASKED = 150


def wanted_types(g: Graph) -> DataFrame:
    """(question, type_name): the concept types of the matched categories of a question that is asked; ontology-sized."""
    own = g.table("part").select(F.col("p_name").alias("category"), F.col("p_brand").alias("type_name")).distinct()
    types = texts.text_matches(g).join(own, "category").groupBy("low").agg(F.collect_set("type_name").alias("types"))
    return texts.by_question(g, types).filter(F.col("question").between(1, ASKED)).select("question", F.explode("types").alias("type_name")).distinct()


def retrieval(g: Graph) -> DataFrame:
    """(provision_id, question, tier, entities, docs): route, fetch, cross, filter with fallback, split into tiers.

    Every provision of one kind is asked one question. Entities are its own and those of
    the other provisions of its deal made on the same day; of the question's types, or
    all where it has none of them.
    """
    asked = g.provisions.filter("ptype = 'di'").select("provision_id", "deal_id", "created", (F.col("provision_id") % ASKED + 1).alias("question"))
    other = g.provisions.filter("ptype <> 'di'").select(F.col("provision_id").alias("target_id"), "deal_id", "created")
    crossed = asked.join(other, ["deal_id", "created"]).select("provision_id", "question", "target_id")
    reached = asked.select("provision_id", "question", F.col("provision_id").alias("target_id")).unionByName(crossed)
    docs = documents(g).withColumnRenamed("provision_id", "target_id")
    fetched = reached.join(docs, "target_id").join(F.broadcast(wanted_types(g).withColumn("wanted", F.lit(True))), ["question", "type_name"], "left")
    # The window's shuffle by provision serves the aggregation as well.
    some = F.bool_or(F.coalesce("wanted", F.lit(False))).over(Window.partitionBy("provision_id"))
    kept = fetched.withColumn("some", some).filter(~F.col("some") | F.col("wanted"))
    own = F.col("type_name")
    tier = F.when(own.isin(*PRIMARY), "primary").when(own.isin(*SUPPLEMENTARY), "supplementary").when(F.col("super_type") == "PROMO", "primary").otherwise("excluded")
    shown = F.concat("entity_id", F.lit(": "), "attributes", F.lit(" | "), "children", F.lit(" | "), "links")
    lines = F.array_join(F.array_sort(F.collect_list(shown)), "\n")
    return kept.groupBy("provision_id", "question", tier.alias("tier")).agg(F.count(F.lit(1)).alias("entities"), F.md5(lines).alias("docs"))


_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
query(
    "qry21_retrieval",
    f"""WITH {_FULL}, {texts.ROUTE}, wt AS (SELECT DISTINCT question, p_brand AS type_name FROM m JOIN part ON p_name = category),
    k AS (SELECT provision_id, deal_id, created, provision_id % 150 + 1 AS question FROM p WHERE ptype = 'di'),
    r AS (SELECT provision_id, question, provision_id AS target_id FROM k UNION ALL SELECT k.provision_id, k.question, o.provision_id FROM k JOIN p o ON o.deal_id = k.deal_id AND o.created = k.created WHERE o.ptype <> 'di'),
    z AS (SELECT r.provision_id, r.question, f.entity_id, f.type_name, f.super_type, attributes, children, links, wt.question IS NOT NULL AS wanted, bool_or(wt.question IS NOT NULL) OVER (PARTITION BY r.provision_id) AS any_wanted
      FROM r JOIN f ON f.provision_id = r.target_id LEFT JOIN wt ON wt.question = r.question AND wt.type_name = f.type_name),
    y AS (SELECT *, concat(entity_id, ': ', attributes, ' | ', children, ' | ', links) AS line, CASE WHEN type_name IN ({_LIST(PRIMARY)}) THEN 'primary' WHEN type_name IN ({_LIST(SUPPLEMENTARY)}) THEN 'supplementary' WHEN super_type = 'PROMO' THEN 'primary' ELSE 'excluded' END AS tier FROM z WHERE wanted OR NOT any_wanted)
    SELECT provision_id, question, tier, count(*) AS entities, md5(string_agg(line, chr(10) ORDER BY line)) AS docs FROM y GROUP BY 1, 2, 3""",
    "bp",
)(retrieval)


@query(
    "qry08_builder_sources",
    f"""SELECT provision_id, type_name, count(*) AS baskets, CAST(sum(amount) AS DOUBLE) AS amount, coalesce(string_agg(CASE WHEN type_name = '{BUILDER}' THEN concat(s_name, '/', category) END, ', ' ORDER BY s_name, category), '') AS sources
    FROM b LEFT JOIN supplier ON s_suppkey = suppkey GROUP BY 1, 2""",
    "b",
)
def builder_sources(g: Graph) -> DataFrame:
    """Baskets of a provision by type; the builder's with the sources that feed it."""
    full = optional(g.baskets, g.table("supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name"), "suppkey")
    source = F.when((F.col("type_name") == BUILDER) & F.col("s_name").isNotNull(), F.struct("s_name", "category"))
    shown = F.transform(F.array_sort(F.collect_list(source)), lambda s: F.concat(s["s_name"], F.lit("/"), s["category"]))
    return full.groupBy("provision_id", "type_name").agg(F.count(F.lit(1)).alias("baskets"), F.sum("amount").cast("double").alias("amount"), F.array_join(shown, ", ").alias("sources"))


_KINDS = ("click", "view", "purchase", "signup", "error")


def provision_answers(g: Graph) -> DataFrame:
    """(provision_id, one number a kind): the last answer of a kind that was found."""
    found = g.answers.filter(F.col("confidence") != "not_found")
    last = lambda k: F.max_by(F.when(F.col("answer_type") == k, F.col("number")), F.when(F.col("answer_type") == k, F.col("answer_id"))).alias(k)
    return found.groupBy("provision_id").agg(*map(last, _KINDS))


_ANSWERS = "SELECT provision_id, " + ", ".join(f"max_by(number, answer_id) FILTER (WHERE answer_type = '{k}') AS \"{k}\"" for k in _KINDS) + " FROM a WHERE confidence <> 'not_found' GROUP BY 1"


@query(
    "qry03_deal_answers",
    f"""WITH v AS ({_ANSWERS}) SELECT d.deal_id, deal_name, p.provision_id, p.ptype, {', '.join(f'"{k}"' for k in _KINDS)}, v.provision_id IS NOT NULL AS extracted FROM d LEFT JOIN p ON p.deal_id = d.deal_id LEFT JOIN v ON v.provision_id = p.provision_id""",
    "dpa",
)
def deal_answers(g: Graph) -> DataFrame:
    """Deals with the answers of each of their provisions, and whether anything was extracted for it."""
    values = provision_answers(g).withColumn("there", F.lit(True))
    rows = optional(optional(g.deals.select("deal_id", "deal_name"), g.provisions.select("deal_id", "provision_id", "ptype"), "deal_id"), values, "provision_id")
    return rows.select("deal_id", "deal_name", "provision_id", "ptype", *_KINDS, F.coalesce("there", F.lit(False)).alias("extracted"))


@query(
    "qry06_provision_view",
    f"""WITH v AS ({_ANSWERS}), n AS (SELECT provision_id, count(*) AS entities, count(DISTINCT type_name) AS types, bool_or(is_grower) AS has_grower, bool_or(cap IS NULL) AS has_uncapped FROM b GROUP BY 1),
    u AS (SELECT provision_id, string_agg(concept, ', ' ORDER BY concept) AS concepts FROM (SELECT DISTINCT provision_id, super_type AS concept FROM b) GROUP BY 1)
    SELECT p.provision_id, p.ptype, {', '.join(f'"{k}"' for k in _KINDS)}, coalesce(entities, 0) AS entities, coalesce(types, 0) AS types, coalesce(has_grower, false) AS has_grower, coalesce(has_uncapped, false) AS has_uncapped, coalesce(concepts, '') AS concepts
    FROM p LEFT JOIN v ON v.provision_id = p.provision_id LEFT JOIN n ON n.provision_id = p.provision_id LEFT JOIN u ON u.provision_id = p.provision_id""",
    "pab",
)
def provision_view(g: Graph) -> DataFrame:
    """One row a provision: answers, counts, flags and applicable concepts; the aliases of a kind are filters on it."""
    facts = g.baskets.groupBy("provision_id").agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("type_name").alias("types"), F.bool_or("is_grower").alias("has_grower"), F.bool_or(F.col("cap").isNull()).alias("has_uncapped"), F.array_join(F.array_sort(F.collect_set("super_type")), ", ").alias("concepts")
    )
    rows = optional(optional(g.provisions.select("provision_id", "ptype"), provision_answers(g), "provision_id"), facts, "provision_id")
    filled = {"entities": F.lit(0), "types": F.lit(0), "has_grower": F.lit(False), "has_uncapped": F.lit(False), "concepts": F.lit("")}
    return rows.select("provision_id", "ptype", *_KINDS, *[F.coalesce(c, x).alias(c) for c, x in filled.items()])


@query(
    "qry14_graph_summary",
    "SELECT deal_id, p.provision_id, count(*) AS baskets, count(DISTINCT suppkey) AS sources, count(*) FILTER (WHERE is_grower) AS growers, string_agg(DISTINCT type_name, ', ' ORDER BY type_name) AS types FROM p JOIN b ON b.provision_id = p.provision_id WHERE ptype = 'rp' GROUP BY 1, 2",
    "pb",
)
def graph_summary(g: Graph) -> DataFrame:
    own = g.baskets.groupBy("provision_id").agg(F.count(F.lit(1)).alias("baskets"), F.count_distinct("suppkey").alias("sources"), F.count_if("is_grower").alias("growers"), F.array_join(F.array_sort(F.collect_set("type_name")), ", ").alias("types"))
    return g.provisions_of("rp").join(own, "provision_id").select("deal_id", "provision_id", "baskets", "sources", "growers", "types")


@query(
    "qry18_store_phases",
    """WITH c AS (SELECT answer_id, provision_id, question_id, number, CASE WHEN confidence = 'not_found' THEN 'skip' WHEN answer_type = 'purchase' THEN 'entity' WHEN answer_type = 'signup' THEN 'flag' WHEN number IS NOT NULL THEN 'scalar' ELSE 'text' END AS phase FROM a)
    SELECT 'entity' AS phase, provision_id, concat('e', provision_id, '_', question_id) AS target, CAST(count(*) AS DOUBLE) AS value FROM c WHERE phase = 'entity' GROUP BY 2, 3
    UNION ALL SELECT 'flag', provision_id, concat('has_', question_id), 1.0 FROM c WHERE phase = 'flag' GROUP BY 2, 3
    UNION ALL SELECT 'scalar', provision_id, question_id, arg_min(number, answer_id) FROM c WHERE phase = 'scalar' GROUP BY 2, 3""",
    "a",
)
def store_phases(g: Graph) -> DataFrame:
    """What storing all answers leaves: one entity a question, flags from lists, and scalars of which the first write stands.

    One classified table feeds the branches; answers that were not found are skipped.
    """
    c = F.col
    phase = F.when(c("confidence") == "not_found", "skip").when(c("answer_type") == "purchase", "entity").when(c("answer_type") == "signup", "flag").when(c("number").isNotNull(), "scalar").otherwise("text")
    rows = g.answers.select("answer_id", "provision_id", "question_id", "number", phase.alias("phase"))
    entity = rows.filter("phase = 'entity'").groupBy("provision_id", F.concat(F.lit("e"), c("provision_id").cast("string"), F.lit("_"), "question_id").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    flag = rows.filter("phase = 'flag'").select("provision_id", F.concat(F.lit("has_"), "question_id").alias("target")).distinct().withColumn("value", F.lit(1.0))
    scalar = M.first_write_wins(rows.filter("phase = 'scalar'").select("provision_id", c("question_id").alias("target"), c("number").alias("value"), "answer_id"), ["provision_id", "target"], "answer_id").drop("answer_id")
    named = [df.select(F.lit(k).alias("phase"), "provision_id", "target", "value") for k, df in (("entity", entity), ("flag", flag), ("scalar", scalar))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "svc1_full_report",
    f"""SELECT p.provision_id, coalesce(baskets, 0) AS baskets, coalesce(growers, 0) AS growers, capped, coalesce(types, '') AS types, priming, door FROM p
    LEFT JOIN (SELECT provision_id, count(*) AS baskets, count(*) FILTER (WHERE is_grower) AS growers, CAST(sum(cap) AS DOUBLE) AS capped, string_agg(DISTINCT type_name, ', ' ORDER BY type_name) AS types,
      bool_or(super_type = 'ECONOMY' AND qty >= 30 AND NOT is_grower) AS a, bool_or(super_type = 'PROMO' AND status = 'O' AND cap IS NULL) AS c FROM b GROUP BY 1) x ON x.provision_id = p.provision_id
    CROSS JOIN LATERAL (SELECT coalesce(a, false) AS priming, coalesce(c, false) AS door) WHERE ptype = 'di'""",
    "pb",
)
def full_report(g: Graph) -> DataFrame:
    """All figures of a provision in one row; counts are zero, sums null and lists empty where it has no basket."""
    own = g.baskets.groupBy("provision_id").agg(F.count(F.lit(1)).alias("baskets"), F.count_if("is_grower").alias("growers"), F.sum("cap").cast("double").alias("capped"), F.array_join(F.array_sort(F.collect_set("type_name")), ", ").alias("types"))
    risks = priming_risk(g).join(trapdoor(g), "provision_id").withColumnsRenamed({"priming_risk": "priming", "trapdoor": "door"})
    rows = optional(risks, own, "provision_id")
    return rows.select("provision_id", F.coalesce("baskets", F.lit(0)).alias("baskets"), F.coalesce("growers", F.lit(0)).alias("growers"), "capped", F.coalesce("types", F.lit("")).alias("types"), "priming", "door")


@query("oth20_business_id", "SELECT n_nationkey, concat('deal_', substr(sha256(concat(n_nationkey, chr(31), n_name)), 1, 16)) AS id FROM nation")
def business_ids(g: Graph) -> DataFrame:
    """Ids that repeat: from the business key, not at random."""
    return g.table("nation").select("n_nationkey", M.business_id("deal_", "n_nationkey", "n_name").alias("id"))


@query("oth21_dangling_annotations", "SELECT DISTINCT l_partkey AS partkey, 'no type' AS problem FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) UNION ALL SELECT p_partkey, 'no entity' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def dangling_annotations(g: Graph) -> DataFrame:
    """Annotations without a type and types without an entity, as findings."""
    used = g.table("lineitem").select(F.col("l_partkey").alias("partkey")).distinct()
    known = g.table("part").select(F.col("p_partkey").alias("partkey"), "p_size")
    no_type = used.join(known.filter("p_size > 2"), "partkey", "left_anti").withColumn("problem", F.lit("no type"))
    return no_type.unionByName(known.join(used, "partkey", "left_anti").select("partkey", F.lit("no entity").alias("problem")))


@query("oth16_usage_rollup", "SELECT user_id, concat('{\"calls\":', count(*), ',\"tokens_in\":', sum(event_id % 5000), ',\"tokens_out\":', sum(event_id % 700), '}') AS usage FROM events GROUP BY 1")
def usage_rollup(g: Graph) -> DataFrame:
    """Usage of a deal as one JSON line."""
    used = g.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("event_id") % 5000).alias("tokens_in"), F.sum(F.col("event_id") % 700).alias("tokens_out"))
    return used.select("user_id", F.to_json(F.struct("calls", "tokens_in", "tokens_out")).alias("usage"))
