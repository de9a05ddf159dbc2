"""Pattern queries: projections, type tests, joins, links, paths and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import leaf_types, type_closure
from ..operators.match import checked, either_way, having, hop, links, optional, reachable, without
from .model import BUILDER, RATIO, Graph, dollars, query


@query("prj01_select", "SELECT provision_id, deal_id, ptype FROM p", "p")
def select_variables(g: Graph) -> DataFrame:
    return g.provisions.select("provision_id", "deal_id", "ptype")


@query("prj02_wildcard", "SELECT suppkey, concat('{\"s_suppkey\":', s_suppkey, ',\"s_name\":\"', s_name, '\",\"s_nationkey\":', s_nationkey, '}') AS attributes FROM (SELECT s_suppkey AS suppkey, * FROM supplier)")
def wildcard(g: Graph) -> DataFrame:
    """All attributes of an instance; missing ones are left out."""
    return g.table("supplier").select(F.col("s_suppkey").alias("suppkey"), F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("attributes"))


@query(
    "prj03_unpivot",
    """SELECT entity_id, 'cap' AS attr, CAST(CAST(cap AS DOUBLE) AS DOUBLE) AS value FROM b WHERE cap IS NOT NULL UNION ALL
    SELECT entity_id, 'amount', CAST(amount AS DOUBLE) FROM b UNION ALL SELECT entity_id, 'pct', CAST(pct AS DOUBLE) FROM b""",
    "b",
)
def unpivot(g: Graph) -> DataFrame:
    """Attribute names and values; absent attributes have no row."""
    wide = g.baskets.select("entity_id", *[F.col(c).cast("double").alias(c) for c in ("cap", "amount", "pct")])
    return wide.unpivot("entity_id", ["cap", "amount", "pct"], "attr", "value").filter("value is not null")


@query("prj05_computed", "SELECT entity_id, CAST(amount * pct AS DOUBLE) AS share FROM b", "b")
def computed(g: Graph) -> DataFrame:
    return g.baskets.select("entity_id", (F.col("amount") * F.col("pct")).cast("double").alias("share"))


@query("prj06_literal", "SELECT provision_id, 'cross_reference' AS source FROM p WHERE ptype = 'mfn'", "p")
def literal(g: Graph) -> DataFrame:
    return g.provisions_of("mfn").select("provision_id", F.lit("cross_reference").alias("source"))


@query("flt03_isa_subtype", f"SELECT entity_id, type_name FROM b WHERE super_type = '{RATIO}'", "b")
def isa_subtype(g: Graph) -> DataFrame:
    """Semi-join with the closure of a type; the closure is schema-sized."""
    closure = type_closure(g.sub()).filter(F.col("super") == RATIO).select(F.col("sub").alias("path"))
    return g.baskets.withColumn("path", F.concat_ws("/", "super_type", "type_name")).join(closure, "path", "left_semi").select("entity_id", "type_name")


@query("flt04_isa_exact", f"SELECT entity_id, super_type FROM b WHERE type_name = '{BUILDER}'", "b")
def isa_exact(g: Graph) -> DataFrame:
    return g.baskets.filter(F.col("type_name") == BUILDER).select("entity_id", "super_type")


@query("flt05_not_has_attr", "SELECT entity_id FROM b WHERE cap IS NULL", "b")
def not_has_attr(g: Graph) -> DataFrame:
    return g.baskets.filter(F.col("cap").isNull()).select("entity_id")


@query("flt06_not_isa", f"SELECT entity_id FROM b WHERE super_type <> '{RATIO}' AND type_name <> '{BUILDER}'", "b")
def not_isa(g: Graph) -> DataFrame:
    """Instances of neither a type with its subtypes nor another exact type."""
    closure = type_closure(g.sub()).filter(F.col("super") == RATIO).select(F.col("sub").alias("path"))
    return without(g.baskets.filter(F.col("type_name") != BUILDER).withColumn("path", F.concat_ws("/", "super_type", "type_name")), closure, "path").select("entity_id")


@query("flt07_like", "SELECT deal_id FROM d WHERE regexp_matches(deal_name, '^.*#0+[0-9]*7$')", "d")
def like(g: Graph) -> DataFrame:
    return g.deals.filter(F.col("deal_name").rlike("^.*#0+[0-9]*7$")).select("deal_id")


@query("flt08_find_by_name", "SELECT deal_id, deal_name FROM d WHERE contains(lower(deal_name), lower('MER#0000000'))", "d")
def find_by_name(g: Graph) -> DataFrame:
    return g.deals.filter(F.lower("deal_name").contains("MER#0000000".lower())).select("deal_id", "deal_name")


@query("flt09_membership", "SELECT provision_id FROM p WHERE priority IN ('1-URGENT', '2-HIGH')", "p")
def membership(g: Graph) -> DataFrame:
    return g.provisions.filter(F.col("priority").isin("1-URGENT", "2-HIGH")).select("provision_id")


@query(
    "flt10_filter_or_all",
    """WITH w AS (SELECT provision_id, entity_id, type_name, count(*) FILTER (WHERE type_name IN ('Brand#12', 'Brand#13')) OVER (PARTITION BY provision_id) AS n FROM b)
    SELECT provision_id, entity_id FROM w WHERE n = 0 OR type_name IN ('Brand#12', 'Brand#13')""",
    "b",
)
def filter_or_all(g: Graph) -> DataFrame:
    """Entities of the wanted types, or all where a provision has none."""
    wanted = F.col("type_name").isin("Brand#12", "Brand#13")
    some = g.baskets.filter(wanted).select("provision_id").distinct().withColumn("some", F.lit(True))
    return g.baskets.join(some, "provision_id", "left").filter(F.col("some").isNull() | wanted).select("provision_id", "entity_id")


@query("flt11_drop_not_found", "SELECT answer_id FROM a WHERE confidence <> 'not_found' AND number IS NOT NULL", "a")
def drop_not_found(g: Graph) -> DataFrame:
    return g.answers.filter((F.col("confidence") != "not_found") & F.col("number").isNotNull()).select("answer_id")


@query("flt12_disjunction", f"SELECT DISTINCT entity_id FROM b WHERE type_name = '{BUILDER}' OR is_grower", "b")
def disjunction(g: Graph) -> DataFrame:
    return g.baskets.filter((F.col("type_name") == BUILDER) | F.col("is_grower")).select("entity_id").distinct()


@query("jon01_traversal", "SELECT provision_id, entity_id, s_name FROM b JOIN supplier ON suppkey = s_suppkey", "b")
def traversal(g: Graph) -> DataFrame:
    return g.baskets.join(g.table("supplier"), F.col("suppkey") == F.col("s_suppkey")).select("provision_id", "entity_id", "s_name")


@query("jon02_any_role", "SELECT DISTINCT x, y FROM (SELECT suppkey AS x, partkey AS y FROM b UNION ALL SELECT partkey, suppkey FROM b)", "b")
def any_role(g: Graph) -> DataFrame:
    return either_way(g.baskets.select(F.col("suppkey").cast("long").alias("x"), F.col("partkey").alias("y")), "x", "y").distinct()


@query("jon03_multi_hop", f"SELECT deal_name, provision_id, entity_id, CAST(amount AS DOUBLE) AS amount FROM d JOIN p USING (deal_id) JOIN b USING (provision_id) WHERE super_type = '{RATIO}' AND cap IS NOT NULL", "bpd")
def multi_hop(g: Graph) -> DataFrame:
    baskets = g.baskets.filter((F.col("super_type") == RATIO) & F.col("cap").isNotNull())
    return hop(g.deals, g.provisions, baskets, "deal_id", "provision_id").select("deal_name", "provision_id", "entity_id", F.col("amount").cast("double").alias("amount"))


@query(
    "jon05_links",
    """WITH rp AS (SELECT entity_id AS rel, rel_type, slot, player FROM (
      SELECT entity_id, 'supply' AS rel_type, 'supplier' AS slot, CAST(suppkey AS BIGINT) AS player FROM b UNION ALL
      SELECT entity_id, 'supply', 'part', partkey FROM b UNION ALL SELECT entity_id, 'extracted', 'provision', provision_id FROM b UNION ALL SELECT entity_id, 'annotated', 'line', line FROM b))
    SELECT DISTINCT x.rel, x.slot AS my_slot, y.slot AS their_slot, x.player AS entity_id, y.player AS linked_id FROM rp x JOIN rp y ON x.rel = y.rel AND x.slot <> y.slot WHERE x.rel_type = 'supply' AND y.rel_type = 'supply'""",
    "b",
)
def link_discovery(g: Graph) -> DataFrame:
    """Ordered pairs of players, the families of extraction and annotation left out."""
    slot = lambda name, rel, c: F.struct(F.lit(rel).alias("rel_type"), F.lit(name).alias("slot"), F.col(c).cast("long").alias("player_id"))
    players = g.baskets.select(F.col("entity_id").alias("rel_id"), F.inline(F.array(slot("supplier", "supply", "suppkey"), slot("part", "supply", "partkey"), slot("provision", "extracted", "provision_id"), slot("line", "annotated", "line"))))
    return links(players, ["extracted", "annotated"]).select(F.col("rel_id").alias("rel"), "my_slot", "their_slot", "entity_id", "linked_id").distinct()


@query("jon06_try_optional", "SELECT o_orderkey AS provision_id, CAST(min(l_linenumber) AS INT) AS first_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def try_optional(g: Graph) -> DataFrame:
    first = g.table("lineitem").groupBy(F.col("l_orderkey").alias("provision_id")).agg(F.min("l_linenumber").alias("first_line"))
    return optional(g.provisions.select("provision_id"), first, "provision_id")


@query("jon08_not_relation", "SELECT o_orderkey AS provision_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def not_relation(g: Graph) -> DataFrame:
    return without(g.provisions.select("provision_id"), g.table("lineitem").select(F.col("l_orderkey").alias("provision_id")), "provision_id")


@query("jon09_check_exists", "SELECT o_orderkey AS provision_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) AS large FROM orders")
def check_exists(g: Graph) -> DataFrame:
    large = g.table("lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("provision_id"))
    return checked(g.provisions, large, "provision_id", "large")


@query("jon10_edge_attribute", "SELECT DISTINCT p.provision_id, q.provision_id AS mfn_id FROM p JOIN p q ON p.deal_id = q.deal_id JOIN b ON b.provision_id = p.provision_id WHERE p.ptype = 'di' AND q.ptype = 'mfn' AND b.qty >= 49", "bp")
def edge_attribute(g: Graph) -> DataFrame:
    """Edges with an attribute test, joined across the provisions of a deal."""
    hot = having(g.provisions_of("di"), g.baskets.filter("qty >= 49"), "provision_id")
    return hot.join(g.provisions_of("mfn").select("deal_id", F.col("provision_id").alias("mfn_id")), "deal_id").select("provision_id", "mfn_id")


@query(
    "jon12_answer_grid",
    """WITH q AS (SELECT DISTINCT question_id, answer_type FROM a), x AS (SELECT DISTINCT provision_id FROM a),
    l AS (SELECT provision_id, question_id, max(answer_id) AS answer_id, string_agg(DISTINCT confidence, ', ' ORDER BY confidence) AS chosen FROM a GROUP BY 1, 2)
    SELECT x.provision_id, q.question_id, answer_type, l.answer_id, coalesce(chosen, '') AS chosen FROM x CROSS JOIN q LEFT JOIN l ON l.provision_id = x.provision_id AND l.question_id = q.question_id""",
    "a",
)
def answer_grid(g: Graph) -> DataFrame:
    """Every question of the ontology for every provision with its last answer and the values chosen, if any.

    The grid is the result; the questions are the ontology's (40 of each answer type).
    """
    questions = g.answers.select("question_id", "answer_type").distinct()
    last = g.answers.groupBy("provision_id", "question_id").agg(F.max("answer_id").alias("answer_id"), F.array_join(F.array_sort(F.collect_set("confidence")), ", ").alias("chosen"))
    grid = g.answers.select("provision_id").distinct().crossJoin(questions)
    return optional(grid, last, ["provision_id", "question_id"]).select("provision_id", "question_id", "answer_type", "answer_id", F.coalesce("chosen", F.lit("")).alias("chosen"))


@query("jon13_applicability", "SELECT provision_id, super_type AS concept_type, string_agg(DISTINCT type_name, ',' ORDER BY type_name) AS concepts, count(*) AS n FROM b GROUP BY 1, 2", "b")
def applicability(g: Graph) -> DataFrame:
    return g.baskets.groupBy("provision_id", F.col("super_type").alias("concept_type")).agg(F.array_join(F.array_sort(F.collect_set("type_name")), ",").alias("concepts"), F.count(F.lit(1)).alias("n"))


@query(
    "jon14_evidence_order",
    """WITH e AS (SELECT c_custkey AS deal_id, unnest([c_nationkey, (c_nationkey + 7) % 30, 3]) AS ref, generate_subscripts([1, 2, 3], 1) AS pos FROM customer)
    SELECT deal_id, CAST(pos AS INT) AS pos, n_name FROM e JOIN nation ON n_nationkey = ref""",
)
def evidence_order(g: Graph) -> DataFrame:
    """Listed references that resolve, with their place in the list."""
    refs = F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 30, F.lit(3))
    each = g.table("customer").select(F.col("c_custkey").alias("deal_id"), F.posexplode(refs).alias("pos", "ref"))
    return each.join(g.table("nation"), F.col("ref") == F.col("n_nationkey")).select("deal_id", (F.col("pos") + 1).alias("pos"), "n_name")


def pathways(g: Graph) -> DataFrame:
    """(source, target, capped): the distinct nation pairs of suppliers and customers over all lines; capped lines are those returned."""
    pairs = g.table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(g.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = pairs.join(g.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(g.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"), (F.col("l_returnflag") == "A").alias("capped")).distinct()


_PATHS = """h AS (SELECT DISTINCT s_nationkey AS source, c_nationkey AS target, l_returnflag = 'A' AS capped FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


@query("jon16_two_hop", f"WITH {_PATHS} SELECT DISTINCT x.source, x.target AS mid, y.target FROM h x JOIN h y ON x.target = y.source WHERE NOT y.capped")
def two_hop(g: Graph) -> DataFrame:
    """Chains of two hops whose last one is uncapped."""
    h = pathways(g)
    first = h.select("source", F.col("target").alias("mid")).distinct()
    last = h.filter("not capped").select(F.col("source").alias("mid"), "target")
    return first.join(last, "mid").select("source", "mid", "target").distinct()


@query(
    "jon16_reach",
    f"""WITH RECURSIVE {_PATHS}, r AS (SELECT DISTINCT source, target, 1 AS depth FROM h UNION SELECT r.source, h.target, r.depth + 1 FROM r JOIN h ON r.target = h.source WHERE r.depth < 4)
    SELECT source, target, min(depth) AS depth FROM r GROUP BY 1, 2""",
)
def reach(g: Graph) -> DataFrame:
    return reachable(pathways(g), "source", "target", 4).select("source", "target", F.col("depth").cast("int").alias("depth"))


@query("jon17_cross_walk", "SELECT p.provision_id AS source_id, q.provision_id AS target_id, count(entity_id) AS entities FROM p JOIN p q ON p.deal_id = q.deal_id AND p.created = q.created JOIN b ON b.provision_id = q.provision_id WHERE p.ptype = 'di' AND q.ptype <> 'di' GROUP BY 1, 2", "bp")
def cross_walk(g: Graph) -> DataFrame:
    """From a provision along cross references to the entities of the targets; the walk is one way."""
    source = g.provisions.filter("ptype = 'di'").select(F.col("provision_id").alias("source_id"), "deal_id", "created")
    target = g.provisions.filter("ptype <> 'di'").select(F.col("provision_id").alias("target_id"), "deal_id", "created")
    counts = g.table("lineitem").groupBy(F.col("l_orderkey").alias("target_id")).agg(F.count(F.lit(1)).alias("entities"))
    return source.join(target, ["deal_id", "created"]).join(counts, "target_id").select("source_id", "target_id", "entities")


@query("ord05_sorted_items", "SELECT DISTINCT label FROM b ORDER BY 1", "b")
def sorted_items(g: Graph) -> DataFrame:
    return g.baskets.select("label").distinct().orderBy("label")


@query("lim01_first_row", "SELECT provision_id, total FROM p ORDER BY total DESC, provision_id LIMIT 1", "p")
def first_row(g: Graph) -> DataFrame:
    return g.provisions.select("provision_id", "total").orderBy(F.desc("total"), "provision_id").limit(1)


@query("lim02_newest", "SELECT provision_id, created FROM (SELECT provision_id, strftime(created, '%Y-%m-%d') AS created FROM p) ORDER BY created DESC, provision_id LIMIT 20", "p")
def newest(g: Graph) -> DataFrame:
    return g.provisions.select("provision_id", F.date_format("created", "yyyy-MM-dd").alias("created")).orderBy(F.desc("created"), "provision_id").limit(20)


@query("set01_union_types", "SELECT type_name FROM b WHERE qty >= 50 UNION SELECT super_type FROM b WHERE is_grower", "b")
def union_types(g: Graph) -> DataFrame:
    return g.baskets.filter("qty >= 50").select("type_name").union(g.baskets.filter("is_grower").select("super_type")).distinct()


@query("set02_concat_documents", "SELECT provision_id, 'rp' AS source FROM p WHERE ptype = 'rp' UNION ALL SELECT provision_id, 'cross' FROM p WHERE ptype <> 'di'", "p")
def concat_documents(g: Graph) -> DataFrame:
    return g.provisions_of("rp").select("provision_id", F.lit("rp").alias("source")).unionByName(g.provisions.filter("ptype <> 'di'").select("provision_id", F.lit("cross").alias("source")), allowMissingColumns=True)


@query("set03_intersection", "SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def intersection(g: Graph) -> DataFrame:
    lines = g.table("lineitem")
    return lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("partkey")).intersect(lines.filter("l_quantity = 50").select("l_partkey"))


@query("set05_difference", "SELECT p_partkey AS partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def difference(g: Graph) -> DataFrame:
    return g.table("part").select(F.col("p_partkey").alias("partkey")).join(g.table("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("partkey")), "partkey", "left_anti").distinct()


@query("set09_overlap", "SELECT provision_id FROM b GROUP BY 1 HAVING bool_or(type_name IN ('Brand#1', 'Brand#2'))", "b")
def overlap(g: Graph) -> DataFrame:
    return g.baskets.groupBy("provision_id").agg(F.collect_set("type_name").alias("s")).filter(F.arrays_overlap("s", F.array(F.lit("Brand#1"), F.lit("Brand#2")))).select("provision_id")


@query("sch01_closure", "SELECT DISTINCT concat_ws('/', p_type, p_brand) AS sub, p_type AS super, 1 AS depth FROM part UNION SELECT concat_ws('/', p_type, p_brand), concat_ws('/', p_type, p_brand), 0 FROM part UNION SELECT concat_ws('/', p_type, p_brand), 'basket', 2 FROM part UNION SELECT p_type, p_type, 0 FROM part UNION SELECT p_type, 'basket', 1 FROM part UNION SELECT 'basket', 'basket', 0")
def closure(g: Graph) -> DataFrame:
    return type_closure(g.sub())


@query("sch05_leaf_types", "SELECT DISTINCT concat_ws('/', p_type, p_brand) AS type_name FROM part")
def leaves(g: Graph) -> DataFrame:
    sub = g.sub()
    return leaf_types(sub, sub.select(F.col("sub").alias("type_name")).union(sub.select("super")).distinct())


@query(
    "qry01_poly_fetch",
    """SELECT provision_id, count(*) AS entities, string_agg(concat(entity_id, ':', type_name, ':', coalesce(CAST(CAST(cap AS DOUBLE) AS VARCHAR), '-')), ';' ORDER BY entity_id, type_name) AS docs
    FROM (SELECT provision_id, entity_id, type_name, CASE WHEN cap IS NULL THEN NULL ELSE floor(cap) END AS cap FROM b) GROUP BY 1""".replace("CAST(CAST(cap AS DOUBLE) AS VARCHAR)", "CAST(CAST(cap AS BIGINT) AS VARCHAR)"),
    "b",
)
def poly_fetch(g: Graph) -> DataFrame:
    """Every entity of a provision with type and attributes, nested and rendered; a provision's entities are tens of rows."""
    cap = F.coalesce(F.floor("cap").cast("long").cast("string"), F.lit("-"))
    doc = F.struct("entity_id", "type_name", F.concat_ws(":", "entity_id", "type_name", cap).alias("text"))
    return g.baskets.groupBy("provision_id").agg(F.count(F.lit(1)).alias("entities"), F.array_join(F.transform(F.array_sort(F.collect_list(doc)), lambda x: x["text"]), ";").alias("docs"))


@query("qry02_deal_list", "SELECT deal_id, deal_name, segment FROM d", "d")
def deal_list(g: Graph) -> DataFrame:
    return g.deals.select("deal_id", "deal_name", "segment")


@query("qry07_deal_with_provisions", "SELECT deal_id, deal_name, count(provision_id) AS provisions, count(DISTINCT ptype) AS kinds FROM d LEFT JOIN p USING (deal_id) GROUP BY 1, 2", "pd")
def deal_with_provisions(g: Graph) -> DataFrame:
    per = g.provisions.groupBy("deal_id").agg(F.count(F.lit(1)).alias("provisions"), F.count_distinct("ptype").alias("kinds"))
    return g.deals.join(per, "deal_id", "left").select("deal_id", "deal_name", F.coalesce("provisions", F.lit(0)).alias("provisions"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


@query("qry09_blockers", f"SELECT provision_id, count(DISTINCT suppkey) AS exceptions, string_agg(DISTINCT label, ',' ORDER BY label) AS covered FROM b WHERE type_name = '{BUILDER}' GROUP BY 1", "b")
def blockers(g: Graph) -> DataFrame:
    return g.baskets.filter(F.col("type_name") == BUILDER).groupBy("provision_id").agg(F.count_distinct("suppkey").alias("exceptions"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("covered"))


@query("qry10_sweep_config", "SELECT provision_id, count(*) FILTER (WHERE is_grower) AS tiers, count(*) FILTER (WHERE cap IS NULL) AS exemptions, CAST(max(pct) AS DOUBLE) AS top_pct FROM b GROUP BY 1", "b")
def sweep_config(g: Graph) -> DataFrame:
    return g.baskets.groupBy("provision_id").agg(F.count_if("is_grower").alias("tiers"), F.count_if(F.col("cap").isNull()).alias("exemptions"), F.max("pct").cast("double").alias("top_pct"))


@query("qry11_deals_with_blocker", f"SELECT DISTINCT deal_id, deal_name FROM d JOIN p USING (deal_id) JOIN b USING (provision_id) WHERE type_name = '{BUILDER}' AND qty >= 40", "bpd")
def deals_with_blocker(g: Graph) -> DataFrame:
    with_blocker = having(g.provisions, g.baskets.filter((F.col("type_name") == BUILDER) & (F.col("qty") >= 40)), "provision_id")
    return having(g.deals, with_blocker, "deal_id").select("deal_id", "deal_name")


@query("qry13_compare_ratio", f"SELECT deal_id, entity_id, CAST(amount AS DOUBLE) AS amount, CAST(pct AS DOUBLE) AS pct FROM p JOIN b USING (provision_id) WHERE super_type = '{RATIO}' AND ptype = 'rp' AND cap IS NOT NULL", "bp")
def compare_ratio(g: Graph) -> DataFrame:
    """One row a basket, with its id."""
    return g.baskets.filter((F.col("super_type") == RATIO) & F.col("cap").isNotNull()).join(g.provisions_of("rp"), "provision_id").select("deal_id", "entity_id", F.col("amount").cast("double").alias("amount"), F.col("pct").cast("double").alias("pct"))


@query("qry26_health_counts", "SELECT 'deals' AS name, count(*) AS n FROM customer UNION ALL SELECT 'provisions', count(*) FROM orders UNION ALL SELECT 'entities', count(*) FROM lineitem UNION ALL SELECT 'answers', count(*) FROM events")
def health_counts(g: Graph) -> DataFrame:
    counts = [g.table(t).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in (("deals", "customer"), ("provisions", "orders"), ("entities", "lineitem"), ("answers", "events"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("qry30_status_default", "SELECT o_orderkey AS provision_id, coalesce(any_value(CASE WHEN l_quantity >= 50 THEN 'complete' END), 'pending') AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 50) ON l_orderkey = o_orderkey GROUP BY 1")
def status_default(g: Graph) -> DataFrame:
    done = g.table("lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("provision_id")).distinct().withColumn("status", F.lit("complete"))
    return optional(g.provisions.select("provision_id"), done, "provision_id").select("provision_id", F.coalesce("status", F.lit("pending")).alias("status"))


@query("src05_type_extent", "SELECT super_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM b GROUP BY 1", "b")
def type_extent(g: Graph) -> DataFrame:
    return g.baskets.groupBy("super_type").agg(F.count(F.lit(1)).alias("n"), dollars("amount", "total"))


@query("src06_key_lookup", "SELECT provision_id, deal_id, ptype FROM p WHERE provision_id = 42", "p")
def key_lookup(g: Graph) -> DataFrame:
    return g.provisions.filter("provision_id = 42").select("provision_id", "deal_id", "ptype")
