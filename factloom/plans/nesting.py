"""Nested views of deals and provisions, clean-up of what they hold, lists held against each other, look-ups with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..operators import mutate as M
from ..operators.nest import nested
from ..operators.ranking import first_source
from . import texts
from .model import BUILDER, ORACLE_SQL, Graph, query
from .schema import word


def as_json(c: str) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"}).alias(c)


def whole(c: str) -> Column:
    return F.floor(c).cast("long").alias(c)


_LIST = lambda fields, order, where, frm: f"SELECT provision_id, CAST(to_json(list({fields} ORDER BY {order})) AS VARCHAR) AS x FROM {frm} WHERE {where} GROUP BY 1"
_TIERS = _LIST("{'tier_id': entity_id, 'amount': CAST(floor(amount) AS BIGINT), 'pct': CAST(floor(pct) AS BIGINT)}", "entity_id, floor(amount), floor(pct)", "is_grower", "b")
_MINIMA = _LIST("{'threshold_id': entity_id, 'kind': super_type, 'amount': CAST(floor(amount) AS BIGINT)}", "entity_id, super_type, floor(amount)", "category = 'general_purpose'", "b")
_EXEMPT = _LIST("{'exemption_id': entity_id, 'name': label}", "entity_id, label", "cap IS NULL", "b")
_SWEEP = f"t AS ({_TIERS}), m AS ({_MINIMA}), x AS ({_EXEMPT})"


def sweep_parts(g: Graph) -> dict[str, DataFrame]:
    b = g.baskets
    return {
        "tiers": b.filter("is_grower").select("provision_id", F.col("entity_id").alias("tier_id"), whole("amount"), whole("pct")),
        "de_minimis": b.filter("category = 'general_purpose'").select("provision_id", F.col("entity_id").alias("threshold_id"), F.col("super_type").alias("kind"), whole("amount")),
        "exemptions": b.filter("cap is null").select("provision_id", F.col("entity_id").alias("exemption_id"), F.col("label").alias("name")),
    }


@query(
    "qry10_sweep_nested",
    f"WITH {_SWEEP} SELECT p.provision_id, ptype, coalesce(t.x, '[]') AS tiers, coalesce(m.x, '[]') AS de_minimis, coalesce(x.x, '[]') AS exemptions FROM p LEFT JOIN t USING (provision_id) LEFT JOIN m USING (provision_id) LEFT JOIN x USING (provision_id)",
    "bp",
)
def sweep_nested(g: Graph) -> DataFrame:
    """Tiers, thresholds and exemptions of every provision as arrays of structs, shown as JSON."""
    rows = nested(g.provisions.select("provision_id", "ptype"), "provision_id", sweep_parts(g))
    return rows.select("provision_id", "ptype", *map(as_json, ("tiers", "de_minimis", "exemptions")))


_BLOCKERS = f"""k AS (SELECT provision_id, CAST(to_json(list({{'exception_id': entity_id, 'name': label}} ORDER BY entity_id, label)) AS VARCHAR) AS exceptions,
  CAST(to_json(list_sort(list(DISTINCT super_type))) AS VARCHAR) AS ip_types, bool_or(status = 'O') AS covers_transfer, bool_or(is_grower) AS covers_designation FROM b WHERE type_name = '{BUILDER}' GROUP BY 1)"""


def blocker_docs(g: Graph) -> DataFrame:
    """(provision_id, blocker_id, flags, exceptions, ip_types): one blocker a provision."""
    own = g.baskets.filter(F.col("type_name") == BUILDER)
    parents = own.groupBy("provision_id").agg(F.bool_or(F.col("status") == "O").alias("covers_transfer"), F.bool_or("is_grower").alias("covers_designation"))
    parts = {"exceptions": own.select("provision_id", F.col("entity_id").alias("exception_id"), F.col("label").alias("name")), "ip_types": own.select("provision_id", "super_type").distinct()}
    rows = nested(parents, "provision_id", parts)
    return rows.select("provision_id", F.concat(F.lit("jcrew_"), F.col("provision_id").cast("string")).alias("blocker_id"), "covers_transfer", "covers_designation", "exceptions", F.transform("ip_types", lambda x: x["super_type"]).alias("ip_types"))


@query("qry09_blockers_nested", f"WITH {_BLOCKERS} SELECT provision_id, 'jcrew_' || provision_id AS blocker_id, covers_transfer, covers_designation, exceptions, ip_types FROM k", "b")
def blockers_nested(g: Graph) -> DataFrame:
    """Blockers with the exceptions and the types they cover nested."""
    return blocker_docs(g).select("provision_id", "blocker_id", "covers_transfer", "covers_designation", as_json("exceptions"), as_json("ip_types"))


@query(
    "qry07_deal_nested",
    f"""WITH {_SWEEP}, {_BLOCKERS}, z AS (SELECT provision_id, CAST(to_json(list({{'entity_id': entity_id, 'type_name': type_name, 'amount': CAST(floor(amount) AS BIGINT)}} ORDER BY entity_id, type_name, floor(amount))) AS VARCHAR) AS x FROM b GROUP BY 1),
    v AS (SELECT p.deal_id, p.provision_id, ptype, md5(concat(coalesce(z.x, '[]'), coalesce(t.x, '[]'), coalesce(m.x, '[]'), coalesce(x.x, '[]'))) AS digest, k.provision_id IS NOT NULL AS has_blocker
      FROM p LEFT JOIN z USING (provision_id) LEFT JOIN t USING (provision_id) LEFT JOIN m USING (provision_id) LEFT JOIN x USING (provision_id) LEFT JOIN k USING (provision_id))
    SELECT d.deal_id, deal_name, coalesce(CAST(to_json(list({{'provision_id': v.provision_id, 'ptype': ptype, 'has_blocker': has_blocker, 'digest': digest}} ORDER BY v.provision_id) FILTER (WHERE v.provision_id IS NOT NULL)) AS VARCHAR), '[]') AS provisions
    FROM d LEFT JOIN v ON v.deal_id = d.deal_id GROUP BY 1, 2""",
    "bpd",
)
def deal_nested(g: Graph) -> DataFrame:
    """Deals with their provisions nested, and each provision with its baskets, blocker and sweep settings (shown by digest)."""
    baskets = g.baskets.select("provision_id", "entity_id", "type_name", whole("amount"))
    blockers = g.baskets.filter(F.col("type_name") == BUILDER).select("provision_id", "entity_id")
    inner = nested(g.provisions.select("provision_id", "deal_id", "ptype"), "provision_id", {"baskets": baskets, **sweep_parts(g), "blockers": blockers})
    digest = F.md5(F.concat(*[F.to_json(c) for c in ("baskets", "tiers", "de_minimis", "exemptions")]))
    provisions = inner.select("deal_id", "provision_id", "ptype", (F.size("blockers") > 0).alias("has_blocker"), digest.alias("digest"))
    rows = nested(g.deals.select("deal_id", "deal_name"), "deal_id", {"provisions": provisions})
    return rows.select("deal_id", "deal_name", as_json("provisions"))


@query(
    "qry14_graph",
    """WITH n AS (SELECT provision_id, CAST(to_json(list({'id': id, 'kind': kind, 'label': label} ORDER BY id, kind, label)) AS VARCHAR) AS nodes FROM
      (SELECT DISTINCT provision_id, entity_id AS id, 'basket' AS kind, type_name AS label FROM b UNION SELECT DISTINCT provision_id, 'source_' || suppkey, 'source', super_type FROM b) GROUP BY 1),
    e AS (SELECT provision_id, CAST(to_json(list({'a': a, 'b': b, 'relation': relation} ORDER BY a, b, relation)) AS VARCHAR) AS edges FROM
      (SELECT DISTINCT provision_id, 'p_' || provision_id AS a, entity_id AS b, 'has_basket' AS relation FROM b UNION SELECT DISTINCT provision_id, entity_id, 'source_' || suppkey, 'has_source' FROM b) GROUP BY 1)
    SELECT p.provision_id, deal_id, coalesce(nodes, '[]') AS nodes, coalesce(edges, '[]') AS edges FROM p LEFT JOIN n USING (provision_id) LEFT JOIN e USING (provision_id) WHERE ptype = 'rp'""",
    "bp",
)
def graph(g: Graph) -> DataFrame:
    """Nodes and edges of every restricted-payment provision: its baskets, their sources, and the relations between them."""
    # Baskets are shuffled once; nodes and edges are made of a provision's own, as short as they are stored.
    rows = nested(g.provisions_of("rp"), "provision_id", {"baskets": g.baskets.select("provision_id", "entity_id", "type_name", "super_type", "suppkey")})
    own = F.concat(F.lit("p_"), F.col("provision_id").cast("string"))
    source = lambda b: F.concat(F.lit("source_"), b["suppkey"].cast("string"))
    each = lambda *makers: F.array_sort(F.array_distinct(F.concat(*[F.transform("baskets", m) for m in makers])))
    node = lambda i, kind, label: F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    edge = lambda a, b, relation: F.struct(a.alias("a"), b.alias("b"), F.lit(relation).alias("relation"))
    nodes = each(lambda b: node(b["entity_id"], "basket", b["type_name"]), lambda b: node(source(b), "source", b["super_type"]))
    edges = each(lambda b: edge(own, b["entity_id"], "has_basket"), lambda b: edge(b["entity_id"], source(b), "has_source"))
    return rows.select("provision_id", "deal_id", nodes.alias("nodes"), edges.alias("edges")).select("provision_id", "deal_id", as_json("nodes"), as_json("edges"))


# Clean-up: deals hold provisions, these hold baskets and answers, baskets hold sources.


def key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def holdings(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the whole graph; a source is held by all baskets of its provision and supplier."""
    source = F.concat_ws("_", F.lit("s"), F.col("provision_id").cast("string"), F.col("suppkey").cast("string"))
    baskets = g.baskets.select(F.col("provision_id").alias("o"), F.col("entity_id"), source.alias("source")).withColumn("p", key("p", "o"))
    node = lambda df, kind, c: df.select(F.lit(kind).alias("type"), F.col(c).alias("id"))
    link = lambda df, a, x, b, y: df.select(F.lit(a).alias("holder_type"), F.col(x).alias("holder"), F.lit(b).alias("held_type"), F.col(y).alias("held"))
    provisions = g.provisions.select(key("d", "deal_id").alias("d"), key("p", "provision_id").alias("p"))
    given = g.answers.select(key("p", "provision_id").alias("p"), key("a", "answer_id").alias("a"))
    # Both kinds of one basket from one pass.
    held = baskets.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("type"), F.col(c).alias("id")) for kind, c in (("basket", "entity_id"), ("source", "source"))])))
    nodes = node(g.deals.select(key("d", "deal_id").alias("d")), "deal", "d").union(node(provisions, "provision", "p")).union(held).union(node(given, "answer", "a")).distinct()
    links = link(provisions, "deal", "d", "provision", "p").union(link(baskets, "provision", "p", "basket", "entity_id")).union(link(baskets, "basket", "entity_id", "source", "source")).union(link(given, "provision", "p", "answer", "a"))
    return nodes, links


_NODES = """nd AS (SELECT 'deal' AS type, 'd' || deal_id AS id FROM d UNION SELECT 'provision', 'p' || provision_id FROM p UNION SELECT 'basket', entity_id FROM b UNION SELECT 'source', concat_ws('_', 's', provision_id, suppkey) FROM b UNION SELECT 'answer', 'a' || answer_id FROM a)"""
_BELOW = """SELECT 'basket' AS type, entity_id AS id, 2 AS step FROM b WHERE provision_id IN (SELECT provision_id FROM gone) UNION SELECT 'source', concat_ws('_', 's', provision_id, suppkey), 1 FROM b WHERE provision_id IN (SELECT provision_id FROM gone)
  UNION SELECT 'answer', 'a' || answer_id, 2 FROM a WHERE provision_id IN (SELECT provision_id FROM gone)"""


@query("snk09_survivors", f"WITH {_NODES}, gone AS (SELECT provision_id FROM p WHERE deal_id % 10 = 0), x AS (SELECT type, id FROM ({_BELOW}) UNION SELECT 'deal', 'd' || deal_id FROM d WHERE deal_id % 10 = 0 UNION SELECT 'provision', 'p' || provision_id FROM gone) SELECT type, id FROM nd EXCEPT SELECT type, id FROM x", "bpda")
def survivors(g: Graph) -> DataFrame:
    """Keys of every table that are left when every tenth deal is deleted with all it holds."""
    nodes, links = holdings(g)
    roots = g.deals.filter("deal_id % 10 = 0").select(F.lit("deal").alias("type"), key("d", "deal_id").alias("id"))
    return M.bottom_up_delete(nodes, links, roots)[0].select("type", "id")


@query("oth08_cleanup", f"WITH gone AS (SELECT provision_id FROM p WHERE ptype = 'rp' AND deal_id % 10 = 3) {_BELOW}", "bpa")
def cleanup(g: Graph) -> DataFrame:
    """What goes before provisions are extracted anew, leaves first; the provisions and their links to deals stay."""
    nodes, links = holdings(g)
    roots = g.provisions_of("rp").filter("deal_id % 10 = 3").select(F.lit("provision").alias("type"), key("p", "provision_id").alias("id"))
    return M.bottom_up_delete(nodes, links, roots, keep_roots=True)[1].select("type", "id", "step")


# Lists held against each other.


@query(
    "qry29_expected_stored",
    """WITH e AS (SELECT user_id AS provision_id, event_type || '_' || (event_id % 6) AS item FROM events WHERE event_id % 3 = 0), s AS (SELECT user_id AS provision_id, event_type || '_' || (event_id % 7) AS item FROM events WHERE event_id % 3 <> 0 AND event_type <> 'error'),
    c AS (SELECT provision_id, item, sum(x) AS e, sum(y) AS s FROM (SELECT provision_id, item, 1 AS x, 0 AS y FROM e UNION ALL SELECT provision_id, item, 0, 1 FROM s) GROUP BY 1, 2)
    SELECT provision_id, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE s = 0), '') AS missing, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE e = 0), '') AS extra,
    coalesce(string_agg(item || ':' || CAST(s - e AS BIGINT), ',' ORDER BY item) FILTER (WHERE e > 0 AND s > 0 AND e <> s), '') AS surplus FROM c GROUP BY 1""",
)
def expected_stored(g: Graph) -> DataFrame:
    """Concepts that the questions of a provision expect against those stored, repeats counted."""
    n, user = F.col("event_id"), F.col("user_id").alias("provision_id")
    item = lambda m: F.concat_ws("_", "event_type", (n % m).cast("string")).alias("item")
    expected = g.table("events").filter(n % 3 == 0).select(user, item(6))
    stored = g.table("events").filter((n % 3 != 0) & (F.col("event_type") != "error")).select(user, item(7))
    found = M.multiset_difference(expected, stored, ["provision_id"], "item")
    shown = F.transform("surplus", lambda x: F.concat_ws(":", x["item"], x["n"].cast("string")))
    return found.select("provision_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), F.array_join(shown, ",").alias("surplus"))


# Listings with fallbacks: parts are questions, their brand a category where their covenant has any.


_QUESTIONS = "q AS (SELECT p_partkey AS n, p_type AS covenant, concat_ws('_', 'q', split_part(p_name, ' ', 2), p_partkey) AS question_id, p_name AS text, p_brand, p_size FROM part)"
_CATEGORY = "'Category ' || upper(substr(split_part(question_id, '_', 2), 1, 1))"


def listed_questions(g: Graph) -> DataFrame:
    name = F.concat_ws("_", F.lit("q"), word(1), F.col("p_partkey").cast("string"))
    return g.table("part").select(F.col("p_type").alias("covenant"), name.alias("question_id"), F.col("p_name").alias("text"), "p_brand", "p_size")


def letter() -> Column:
    return F.upper(F.substring(F.element_at(F.split("question_id", "_"), 2), 1, 1))


@query(
    "qry15_questions_by_covenant",
    f"""WITH {_QUESTIONS}, j AS (SELECT covenant, question_id, p_brand AS category_id, 'About ' || p_brand AS category_name, 0 AS source FROM q WHERE p_size % 2 = 0 AND covenant NOT IN ('SMALL', 'PROMO')),
    f AS (SELECT covenant, question_id, upper(substr(split_part(question_id, '_', 2), 1, 1)) AS category_id, {_CATEGORY} AS category_name, 1 AS source FROM q WHERE covenant NOT IN (SELECT covenant FROM j)) SELECT * FROM j UNION ALL SELECT * FROM f""",
)
def questions_by_covenant(g: Graph) -> DataFrame:
    """Questions of every covenant with their categories; a covenant without any linked category lists all its questions under their letters."""
    linked = listed_questions(g).filter((F.col("p_size") % 2 == 0) & ~F.col("covenant").isin("SMALL", "PROMO"))
    first = linked.select("covenant", "question_id", F.col("p_brand").alias("category_id"), F.concat(F.lit("About "), "p_brand").alias("category_name"))
    second = listed_questions(g).select("covenant", "question_id", letter().alias("category_id"), F.concat(F.lit("Category "), letter()).alias("category_name"))
    return first_source([first, second], ["covenant"])


@query("qry15_categories", "SELECT p_brand AS category_id, coalesce(min(CASE WHEN p_size > 45 THEN p_name END), '') AS name FROM part GROUP BY 1")
def category_list(g: Graph) -> DataFrame:
    """All categories; a missing name is empty."""
    return g.table("part").groupBy(F.col("p_brand").alias("category_id")).agg(F.coalesce(F.min(F.when(F.col("p_size") > 45, F.col("p_name"))), F.lit("")).alias("name"))


@query("qry15_questions", f"WITH {_QUESTIONS} SELECT question_id, coalesce(CASE WHEN p_size % 7 <> 0 THEN text END, '') AS text, coalesce(CASE WHEN p_size % 5 <> 0 THEN lower(p_brand) END, 'string') AS answer_type FROM q")
def question_list(g: Graph) -> DataFrame:
    """All questions; a missing text is empty, a missing type is ``string``."""
    size = F.col("p_size")
    return listed_questions(g).select("question_id", F.coalesce(F.when(size % 7 != 0, F.col("text")), F.lit("")).alias("text"), F.coalesce(F.when(size % 5 != 0, F.lower("p_brand")), F.lit("string")).alias("answer_type"))


@query("qry15_concepts", "SELECT concept_type, CAST(to_json(list({'concept_id': id, 'name': name} ORDER BY id, name)) AS VARCHAR) AS concepts FROM (SELECT DISTINCT p_type AS concept_type, p_brand AS id, lower(p_brand) AS name FROM part) GROUP BY 1")
def concept_list(g: Graph) -> DataFrame:
    """Concepts grouped by type."""
    part = g.table("part")
    rows = nested(part.select(F.col("p_type").alias("concept_type"), F.lit(1).alias("one")), "concept_type", {"concepts": part.select(F.col("p_type").alias("concept_type"), F.col("p_brand").alias("concept_id"), F.lower("p_brand").alias("name")).distinct()})
    return rows.select("concept_type", as_json("concepts"))


@query(
    "oth22_category_name",
    f"WITH {_QUESTIONS}, k AS (SELECT p_brand, min(p_name) AS name FROM part WHERE p_size > 47 GROUP BY 1) SELECT question_id, coalesce(k.name, {_CATEGORY}) AS category_name, CASE WHEN k.name IS NULL THEN 1 ELSE 0 END AS source FROM q LEFT JOIN k USING (p_brand)",
)
def category_names(g: Graph) -> DataFrame:
    """A question's category by name: that of the table, else ``Category X`` by its letter."""
    known = g.table("part").filter("p_size > 47").groupBy("p_brand").agg(F.min("p_name").alias("category_name"))
    asked = listed_questions(g).select("question_id", "p_brand")
    named = asked.join(known, "p_brand").select("question_id", "category_name")
    return first_source([named, asked.select("question_id", F.concat(F.lit("Category "), letter()).alias("category_name"))], ["question_id"]).select("question_id", "category_name", "source")


# Subtype chains.


@query("sch01_owned_attributes", "SELECT s AS type_name, p_brand AS attr, bool_or(p_size = 50 AND p_brand LIKE '%1') AS is_key FROM (SELECT unnest(range(1, 51)) AS s) JOIN part ON p_size >= s GROUP BY 1, 2")
def owned_attributes(g: Graph) -> DataFrame:
    """Attributes of every type of a chain of fifty, its own and those of all types above it."""
    part = g.table("part")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    sizes = g.spark.range(1, 51).select(F.col("id").alias("n"))  # the chain's links: catalog, not data
    closure = catalog.type_closure(sizes.filter("n < 50").select(name(F.col("n")).alias("sub"), name(F.col("n") + 1).alias("super")))
    owns = part.groupBy(name(F.col("p_size")).alias("type_name"), F.col("p_brand").alias("attr")).agg(F.bool_or((F.col("p_size") == 50) & F.col("p_brand").endswith("1")).alias("is_key"))
    owned = catalog.owned_attributes(owns, closure)
    return owned.select(F.substring("type_name", 2, 9).cast("long").alias("type_name"), "attr", "is_key")


@query("oth06_detect_covenant", f"WITH r AS ({ORACLE_SQL['rte03_covenant_resolve']}) SELECT n.question, coalesce(covenant, 'both') AS covenant FROM (SELECT p_partkey AS question FROM part UNION ALL SELECT p_partkey + 1000000 FROM part) n LEFT JOIN r USING (question)")
def detect_covenant(g: Graph) -> DataFrame:
    """The covenant that a question was resolved to; both where it was never routed."""
    part = g.table("part").select(F.col("p_partkey").alias("question"))
    asked = part.union(part.select(F.col("question") + 1_000_000))
    # Both sides have a row a question, so neither is sent whole to the tasks.
    return asked.join(texts.covenant_resolve(g).hint("merge"), "question", "left").select("question", F.coalesce("covenant", F.lit("both")).alias("covenant"))
