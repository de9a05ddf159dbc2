"""Schema catalog queries: fields, keys, relation wiring and storage, stored functions, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from .model import EBITDA, Graph, query


def word(i: int) -> Column:
    return F.split("p_name", " ")[i]


def brand_number() -> Column:
    # Filters on this are inferred for joined columns too, whose values need not be brands: hence no failing cast.
    return F.substring("p_brand", 7, 9).try_cast("int")


@query(
    "sch02_field_classes",
    """WITH o AS (SELECT DISTINCT p_type AS t, split_part(p_name, ' ', 1) AS attr FROM part WHERE (length(split_part(p_name, ' ', 1)) + length(p_type)) % 2 = 1),
    l AS (SELECT DISTINCT p_type || '/' || p_brand AS t, split_part(p_name, ' ', 2) AS attr FROM part WHERE (length(split_part(p_name, ' ', 2)) + length(p_brand)) % 2 = 1),
    s AS (SELECT DISTINCT p_type || '/' || p_brand AS sub, p_type AS super FROM part),
    f AS (SELECT * FROM (SELECT * FROM o UNION SELECT * FROM l UNION SELECT sub, attr FROM s JOIN o ON o.t = super) WHERE NOT ends_with(attr, 't') AND attr <> 'rod'),
    b AS (SELECT sub, super FROM s UNION SELECT super, 'basket' FROM s UNION SELECT sub, 'basket' FROM s)
    SELECT t AS type_name, CAST(NULL AS VARCHAR) AS subtype, attr FROM f
    UNION ALL SELECT super, sub, attr FROM b JOIN f ON f.t = sub WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.t = super AND g.attr = f.attr)""",
)
def field_classes(g: Graph) -> DataFrame:
    """Fields of every type and, for each of its subtypes, those that it adds; keys and shared attributes left out."""
    part = g.table("part")
    own = part.select(F.col("p_type").alias("type_name"), word(0).alias("attr")).filter((F.length("attr") + F.length("type_name")) % 2 == 1)
    leaf = part.filter((F.length(word(1)) + F.length("p_brand")) % 2 == 1).select(F.concat_ws("/", "p_type", "p_brand").alias("type_name"), word(1).alias("attr"))
    owns = own.unionByName(leaf).distinct().withColumn("is_key", F.col("attr").endswith("t"))
    closure = catalog.type_closure(g.sub())
    return catalog.field_classes(catalog.owned_attributes(owns, closure), closure, part.select(F.lit("rod").alias("attr")).distinct())


@query(
    "sch03_key_attribute",
    """WITH o AS (SELECT DISTINCT p_type AS t, split_part(p_name, ' ', 1) || '_id' AS attr FROM part WHERE p_size > 25)
    SELECT type_name, min(attr) AS key_attr FROM (SELECT t AS type_name, attr FROM o UNION ALL SELECT p_type || '/' || p_brand, attr FROM part JOIN o ON t = p_type) GROUP BY 1""",
)
def key_attribute(g: Graph) -> DataFrame:
    """The first owned or inherited attribute that ends like a key."""
    attr = F.when(F.col("p_size") > 25, F.concat(word(0), F.lit("_id"))).otherwise(word(0))
    owns = g.table("part").select(F.col("p_type").alias("type_name"), attr.alias("attr")).distinct().withColumn("is_key", F.lit(False))
    return catalog.key_attribute(catalog.owned_attributes(owns, catalog.type_closure(g.sub())))


@query(
    "sch07_entity_relation",
    """SELECT entity, relation, 'item' AS entity_role, 'provision' AS provision_role FROM
    (SELECT p_type AS entity, p_brand AS relation, row_number() OVER (PARTITION BY p_type ORDER BY CAST(substr(p_brand, 7) AS INT) % 3, p_brand) AS i FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size > 45)) WHERE i = 1""",
)
def entity_relation(g: Graph) -> DataFrame:
    """The relation by which an entity type hangs on a provision; the first covenant that has one wins."""
    covenants = ["rp", "mfn", "di"]
    linked = g.table("part").filter("p_size > 45").select("p_type", "p_brand", F.element_at(F.array(*map(F.lit, covenants)), brand_number() % 3 + 1).alias("covenant")).distinct()
    side = lambda who, role: linked.select(F.col(who).alias("type_name"), F.col("p_brand").alias("rel_type"), F.lit(role).alias("role")).distinct()
    plays = side("p_type", "item").unionByName(side("covenant", "provision"))
    return catalog.relation_wiring(plays, plays.select("rel_type", "role").distinct(), covenants)


@query(
    "sch08_relation_config",
    """WITH n AS (SELECT DISTINCT p_brand AS rel, CAST(substr(p_brand, 7) AS INT) AS n FROM part),
    r AS (SELECT rel, n % 3 AS k, unnest(CASE n % 3 WHEN 0 THEN ['provision', 'extracted', 'r' || (n % 4), 'r' || (n % 4 + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END)]
      WHEN 1 THEN ['parent', 'child', 'r' || (n % 4), 'r' || (n % 7)] ELSE ['extracted', 'r' || (n % 4), 'q' || (n % 2)] END) AS role FROM n),
    t1 AS (SELECT rel, min(role) AS role FROM r WHERE k = 0 AND role NOT IN ('provision', 'extracted') GROUP BY rel HAVING count(DISTINCT role) = 1),
    h AS (SELECT role, min(rel) AS via FROM t1 GROUP BY role),
    c AS (SELECT rel, min(role) AS a, max(role) AS b FROM r WHERE k = 1 AND role NOT IN ('parent', 'child') GROUP BY rel HAVING count(DISTINCT role) = 2),
    t2 AS (SELECT rel, CASE WHEN x.role IS NULL THEN b ELSE a END AS pr, CASE WHEN x.role IS NULL THEN a ELSE b END AS cr, coalesce(x.via, y.via) AS via
      FROM c LEFT JOIN h x ON x.role = a LEFT JOIN h y ON y.role = b WHERE coalesce(x.via, y.via) IS NOT NULL),
    t3 AS (SELECT rel, CASE WHEN n % 2 = 0 THEN 'r' || (n % 4) ELSE 'q1' END AS pr, CASE WHEN n % 2 = 0 THEN 'q0' ELSE 'r' || (n % 4) END AS cr FROM n WHERE n % 3 = 2 AND rel <> 'Brand#2')
    SELECT rel AS relation, 1 AS tier, 'provision' AS parent_role, role AS child_role, CAST(NULL AS VARCHAR) AS parent_relation FROM t1
    UNION ALL SELECT rel, 2, pr, cr, via FROM t2 UNION ALL SELECT rel, 3, pr, cr, NULL FROM t3""",
)
def relation_config(g: Graph) -> DataFrame:
    """Storage of every relation in three tiers."""
    brands = g.table("part").select(F.col("p_brand").alias("rel_type"), brand_number().alias("n")).distinct()
    role = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    kind, r = F.col("n") % 3, role("r", F.col("n") % 4)
    held = F.array(F.lit("provision"), F.lit("extracted"), r, role("r", F.col("n") % 4 + F.when(F.col("n") % 5 == 0, 1).otherwise(0)))
    child = F.array(F.lit("parent"), F.lit("child"), r, role("r", F.col("n") % 7))
    free = F.array(F.lit("extracted"), r, role("q", F.col("n") % 2))
    relates = brands.select("rel_type", F.explode(F.when(kind == 0, held).when(kind == 1, child).otherwise(free)).alias("role")).distinct()
    sub = brands.filter(kind < 2).select(F.col("rel_type").alias("sub"), F.when(kind == 0, "holds").otherwise("bears").alias("super"))
    plays = brands.filter((kind == 2) & (F.col("n") % 2 == 0)).select(F.lit("rp").alias("type_name"), "rel_type", r.alias("role"))
    plays = plays.unionByName(brands.filter(kind == 2).select(F.lit("mfn").alias("type_name"), "rel_type", role("q", F.col("n") % 2).alias("role")))
    return catalog.relation_config(catalog.type_closure(sub), relates, plays, ["rp", "mfn"], "holds", "bears", skip=("Brand#2",))


@query("snk12_stored_function", f"SELECT entity_id, CAST(pct AS DOUBLE) * {EBITDA} / 100 AS grown FROM b", "b")
def stored_function(g: Graph) -> DataFrame:
    """A function defined once by SQL and used by name; Catalyst puts its body in place."""
    g.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION share_of(pct DECIMAL(18,2), base DOUBLE) RETURNS DOUBLE RETURN CAST(pct AS DOUBLE) * base / 100")
    return g.baskets.select("entity_id", F.expr(f"share_of(pct, CAST({EBITDA} AS DOUBLE))").alias("grown"))


@query(
    "qry28_question_block",
    """SELECT p_type AS category, concat(p_type, ', ', count(*), ' questions') AS heading,
    string_agg(concat(p_partkey, ': ', p_name, ' [', CASE WHEN p_size % 2 = 0 THEN 'multiselect' ELSE 'number' END, ']', CASE WHEN p_size % 2 = 0 THEN concat(' of ', p_brand) END, CASE WHEN p_size % 5 = 0 THEN ' see definitions' END), chr(10) ORDER BY p_size, p_partkey) AS lines
    FROM part GROUP BY 1""",
)
def question_block(g: Graph) -> DataFrame:
    """A category's questions as text, in display order; as large as the catalog."""
    size, none = F.col("p_size"), F.lit("")
    kind = F.when(size % 2 == 0, "multiselect").otherwise("number")
    options, hint = F.when(size % 2 == 0, F.concat(F.lit(" of "), "p_brand")).otherwise(none), F.when(size % 5 == 0, " see definitions").otherwise(none)
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(": "), "p_name", F.lit(" ["), kind, F.lit("]"), options, hint)
    ordered = F.array_sort(F.collect_list(F.struct("p_size", "p_partkey", line.alias("line"))))
    blocks = g.table("part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.array_join(F.transform(ordered, lambda q: q["line"]), "\n").alias("lines"))
    return blocks.select("category", F.concat("category", F.lit(", "), "n", F.lit(" questions")).alias("heading"), "lines")


#: Seeds in load order: step, table, key, least number of entries.
_SEEDS = ((1, "region", "r_regionkey", 5), (2, "nation", "n_nationkey", 30), (3, "part", "p_type", 5), (4, "customer", "c_mktsegment", 4))


@query("qry31_seed_steps", " UNION ALL ".join(f"SELECT {i} AS step, '{t}' AS seed, count(DISTINCT {k}) AS loaded, count(DISTINCT {k}) >= {n} AS enough FROM {t}" for i, t, k, n in _SEEDS))
def seed_steps(g: Graph) -> DataFrame:
    """Entries of every seed in load order, against the least number expected."""
    step = lambda i, t, k, n: g.table(t).agg(F.count_distinct(k).alias("loaded")).select(F.lit(i).alias("step"), F.lit(t).alias("seed"), "loaded", (F.col("loaded") >= n).alias("enough"))
    first, *rest = [step(*s) for s in _SEEDS]
    for more in rest:
        first = first.unionByName(more)
    return first.orderBy("step")
