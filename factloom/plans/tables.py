"""Mutations, linking and the rule-based validator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import mutate as M
from .model import BUILDER, ORACLE_SQL, Graph, query


@query("snk02_match_insert", "SELECT provision_id, 'fee_' || CAST(provision_id AS VARCHAR) AS entity_id FROM p WHERE ptype = 'mfn'", "p")
def match_insert(g: Graph) -> DataFrame:
    """One new row for each match."""
    return g.provisions_of("mfn").select("provision_id", F.concat(F.lit("fee_"), F.col("provision_id").cast("string")).alias("entity_id"))


def existing_links(g: Graph) -> DataFrame:
    return g.provisions.filter("provision_id % 3 = 0").select("deal_id", "provision_id")


@query("snk03_insert_if_absent", "SELECT deal_id, provision_id FROM p WHERE provision_id % 3 = 0 UNION ALL SELECT deal_id, provision_id FROM p WHERE ptype = 'di' AND provision_id % 3 <> 0", "p")
def insert_if_absent(g: Graph) -> DataFrame:
    return M.insert_if_absent(existing_links(g), g.provisions_of("di").select("deal_id", "provision_id"), ["provision_id"])


@query("snk04_put", "SELECT type_name FROM (SELECT DISTINCT p_brand AS type_name FROM part WHERE p_size > 25 UNION SELECT p_brand FROM part)")
def put(g: Graph) -> DataFrame:
    part = g.table("part")
    return M.put(part.filter("p_size > 25").select(F.col("p_brand").alias("type_name")).distinct(), part.select(F.col("p_brand").alias("type_name")))


@query("snk05_first_write_wins", "SELECT user_id, event_type, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_write_wins(g: Graph) -> DataFrame:
    return M.first_write_wins(g.table("events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("snk06_default_if_unset", "SELECT entity_id, coalesce(CASE WHEN is_grower THEN category END, lower(super_type)) AS category FROM b", "b")
def default_if_unset(g: Graph) -> DataFrame:
    lookup = g.table("part").select(F.col("p_type").alias("super_type"), F.lower("p_type").alias("default_category")).distinct()
    base = g.baskets.select("entity_id", "super_type", F.when(F.col("is_grower"), F.col("category")).alias("category"))
    return M.default_if_unset(base, lookup, "super_type", "category", "default_category").select("entity_id", "category")


@query("snk07_delete_matched", f"SELECT entity_id FROM b WHERE provision_id NOT IN (SELECT provision_id FROM b WHERE type_name = '{BUILDER}')", "b")
def delete_matched(g: Graph) -> DataFrame:
    return M.delete_keys(g.baskets, g.baskets.filter(F.col("type_name") == BUILDER), ["provision_id"]).select("entity_id")


@query("snk08_delete_like", "SELECT entity_id FROM b WHERE NOT regexp_matches(entity_id, '^.*_7$')", "b")
def delete_like(g: Graph) -> DataFrame:
    return M.delete_like(g.baskets, "entity_id", ".*_7").select("entity_id")


@query("snk09_cascade_delete", "SELECT 'deals' AS name, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'provisions', count(*) FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'answers', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 0")
def cascade_delete(g: Graph) -> DataFrame:
    tables = {"deals": g.deals.select("deal_id"), "provisions": g.provisions.select("provision_id", "deal_id"), "answers": g.table("lineitem").select(F.col("l_orderkey").alias("provision_id"))}
    left = M.cascade_delete(tables, g.deals.filter("deal_id % 10 = 0").select("deal_id"))
    out = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("snk14_sha_dedup", "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sha_dedup(g: Graph) -> DataFrame:
    """Upload once for each content hash."""
    return g.table("documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("snk15_stub_creation", "SELECT DISTINCT user_id AS deal_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def stub_creation(g: Graph) -> DataFrame:
    wanted = g.table("events").select(F.col("user_id").alias("deal_id"))
    return M.new_rows(wanted, g.deals.filter("deal_id % 2 = 0"), ["deal_id"])


@query("snk16_attribute_replace", "SELECT deal_id, CASE WHEN deal_id % 5 = 0 THEN 'updated' ELSE segment END AS segment FROM d", "d")
def attribute_replace(g: Graph) -> DataFrame:
    new = g.deals.filter("deal_id % 5 = 0").select("deal_id", F.lit("updated").alias("segment"))
    return M.replace_attribute(g.deals.select("deal_id", "segment"), new, "deal_id", "segment")


_LINK = "SELECT x.deal_id, x.provision_id AS di_id, y.provision_id AS mfn_id FROM p x JOIN p y ON x.deal_id = y.deal_id WHERE x.ptype = 'di' AND y.ptype = 'mfn'"


def new_links(g: Graph) -> DataFrame:
    """Links of debt and pricing provisions of a deal that are not there yet."""
    di = g.provisions_of("di").select("deal_id", F.col("provision_id").alias("di_id"))
    mfn = g.provisions_of("mfn").select("deal_id", F.col("provision_id").alias("mfn_id"))
    pairs = di.join(mfn, "deal_id")
    return M.new_rows(pairs, pairs.filter("(di_id + mfn_id) % 4 = 0"), ["di_id", "mfn_id"]).select("deal_id", "di_id", "mfn_id")


query("qry20_link_insert", f"SELECT * FROM ({_LINK}) WHERE (di_id + mfn_id) % 4 <> 0", "p")(new_links)


@query("qry20_gated_trigger", f"SELECT DISTINCT l.di_id, l.mfn_id, b.entity_id FROM ({_LINK}) l JOIN b ON b.provision_id = l.di_id WHERE (di_id + mfn_id) % 4 <> 0 AND b.super_type = 'ECONOMY' AND b.qty >= 45", "pb")
def gated_trigger(g: Graph) -> DataFrame:
    """The second step runs only where the first inserted a link."""
    heavy = g.baskets.filter("super_type = 'ECONOMY' and qty >= 45").select(F.col("provision_id").alias("di_id"), "entity_id")
    return new_links(g).join(heavy, "di_id").select("di_id", "mfn_id", "entity_id").distinct()


@query("qry19_reallocation_edges", "SELECT b.entity_id AS source_id, coalesce('ref_' || CAST(n_nationkey AS VARCHAR), 'basket_' || CAST(suppkey AS VARCHAR)) AS target_id, CAST(amount AS DOUBLE) AS amount, 'additive' AS effect FROM b LEFT JOIN nation ON n_nationkey = suppkey WHERE type_name = 'Brand#12'", "b")
def reallocation_edges(g: Graph) -> DataFrame:
    """Edges to a known reference basket, else to a derived id."""
    nation = g.table("nation").select("n_nationkey")
    target = F.coalesce(F.concat(F.lit("ref_"), F.col("n_nationkey").cast("string")), F.concat(F.lit("basket_"), F.col("suppkey").cast("string")))
    return g.baskets.filter("type_name = 'Brand#12'").join(nation, F.col("suppkey") == F.col("n_nationkey"), "left").select(F.col("entity_id").alias("source_id"), target.alias("target_id"), F.col("amount").cast("double").alias("amount"), F.lit("additive").alias("effect"))


# Validator: parts stand for ontology statements (id = name, covenant = type, order = size).


@query("val01_duplicate_ids", "SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn > 1")
def duplicate_ids(g: Graph) -> DataFrame:
    """Second and later statements of an id."""
    first = g.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return g.table("part").join(first, "p_name").filter("p_partkey > first").select("p_partkey", "p_name")


@query("val02_snake_case", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^[a-z][a-z0-9_]*$')")
def snake_case(g: Graph) -> DataFrame:
    return g.table("part").filter(~F.col("p_name").rlike("^[a-z][a-z0-9_]*$")).select("p_partkey")


@query("val03_required_fields", "SELECT p_partkey FROM part WHERE p_name IS NULL OR trim(p_name) = '' OR (p_size % 9 = 0)")
def required_fields(g: Graph) -> DataFrame:
    blank = F.col("p_name").isNull() | (F.trim("p_name") == "")
    return g.table("part").filter(blank | (F.col("p_size") % 9 == 0)).select("p_partkey")


@query("val04_domain", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('SMALL', 'MEDIUM', 'LARGE')")
def domain(g: Graph) -> DataFrame:
    return g.table("part").filter(~F.col("p_type").isin("SMALL", "MEDIUM", "LARGE")).select("p_partkey", "p_type")


_BANDS = [("SMALL", 1, 20), ("MEDIUM", 10, 30), ("LARGE", 25, 50), ("PROMO", 1, 50)]
_BANDS_SQL = "bands(t, lo, hi) AS (VALUES " + ", ".join(f"('{t}', {a}, {b})" for t, a, b in _BANDS) + ")"


@query("val06_order_range", f"WITH {_BANDS_SQL} SELECT p_partkey, p_size FROM part JOIN bands ON t = p_type WHERE NOT p_size BETWEEN lo AND hi")
def order_range(g: Graph) -> DataFrame:
    bands = g.spark.createDataFrame(_BANDS, "t string, lo int, hi int")
    return g.table("part").join(bands, F.col("p_type") == F.col("t")).filter(~F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "p_size")


_PREFIXES = [("s", "SMALL"), ("sm", "MEDIUM"), ("r", "LARGE"), ("b", "PROMO"), ("bl", "ECONOMY")]


@query("val05_prefix_covenant", "WITH x(pre, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PREFIXES) + ") SELECT p_partkey, max_by(t, length(pre)) AS expected FROM part JOIN x ON starts_with(p_name, pre) GROUP BY 1, p_type HAVING max_by(t, length(pre)) <> p_type")
def prefix_covenant(g: Graph) -> DataFrame:
    """The longest known prefix of an id names its covenant."""
    x = g.spark.createDataFrame(_PREFIXES, "pre string, t string")
    hit = g.table("part").join(F.broadcast(x), F.startswith("p_name", "pre"))
    return hit.groupBy("p_partkey", "p_type").agg(F.max_by("t", F.length("pre")).alias("expected")).filter("expected <> p_type").select("p_partkey", "expected")


@query("val08_short_prompt", "SELECT item_id FROM benchmark WHERE length(text) < 160")
def short_prompt(g: Graph) -> DataFrame:
    return g.table("benchmark").filter(F.length("text") < 160).select("item_id")


@query("val09_hard_coded_section", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]+\\.[0-9]+')")
def hard_coded_section(g: Graph) -> DataFrame:
    return g.table("documents").filter(F.col("text").rlike(r"[0-9]+\.[0-9]+")).select("doc_id")


@query("val11_dangling_linkage", "SELECT DISTINCT l_partkey AS partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)")
def dangling_linkage(g: Graph) -> DataFrame:
    return g.table("lineitem").select(F.col("l_partkey").alias("partkey")).join(g.table("part").filter("p_size > 1").select(F.col("p_partkey").alias("partkey")), "partkey", "left_anti").distinct()


@query("val12_unlinked", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)")
def unlinked(g: Graph) -> DataFrame:
    return g.table("part").join(g.table("lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("set10_ordered_dedupe", "SELECT partkey, shipdate FROM (SELECT l_partkey AS partkey, strftime(l_shipdate, '%Y-%m-%d') AS shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def ordered_dedupe(g: Graph) -> DataFrame:
    """First occurrence in order."""
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return g.table("lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("l_partkey").alias("partkey"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"))


#: Severity of each check of this module.
SEVERITY = {"val01_duplicate_ids": "error", "val02_snake_case": "warning", "val03_required_fields": "error", "val04_domain": "error", "val05_prefix_covenant": "warning", "val06_order_range": "warning", "val08_short_prompt": "warning", "val09_hard_coded_section": "warning", "val11_dangling_linkage": "error", "val12_unlinked": "warning"}
_FINDINGS = " UNION ALL ".join(f"SELECT '{sev}' AS severity, '{name}' AS found FROM ({ORACLE_SQL[name]})" for name, sev in SEVERITY.items())


@query("val13_severity_rollup", f"SELECT severity, count(*) AS n, count(DISTINCT found) AS checks, severity = 'error' AS fails FROM ({_FINDINGS}) GROUP BY 1")
def severity_rollup(g: Graph) -> DataFrame:
    """All findings of the checks by severity; errors make the validator fail."""
    checks = (duplicate_ids, snake_case, required_fields, domain, prefix_covenant, order_range, short_prompt, hard_coded_section, dangling_linkage, unlinked)
    found = [f(g).select(F.lit(sev).alias("severity"), F.lit(name).alias("found")) for f, (name, sev) in zip(checks, SEVERITY.items(), strict=True)]
    return reduce(DataFrame.union, found).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("found").alias("checks")).withColumn("fails", F.col("severity") == "error")
