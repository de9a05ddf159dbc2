"""Stored functions as set-valued queries: one row a provision, for all provisions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..operators.match import checked, strict_sum
from .model import BUILDER, EBITDA, INCREMENTAL, RATIO, Graph, dollars, query


def of(g: Graph, ptype: str) -> DataFrame:
    """Baskets of all provisions of a type."""
    return g.baskets.join(g.provisions_of(ptype).select("provision_id"), "provision_id")


def general_capacity(g: Graph) -> DataFrame:
    return of(g, "rp").filter((F.col("category") == "general_purpose") & (F.col("type_name") != BUILDER)).groupBy("provision_id").agg(dollars("amount", "capacity"))


def builder_starter(g: Graph) -> DataFrame:
    return of(g, "rp").filter(F.col("type_name") == BUILDER).groupBy("provision_id").agg(F.min("amount").cast("double").alias("starter"))


_RP = "JOIN p USING (provision_id) WHERE ptype = 'rp'"
_DI = "JOIN p USING (provision_id) WHERE ptype = 'di'"

query("fun01_general_capacity", f"SELECT provision_id, CAST(sum(amount) AS DOUBLE) AS capacity FROM b {_RP} AND category = 'general_purpose' AND type_name <> '{BUILDER}' GROUP BY 1", "bp")(general_capacity)
query("fun02_builder_starter", f"SELECT provision_id, CAST(min(amount) AS DOUBLE) AS starter FROM b {_RP} AND type_name = '{BUILDER}' GROUP BY 1", "bp")(builder_starter)


@query(
    "fun03_day_one_capacity",
    f"""WITH g AS (SELECT provision_id, sum(amount) AS c FROM b {_RP} AND category = 'general_purpose' AND type_name <> '{BUILDER}' GROUP BY 1),
    s AS (SELECT provision_id, min(amount) AS s FROM b {_RP} AND type_name = '{BUILDER}' GROUP BY 1)
    SELECT provision_id, round(CAST(c + s AS DOUBLE), 2) AS capacity FROM g JOIN s USING (provision_id)""",
    "bp",
)
def day_one_capacity(g: Graph) -> DataFrame:
    return strict_sum(general_capacity(g), builder_starter(g), "provision_id", F.col("capacity"), F.col("starter"), "capacity").withColumn("capacity", F.round("capacity", 2))


@query("fun04_capacity_by_category", f"SELECT provision_id, category, CAST(sum(amount) AS DOUBLE) AS capacity FROM b {_RP} GROUP BY 1, 2", "bp")
def capacity_by_category(g: Graph) -> DataFrame:
    return of(g, "rp").groupBy("provision_id", "category").agg(dollars("amount", "capacity"))


def _builder_flag(name: str, column: str, test, sql: str) -> None:
    @query(
        name,
        f"""SELECT provision_id, x.provision_id IS NOT NULL AS {column} FROM p
        LEFT JOIN (SELECT DISTINCT provision_id FROM b WHERE type_name = '{BUILDER}' AND {sql}) x USING (provision_id) WHERE ptype = 'rp'""".replace("SELECT provision_id, x.provision_id IS NOT NULL", "SELECT p.provision_id, x.provision_id IS NOT NULL"),
        "bp",
    )
    def run(g: Graph) -> DataFrame:
        return checked(g.provisions_of("rp"), g.baskets.filter((F.col("type_name") == BUILDER) & test()), "provision_id", column)


_builder_flag("fun05_cni_accumulation", "has_cni", lambda: F.col("qty") > 25, "qty > 25")
_builder_flag("fun06_ecf_accumulation", "has_ecf", lambda: F.col("status") == "O", "status = 'O'")
_builder_flag("fun07_ebitda_fc_accumulation", "has_ebitda_fc", lambda: F.col("pct") > 4, "pct > 4")


@query("fun08_incremental_capacity", f"SELECT provision_id, CAST(min(cap) AS DOUBLE) AS capacity FROM b {_DI} AND super_type = '{INCREMENTAL}' AND cap IS NOT NULL GROUP BY 1", "bp")
def incremental_capacity(g: Graph) -> DataFrame:
    return of(g, "di").filter((F.col("super_type") == INCREMENTAL) & F.col("cap").isNotNull()).groupBy("provision_id").agg(F.min("cap").cast("double").alias("capacity"))


@query("fun09_basket_capacity", f"SELECT provision_id, type_name, CAST(min(cap) AS DOUBLE) AS capacity FROM b {_DI} AND cap IS NOT NULL GROUP BY 1, 2", "bp")
def basket_capacity(g: Graph) -> DataFrame:
    """Exact type; the smallest instead of an arbitrary first."""
    return of(g, "di").filter(F.col("cap").isNotNull()).groupBy("provision_id", "type_name").agg(F.min("cap").cast("double").alias("capacity"))


@query("fun10_grower_capacity", f"SELECT provision_id, CAST(sum(pct) AS DOUBLE) * {EBITDA} / 100 AS capacity FROM b {_DI} AND is_grower GROUP BY 1", "bp")
def grower_capacity(g: Graph) -> DataFrame:
    return of(g, "di").filter("is_grower").groupBy("provision_id").agg((F.sum("pct").cast("double") * EBITDA / 100).alias("capacity"))


@query("fun11_capped_capacity", f"SELECT provision_id, CAST(sum(cap) AS DOUBLE) AS capacity FROM b {_DI} AND cap IS NOT NULL GROUP BY 1", "bp")
def capped_capacity(g: Graph) -> DataFrame:
    return of(g, "di").filter(F.col("cap").isNotNull()).groupBy("provision_id").agg(dollars("cap", "capacity"))


def priming_risk(g: Graph) -> DataFrame:
    """Permitted, but without a trigger of the pricing protection."""
    return checked(g.provisions_of("di"), g.baskets.filter((F.col("super_type") == INCREMENTAL) & (F.col("qty") >= 30) & ~F.col("is_grower")), "provision_id", "priming_risk")


def trapdoor(g: Graph) -> DataFrame:
    return checked(g.provisions_of("di"), g.baskets.filter((F.col("super_type") == RATIO) & (F.col("status") == "O") & F.col("cap").isNull()), "provision_id", "trapdoor")


_PRIMING = f"EXISTS (SELECT 1 FROM b WHERE b.provision_id = p.provision_id AND super_type = '{INCREMENTAL}' AND qty >= 30 AND NOT is_grower)"
_TRAPDOOR = f"EXISTS (SELECT 1 FROM b WHERE b.provision_id = p.provision_id AND super_type = '{RATIO}' AND status = 'O' AND cap IS NULL)"
query("fun12_priming_risk", f"SELECT provision_id, {_PRIMING} AS priming_risk FROM p WHERE ptype = 'di'", "bp")(priming_risk)
query("fun13_trapdoor", f"SELECT provision_id, {_TRAPDOOR} AS trapdoor FROM p WHERE ptype = 'di'", "bp")(trapdoor)


@query("fun14_count_baskets", f"SELECT provision_id, count(*) AS n FROM b {_DI} GROUP BY 1", "bp")
def count_baskets(g: Graph) -> DataFrame:
    return of(g, "di").groupBy("provision_id").agg(F.count(F.lit(1)).alias("n"))


@query("fun15_count_growers", f"SELECT provision_id, count(*) AS n FROM b {_DI} AND is_grower GROUP BY 1", "bp")
def count_growers(g: Graph) -> DataFrame:
    return of(g, "di").filter("is_grower").groupBy("provision_id").agg(F.count(F.lit(1)).alias("n"))


@query("fun16_basket_types", f"SELECT DISTINCT provision_id, type_name FROM b {_DI}", "bp")
def basket_types(g: Graph) -> DataFrame:
    return of(g, "di").select("provision_id", "type_name").distinct()


@query("fun17_annotations", "SELECT DISTINCT p_brand AS type_name, split_part(p_name, ' ', 2) AS attr, p_name AS question_text FROM part")
def annotations(g: Graph) -> DataFrame:
    return g.table("part").select(F.col("p_brand").alias("type_name"), F.split("p_name", " ")[1].alias("attr"), F.col("p_name").alias("question_text")).distinct()


@query("svc1_vulnerability_report", f"SELECT provision_id, {_PRIMING} AS priming_risk, {_TRAPDOOR} AS trapdoor FROM p WHERE ptype = 'di'", "bp")
def vulnerability_report(g: Graph) -> DataFrame:
    return priming_risk(g).join(trapdoor(g), "provision_id")


@query("agg06_group_count", "SELECT type_name, count(*) AS n FROM b GROUP BY 1", "b")
def group_count(g: Graph) -> DataFrame:
    return g.baskets.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))


@query("agg08_group_into_list", "SELECT provision_id, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM b GROUP BY 1", "b")
def group_into_list(g: Graph) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string"))
    return g.baskets.groupBy("provision_id").agg(F.array_join(listed, ",").alias("lines"))


@query("agg09_group_into_set", "SELECT provision_id, string_agg(DISTINCT super_type, ',' ORDER BY super_type) AS kinds FROM b GROUP BY 1", "b")
def group_into_set(g: Graph) -> DataFrame:
    return g.baskets.groupBy("provision_id").agg(F.array_join(F.array_sort(F.collect_set("super_type")), ",").alias("kinds"))


@query("agg11_usage_totals", "SELECT user_id AS deal_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_cost, count(*) AS calls FROM events GROUP BY 1")
def usage_totals(g: Graph) -> DataFrame:
    return g.table("events").groupBy(F.col("user_id").alias("deal_id")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_cost"), F.count(F.lit(1)).alias("calls"))


@query("agg12_cost_over_traces", "SELECT event_type, CAST(sum(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS cost FROM events GROUP BY 1")
def cost_over_traces(g: Graph) -> DataFrame:
    """Missing traces add nothing."""
    k = F.get_json_object("props", "$.k").cast("long")
    return g.table("events").groupBy("event_type").agg(F.sum(F.coalesce(F.when(k > 50, F.col("value").cast("decimal(18,2)")), F.lit(0).cast("decimal(18,2)"))).cast("double").alias("cost"))


@query(
    "agg13_category_covenant",
    """SELECT deal_id, label, CASE WHEN count(DISTINCT ptype) = 1 AND min(ptype) IN ('mfn', 'di') THEN min(ptype) ELSE 'rp' END AS covenant
    FROM b JOIN p USING (provision_id) GROUP BY 1, 2""",
    "bp",
)
def category_covenant(g: Graph) -> DataFrame:
    """The covenant of every label of a deal: one kind if all its provisions agree on it, else rp."""
    kinds = g.baskets.join(g.provisions, "provision_id").groupBy("deal_id", "label").agg(F.collect_set("ptype").alias("s"))
    return kinds.select("deal_id", "label", F.when((F.size("s") == 1) & F.col("s")[0].isin("mfn", "di"), F.col("s")[0]).otherwise("rp").alias("covenant"))


@query("agg14_attributes_of_all", "SELECT p_size AS attr FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)")
def attributes_of_all(g: Graph) -> DataFrame:
    """Sizes that every type owns."""
    owned = g.table("part").select(F.col("p_type").alias("type_name"), F.col("p_size").cast("string").alias("attr"))
    return catalog.attributes_of_all(owned, owned).select(F.col("attr").cast("int").alias("attr"))


@query("agg15_distinct_types", "SELECT DISTINCT answer_type FROM a", "a")
def distinct_types(g: Graph) -> DataFrame:
    return g.answers.select("answer_type").distinct()


@query(
    "agg16_pivot_counts",
    """SELECT provision_id, count(*) FILTER (WHERE answer_type = 'click') AS click, count(*) FILTER (WHERE answer_type = 'error') AS error,
    count(*) FILTER (WHERE answer_type = 'view') AS viewed FROM a GROUP BY 1""",
    "a",
)
def pivot_counts(g: Graph) -> DataFrame:
    return g.answers.groupBy("provision_id").agg(*[F.count_if(F.col("answer_type") == k).alias(n) for k, n in (("click", "click"), ("error", "error"), ("view", "viewed"))])


@query("agg17_threshold_check", "SELECT type_name, count(*) AS n, CASE WHEN count(*) >= 2400 THEN 'OK' ELSE 'LOW' END AS state FROM b GROUP BY 1", "b")
def threshold_check(g: Graph) -> DataFrame:
    return g.baskets.groupBy("type_name").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.when(F.col("n") >= 2400, "OK").otherwise("LOW"))


@query(
    "agg18_deals_with_sources",
    f"""SELECT deal_id, deal_name, CAST(n AS BIGINT) AS sources FROM d JOIN (SELECT deal_id, CAST(bool_or(qty > 25) AS INT) + CAST(bool_or(status = 'O') AS INT)
    + CAST(bool_or(pct > 4) AS INT) + CAST(bool_or(is_grower) AS INT) AS n FROM b JOIN p USING (provision_id) WHERE ptype = 'rp' AND type_name = '{BUILDER}' GROUP BY 1) USING (deal_id) WHERE n >= 3""",
    "bpd",
)
def deals_with_sources(g: Graph, min_sources: int = 3) -> DataFrame:
    """Deals whose builder basket has at least ``min_sources`` kinds of source."""
    flags = [F.col("qty") > 25, F.col("status") == "O", F.col("pct") > 4, F.col("is_grower")]
    per_deal = g.baskets.filter(F.col("type_name") == BUILDER).join(g.provisions_of("rp"), "provision_id").groupBy("deal_id").agg(sum(F.bool_or(f).cast("long") for f in flags).alias("sources"))
    return per_deal.filter(F.col("sources") >= min_sources).join(g.deals, "deal_id").select("deal_id", "deal_name", "sources")
