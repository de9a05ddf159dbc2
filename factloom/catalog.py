"""Type catalog: subtype closure, owned attributes, roles.

The catalog holds schema, not data: its size is that of a schema file, so closures
are built once and type tests become ``IN`` lists that reach the scan as filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.shared import cut

def type_closure(sub: DataFrame) -> DataFrame:
    """(sub, super, depth) for every type and each of its supertypes, itself included at depth 0.

    Paths are doubled until no pair is new, so a chain of n types takes about log2(n)
    rounds; each leaves a checkpoint. A cycle raises ValueError.
    """
    edges = sub.select(F.col("sub"), F.col("super")).filter("sub is not null and super is not null").distinct()
    reach, known = cut(edges.withColumn("depth", F.lit(1))), -1
    while True:
        n, cycle = reach.agg(F.count(F.lit(1)), F.coalesce(F.bool_or(F.col("sub") == F.col("super")), F.lit(False))).first()
        if cycle:
            raise ValueError("types form a cycle")
        if n == known:
            break
        known = n
        twice = reach.alias("a").join(reach.alias("b"), F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        reach = cut(reach.union(twice).groupBy("sub", "super").agg(F.min("depth").alias("depth")))
    names = edges.select("sub").union(edges.select("super")).distinct()
    return names.select("sub", F.col("sub").alias("super"), F.lit(0).alias("depth")).union(reach)


def subtypes(closure: DataFrame, name: str) -> list[str]:
    """Names of a type and its subtypes (schema-sized)."""
    return sorted({name, *(r[0] for r in closure.filter(F.col("super") == name).select("sub").collect())})


def owned_attributes(owns: DataFrame, closure: DataFrame) -> DataFrame:
    """(type_name, attr, is_key): attributes a type owns itself or by inheritance."""
    inherited = closure.join(owns, closure.super == owns.type_name).select(closure.sub.alias("type_name"), "attr", "is_key")
    return inherited.unionByName(owns.select("type_name", "attr", "is_key")).groupBy("type_name", "attr").agg(F.max("is_key").alias("is_key"))


def key_attribute(owned: DataFrame, suffix: str = "_id") -> DataFrame:
    """(type_name, key_attr): the first owned attribute with the key suffix."""
    return owned.filter(F.col("attr").endswith(suffix)).groupBy("type_name").agg(F.min("attr").alias("key_attr"))


def attributes_of_all(owned: DataFrame, types: DataFrame, suffix: str = "_id") -> DataFrame:
    """Attributes owned by every one of ``types``, key attributes left out (universal quantification)."""
    wanted = types.select("type_name").distinct()
    need = wanted.agg(F.count(F.lit(1)).alias("need"))
    shared = owned.join(wanted, "type_name").groupBy("attr").agg(F.count_distinct("type_name").alias("have"))
    return shared.join(need, F.col("have") == F.col("need")).filter(~F.col("attr").endswith(suffix)).select("attr")


def leaf_types(sub: DataFrame, types: DataFrame) -> DataFrame:
    """Types without subtypes."""
    return types.select("type_name").join(sub.select(F.col("super").alias("type_name")), "type_name", "left_anti")


def relation_wiring(plays: DataFrame, relates: DataFrame, order: list[str]) -> DataFrame:
    """(entity, relation, entity_role, provision_role): how entities hang on provisions, first of ``order`` wins."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("p.type_name"))
    pairs = plays.alias("e").join(plays.alias("p"), (F.col("e.rel_type") == F.col("p.rel_type")) & (F.col("e.role") != F.col("p.role"))).filter(F.col("p.type_name").isin(*order) & ~F.col("e.type_name").isin(*order))
    known = pairs.join(relates.alias("r"), (F.col("r.rel_type") == F.col("e.rel_type")) & (F.col("r.role") == F.col("e.role")), "left_semi")
    best = known.groupBy(F.col("e.type_name").alias("entity")).agg(F.min(F.struct(rank.alias("rank"), F.col("e.rel_type").alias("relation"), F.col("e.role").alias("entity_role"), F.col("p.role").alias("provision_role"))).alias("w"))
    return best.select("entity", "w.relation", "w.entity_role", "w.provision_role")


def value_types(owned: DataFrame, declared: DataFrame) -> DataFrame:
    """(type_name, attr, value_type) with the names used for storage; unknown types are stored as strings."""
    kind = F.col("value_type")
    name = F.when(kind.isin("boolean", "double", "string", "long"), kind).when(kind == "integer", "long").when(kind == "decimal", "double").when(kind.isin("date", "datetime", "datetime-tz"), "datetime").otherwise("string")
    return owned.join(declared, "attr").select("type_name", "attr", name.alias("value_type"))


def child_bearing(extracted: DataFrame, parents: DataFrame) -> DataFrame:
    """(ptype, has_children): whether any extracted type of a provision type plays a parent's role."""
    known = parents.select("type_name").distinct().withColumn("_parent", F.lit(True))
    return extracted.distinct().join(known, "type_name", "left").groupBy("ptype").agg(F.coalesce(F.bool_or("_parent"), F.lit(False)).alias("has_children"))


def resolved_subtype(declared: Column, names: list[str]) -> Column:
    """``declared`` if it is one of ``names``, else the first that contains it, else the first; null counts as empty."""
    said, known = F.coalesce(declared, F.lit("")), F.array(*map(F.lit, sorted(names))).cast("array<string>")
    holding = F.filter(known, lambda n: F.contains(n, said))
    return F.when(F.array_contains(known, said), said).otherwise(F.coalesce(F.try_element_at(holding, F.lit(1)), F.try_element_at(known, F.lit(1))))


def field_classes(owned: DataFrame, closure: DataFrame, shared: DataFrame) -> DataFrame:
    """(type_name, subtype, attr): fields to extract; a subtype's row holds what it has beside the type's own.

    Keys and the attributes of ``shared`` (provenance) are no fields; ``subtype`` is null for the type's own.
    """
    fields = owned.filter(~F.coalesce("is_key", F.lit(False))).join(shared.select("attr"), "attr", "left_anti").select("type_name", "attr").distinct()
    below = closure.filter("depth > 0").select(F.col("super").alias("type_name"), F.col("sub").alias("subtype"))
    more = below.join(fields.withColumnRenamed("type_name", "subtype"), "subtype").join(fields, ["type_name", "attr"], "left_anti")
    return fields.withColumn("subtype", F.lit(None).cast("string")).unionByName(more).select("type_name", "subtype", "attr")


def relation_config(closure: DataFrame, relates: DataFrame, plays: DataFrame, provision_types: list[str], entity_root: str, child_root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(relation, tier, parent_role, child_role, parent_relation): how a relation's rows are stored.

    Tier 1 hangs an entity on a provision (one role beside the general ones), tier 2
    hangs a child on a tier-1 entity (two roles, one of them known from tier 1), tier 3
    is any other relation in which a provision plays one of two roles. Ties go to the
    first provision type, then the first name; relations of other shapes are left out.
    """

    def roles(root: str, *general: str) -> DataFrame:
        below = closure.filter((F.col("super") == root) & (F.col("depth") > 0)).select(F.col("sub").alias("relation"))
        named = below.join(relates.select(F.col("rel_type").alias("relation"), "role"), "relation").filter(~F.col("role").isin(*general))
        return named.groupBy("relation").agg(F.sort_array(F.collect_set("role")).alias("roles"))

    def rows(df: DataFrame, tier: int, parent, child, via) -> DataFrame:
        return df.select("relation", F.lit(tier).alias("tier"), parent.alias("parent_role"), child.alias("child_role"), via.cast("string").alias("parent_relation"))

    first_role, second_role = F.col("roles")[0], F.col("roles")[1]
    first = rows(roles(entity_root, "provision", "extracted").filter(F.size("roles") == 1), 1, F.lit("provision"), first_role, F.lit(None))
    holders = first.groupBy(F.col("child_role").alias("held")).agg(F.min("relation").alias("via"))
    pairs = roles(child_root, "parent", "child").filter(F.size("roles") == 2)
    under = pairs.withColumn("held", F.explode("roles")).join(holders, "held").groupBy("relation", "roles").agg(F.min(F.struct("held", "via")).alias("p"))
    second = rows(under, 2, F.col("p.held"), F.when(first_role == F.col("p.held"), second_role).otherwise(first_role), F.col("p.via"))
    rank = F.array_position(F.array(*map(F.lit, provision_types)), F.col("type_name"))
    played = plays.filter(F.col("type_name").isin(*provision_types)).groupBy(F.col("rel_type").alias("relation")).agg(F.min(F.struct(rank.alias("rank"), "role"))["role"].alias("held"))
    known = first.unionByName(second).select("relation")
    rest = played.join(known, "relation", "left_anti")
    if skip:
        rest = rest.filter(~F.col("relation").isin(*skip))
    other = rest.join(relates.select(F.col("rel_type").alias("relation"), "role"), "relation").filter((F.col("role") != F.col("held")) & ~F.col("role").isin("extracted", "parent", "child"))
    third = rows(other.groupBy("relation", "held").agg(F.collect_set("role").alias("roles")).filter(F.size("roles") == 1), 3, F.col("held"), first_role, F.lit(None))
    return first.unionByName(second).unionByName(third)
