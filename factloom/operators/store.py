"""Storing extracted answers: classified once, routed by catalog rows, ids resolved, what doesn't fit given back with its reason.

Answers have answer_id, provision_id, question, said (the type that the extraction
claims), items (a list value: array of structs with idx, concept and amount), number and
truth; a value is one of items, number or truth. Questions have question, qtype, target
(entity type), attr and relation; config is that of ``catalog.relation_config``.

Relations, entity types and the routing table are as large as the schema and sent to the tasks.

Where several answers write one id or one attribute, the smallest answer id stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mutate import business_id
from .ranking import first_by

#: Marks a question whose positive answer says that an entity exists.
EXISTS = "_exists"


def classified(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with their question's columns and ``phase``: entities, multiselect or scalar, or null with a ``reason``.

    A list that the question doesn't ask for is a multiselect; a plain value claimed as
    a list, but not asked for as one, is a scalar.
    """
    rows = answers.join(questions, "question", "left")
    listed, wanted = F.col("items").isNotNull(), F.col("qtype").eqNullSafe(F.lit("entity_list"))
    empty = ~listed & F.col("number").isNull() & F.col("truth").isNull()
    claims = F.col("said") == "entity_list"
    reason = F.when(empty, "no value").when(claims & wanted & ~listed, "not a list")
    phase = F.when(claims & wanted, "entities").when(claims & listed | (F.col("said") == "multiselect"), "multiselect").otherwise("scalar")
    return rows.withColumn("reason", reason).withColumn("phase", F.when(reason.isNull(), phase))


def list_types(questions: DataFrame) -> DataFrame:
    """Types that lists create; no single instance of them is made."""
    return F.broadcast(questions.filter("qtype = 'entity_list'").select("target").distinct())


def candidates(rows: DataFrame, questions: DataFrame, config: DataFrame) -> DataFrame:
    """One row an entity to create: the items of lists, and single instances (item null) that an answer says exist; with the storage of its relation, null if unknown."""
    keep = ["answer_id", "provision_id", "target", "relation"]
    # One pass over the answers: the items of a list, or one item without values.
    many = F.when(F.col("phase") == "entities", F.transform("items", lambda x: F.struct(x["idx"].alias("item"), x["amount"].alias("amount"))))
    single = (F.col("phase") == "scalar") & (F.col("attr") == EXISTS) & F.col("truth") & F.col("by_list").isNull()
    one = F.array(F.struct(F.lit(None).cast("int").alias("item"), F.lit(None).cast("double").alias("amount")))
    named_by = list_types(questions).withColumn("by_list", F.lit(True))
    made = rows.join(named_by, "target", "left").select(*keep, F.explode(many.when(single, one)).alias("x")).select(*keep, "x.item", "x.amount")
    wired = made.join(F.broadcast(config), "relation", "left")
    named = wired.withColumn("slot", F.coalesce(F.col("item").cast("string"), F.lit("single")))
    return named.withColumn("entity_id", business_id("e_", "provision_id", "target", "slot")).drop("slot")


def resolved(made: DataFrame) -> DataFrame:
    """Candidates with ``parent_id`` and, where they are not stored, a ``reason``.

    Entities of tiers 1 and 3 hang on their provision; one of tier 2 hangs on the first
    entity (by item, then id) that its parent relation holds for the same provision.
    """
    order = [F.col("answer_id").asc(), F.col("item").asc_nulls_first()]
    top = made.filter("tier <> 2")
    held = first_by(top, ["entity_id"], *order).groupBy("provision_id", F.col("relation").alias("parent_relation")).agg(F.min(F.struct(F.coalesce("item", F.lit(-1)).alias("item"), "entity_id")).alias("h"))
    parents = held.select("provision_id", "parent_relation", F.col("h.entity_id").alias("held_by"))
    linked = made.join(parents, ["provision_id", "parent_relation"], "left")
    parent = F.when(F.col("tier") == 2, F.col("held_by")).otherwise(F.concat(F.lit("p_"), F.col("provision_id").cast("string")))
    placed = linked.withColumn("parent_id", F.when(F.col("tier").isNotNull(), parent))
    failed = F.when(F.col("tier").isNull(), "no relation config").when(F.col("parent_id").isNull(), "no parent")
    checked = placed.withColumn("failed", failed)
    # Failed rows are told apart from the one that stands for an id by the id they are grouped under.
    group = F.when(F.col("failed").isNull(), F.col("entity_id")).otherwise(F.concat_ws(":", F.lit("x"), "answer_id", "item"))
    first = F.min(F.struct("answer_id", F.coalesce("item", F.lit(-1)).alias("i"))).over(Window.partitionBy("group"))
    marked = checked.withColumn("group", group).withColumn("first", first)
    own = (F.col("answer_id") == F.col("first.answer_id")) & (F.coalesce("item", F.lit(-1)) == F.col("first.i"))
    return marked.withColumn("reason", F.coalesce("failed", F.when(~own, "id taken"))).drop("group", "first", "failed", "held_by")


def stored_entities(found: DataFrame) -> DataFrame:
    return found.filter("reason is null").select("entity_id", F.col("target").alias("type_name"), "provision_id", "relation", "tier", "parent_role", "child_role", "parent_id", "answer_id")


def attribute_writes(rows: DataFrame, found: DataFrame, questions: DataFrame, routing: DataFrame) -> DataFrame:
    """(answer_id, provision_id, target, entity_id, attr, value): everything that is to be written on entities.

    Items write on the entity they made (``entity_id``); scalars and, by ``routing``
    (concept, target, attr), the chosen concepts write on a provision's single instance.
    """
    own = found.filter("reason is null and amount is not null").select("answer_id", "provision_id", "target", "entity_id", F.lit("amount").alias("attr"), F.col("amount").alias("value"))
    value = F.coalesce("number", F.col("truth").cast("double"))
    scalar = rows.filter((F.col("phase") == "scalar") & (F.col("attr") != EXISTS)).join(list_types(questions), "target", "left_anti").select("answer_id", "provision_id", "target", "attr", value.alias("value"))
    # An instance's id is worked out once for all attributes that a concept sets on it.
    routed = F.broadcast(routing.groupBy("concept", "target").agg(F.collect_list("attr").alias("attrs")))
    chosen = rows.filter("phase = 'multiselect'").select("answer_id", "provision_id", F.explode("items.concept").alias("concept")).join(routed, "concept").select("answer_id", "provision_id", "target", "attrs", F.lit(1.0).alias("value"))
    named = scalar.withColumn("attrs", F.array("attr")).drop("attr").unionByName(chosen).withColumn("slot", F.lit("single")).withColumn("entity_id", business_id("e_", "provision_id", "target", "slot"))
    return own.unionByName(named.select("answer_id", "provision_id", "target", "entity_id", F.explode("attrs").alias("attr"), "value"))


def stored_attributes(writes: DataFrame, found: DataFrame) -> DataFrame:
    """(entity_id, attr, value): the first write of every attribute on an entity that is there."""
    there = found.filter("reason is null").select("entity_id")
    first = writes.join(there, "entity_id", "left_semi").groupBy("entity_id", "attr").agg(F.min(F.struct("answer_id", "value")).alias("w"))
    return first.select("entity_id", "attr", "w.value")


def flat_answers(rows: DataFrame) -> DataFrame:
    """(answer_id, provision_id, question, text, number, truth): what is stored beside the entities; a list becomes its concepts joined by commas."""
    listed = F.col("items").isNotNull()
    kept = rows.filter(F.col("phase").isin("scalar", "multiselect"))
    return kept.select("answer_id", "provision_id", "question", F.when(listed, F.array_join("items.concept", ", ")).alias("text"), F.when(~listed, F.col("number")).alias("number"), F.when(~listed, F.col("truth")).alias("truth"))


def instance_writes(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(answer_id, provision_id, target, concept): answers that write on single instances of a provision: on that of ``target``, or on all to which ``concept`` is routed. One pass over the answers."""
    scalar = (F.col("phase") == "scalar") & (F.col("attr") != EXISTS) & F.col("by_list").isNull()
    concepts = F.when(F.col("phase") == "multiselect", F.col("items.concept")).when(scalar, F.array(F.lit(None).cast("string")))
    named_by = list_types(questions).withColumn("by_list", F.lit(True))
    own = F.when(F.col("phase") == "scalar", F.coalesce("target", F.lit(""))).alias("target")
    return rows.join(named_by, "target", "left").select("answer_id", "provision_id", own, F.explode(concepts).alias("concept"))


def lost_instances(writes: DataFrame, found: DataFrame, routing: DataFrame) -> DataFrame:
    """(answer_id): those of ``instance_writes`` with an instance that is not there.

    Instances are told by their provision and type, of which their ids are made: a write meets the types
    of its provision once, and no id is worked out for each type that a concept is routed to.
    """
    kind = F.coalesce("target", F.lit(""))
    there = found.filter("reason is null and item is null").groupBy(F.col("provision_id").alias("held_by")).agg(F.collect_set(kind).alias("there"))
    routed = F.broadcast(routing.groupBy("concept").agg(F.collect_set(kind).alias("targets")))
    met = writes.join(there, F.col("provision_id").eqNullSafe(F.col("held_by")), "left").join(routed, "concept", "left")
    wanted = F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.col("targets"))
    return met.filter(wanted.isNotNull() & (F.col("there").isNull() | (F.size(F.array_except(wanted, "there")) > 0))).select("answer_id").distinct()


def rejected(rows: DataFrame, found: DataFrame, writes: DataFrame) -> DataFrame:
    """(answer_id, item, reason): answers without a fit value, entities that were not created, and writes on an entity that is not there."""
    there = found.filter("reason is null").select("entity_id")
    return rejects(rows, found, writes.join(there, "entity_id", "left_anti").select("answer_id").distinct())


def rejects(rows: DataFrame, found: DataFrame, lost: DataFrame) -> DataFrame:
    """As ``rejected``, of the answers (answer_id) whose writes are lost."""
    none = F.lit(None).cast("int").alias("item")
    failed = found.filter("reason is not null").select("answer_id", "item", "reason")
    return rows.filter("reason is not null").select("answer_id", none, "reason").unionByName(failed).unionByName(lost.select("answer_id", none, F.lit("no entity").alias("reason")))


def flags(chosen: DataFrame, routing: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, flags map): list values to boolean attributes through a routing table; every attribute of a target is there, true where a value sets it."""
    known = routing.groupBy("target").agg(F.sort_array(F.collect_set("attr")).alias("known"))
    held = chosen.join(routing, "concept").groupBy(*keys, "target").agg(F.collect_set("attr").alias("held"))
    return held.join(known, "target").select(*keys, "target", F.map_from_arrays("known", F.transform("known", lambda a: F.array_contains("held", a))).alias("flags"))


def ensured(wanted: DataFrame, existing: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of ``existing`` and, for keys that are not there, the first wanted row; ``created`` tells which. Rows that are inserted come back, so that later steps of the same plan join them."""
    new = first_by(wanted, keys, order).join(existing.select(*keys), keys, "left_anti").withColumn("created", F.lit(True))
    return existing.withColumn("created", F.lit(False)).unionByName(new, allowMissingColumns=True)
