"""Plans and results that larger tables failed on."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import store
from factloom.plans import registry, retrieval, storing
from factloom.plans.model import Graph
from factloom.sources import files
from factloom.sources.snapshots import Snapshots


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "rte02_route_scores",
        "rte02_route_match",
        "rte02_specific",
        "rte03_covenant_resolve",
        "rte04_relevant_types",
    ],
)
def test_questions_meet_routes_by_text(spark, sf, name):
    plan = plan_of(registry.QUERIES[name](spark, sf))
    assert "BroadcastHashJoin [question" not in plan and "ShuffledHashJoin [low" in plan


def test_covenants_are_not_broadcast(spark, sf):
    plan = plan_of(registry.QUERIES["oth06_detect_covenant"](spark, sf))
    assert "BroadcastHashJoin [question" not in plan and "SortMergeJoin [question" in plan


def test_only_asked_questions_are_routed(spark):
    wanted = retrieval.wanted_types(Graph(spark, "/root/testdata/sf0.01"))
    assert wanted.count() == wanted.distinct().count() > 0
    assert wanted.agg(F.max("question")).first()[0] <= retrieval.ASKED


def test_results_share_files(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/evals")
    results = spark.range(2000).select(F.format_string("eval_%05d", "id").alias("name"), "id")
    folder = files.save_results(results, table)
    read = spark.read.parquet(folder)
    assert read.count() == 2000 and len(read.inputFiles()) <= 8


def test_newest_results_by_name(spark, tmp_path):
    names = [(f"eval_{i:05d}",) for i in range(50)] + [("other_1",)]
    folder = files.save_results(spark.createDataFrame(names, "name string"), Snapshots(spark, f"file://{tmp_path}/evals"))
    got = [tuple(r) for r in files.newest_saved(spark, folder, 3, "eval_").orderBy("place").collect()]
    assert got == [(1, "eval_00049", 1), (2, "eval_00048", 1), (3, "eval_00047", 1)]
    assert files.newest_saved(spark, folder, 3, "none").count() == 0


def test_graph_shuffles_baskets_once(spark, sf):
    plan = plan_of(registry.QUERIES["qry14_graph"](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1


def test_survivors_read_every_table_once(spark, sf):
    plan = plan_of(registry.QUERIES["snk09_survivors"](spark, sf))
    assert plan.count("FileScan parquet") == 5


def test_found_entities_are_worked_out_once(spark, sf):
    found = storing.Storing(Graph(spark, sf)).found
    assert "FileScan" not in plan_of(found)


def test_rejects_pass_over_the_answers_twice(spark, sf):
    # Once for the reasons of answers, once for what they write; candidates are made in one more pass, before.
    plan = plan_of(registry.QUERIES["qry18_rejects"](spark, sf))
    assert plan.count("events.parquet") == 2 and "sha2" not in plan
    steps = storing.Storing(Graph(spark, sf))
    assert plan_of(store.candidates(steps.rows, steps.questions, steps.config)).count("events.parquet") == 1


def test_lost_writes_by_type_are_those_by_id(spark):
    steps = storing.Storing(Graph(spark, "/root/testdata/sf0.01"))
    by_id = store.rejected(steps.rows, steps.found, steps.writes)
    by_type = registry.QUERIES["qry18_rejects"](spark, "/root/testdata/sf0.01")
    assert by_type.count() == by_id.count() > 0 and by_type.exceptAll(by_id).count() == 0


def test_lost_instances_of_odd_rows(spark):
    questions = spark.createDataFrame([("T", "multiselect"), ("L", "entity_list")], "target string, qtype string")
    routing = spark.createDataFrame([("c", "T", "x"), ("c", "T", "y"), ("d", "T", "x"), ("d", "U", "x"), ("n", None, "x")], "concept string, target string, attr string")
    found = spark.createDataFrame([(1, "T", None, None), (2, "T", None, "id taken"), (3, "T", 0, None), (None, "T", None, None)], "provision_id long, target string, item int, reason string")
    listed = lambda i, p, *names: (i, p, "T", "multiselect", "z", [{"concept": c} for c in names])
    data = [
        listed(1, 1, "c", "c"), listed(2, 1, "c", "d"), listed(3, 2, "c"), listed(4, 3, "c"), listed(5, None, "c"), listed(6, 1, "unknown", None), listed(7, 1), listed(8, 1, "n"),
        (9, 1, "T", "scalar", "z", None), (10, 9, "T", "scalar", "z", None), (11, 9, "L", "scalar", "z", None), (12, 9, "T", "scalar", store.EXISTS, None), (13, 9, "T", "scalar", None, None), (14, 1, None, "scalar", "z", None),
    ]
    rows = spark.createDataFrame(data, "answer_id long, provision_id long, target string, phase string, attr string, items array<struct<concept: string>>")
    lost = store.lost_instances(store.instance_writes(rows, questions), found, routing)
    assert sorted(r[0] for r in lost.collect()) == [2, 3, 4, 8, 10, 14]
