"""Operators on hand-made fixtures: edge cases that the large tables do not hold."""

from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions import text as T
from factloom.operators import match, mutate, ranking


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_closure_depths(spark):
    sub = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "sub string, super string")
    got = {(r["sub"], r["super"]): r["depth"] for r in catalog.type_closure(sub).collect()}
    assert got == {("a", "a"): 0, ("b", "b"): 0, ("c", "c"): 0, ("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 1}


def test_attributes_of_all_types(spark):
    owns = spark.createDataFrame([("a", "x_id", True), ("a", "page", False), ("b", "y_id", True)], "type_name string, attr string, is_key boolean")
    closure = catalog.type_closure(spark.createDataFrame([("b", "a")], "sub string, super string"))
    owned = catalog.owned_attributes(owns, closure)
    assert rows(catalog.attributes_of_all(owned, owned.select("type_name"))) == [("page",)]
    assert rows(catalog.key_attribute(owned)) == [("a", "x_id"), ("b", "x_id")]


def test_relation_wiring_prefers_first_provision(spark):
    plays = spark.createDataFrame([("rp", "has", "provision"), ("di", "has", "provision"), ("basket", "has", "basket")], "type_name string, rel_type string, role string")
    relates = spark.createDataFrame([("has", "provision"), ("has", "basket")], "rel_type string, role string")
    assert rows(catalog.relation_wiring(plays, relates, ["rp", "mfn", "di"])) == [("basket", "has", "basket", "provision")]


def test_links_leave_out_families_and_keep_shared_roles(spark):
    players = spark.createDataFrame([(1, "pool", "s1", "x"), (1, "pool", "s2", "y"), (2, "extracted", "s1", "x"), (2, "extracted", "s2", "z")], "rel_id int, rel_type string, slot string, player_id string")
    got = rows(match.links(players, ["extracted"]).select("entity_id", "linked_id"))
    assert got == [("x", "y"), ("y", "x")]


def test_reachable_keeps_least_depth(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "s int, t int")
    got = {(a, b): d for a, b, d in rows(match.reachable(e, "s", "t", 4))}
    assert got[(1, 3)] == 1 and got[(1, 1)] == 2 and got[(2, 1)] == 2


def test_best_answer_first_wins_ties(spark):
    a = spark.createDataFrame([("q", "medium", 1), ("q", "high", 2), ("q", "high", 3), ("r", "odd", 1), ("r", "low", 2)], "question_id string, confidence string, seq int")
    assert rows(ranking.best_answer(a).select("question_id", "seq")) == [("q", 2), ("r", 2)]


def test_best_segment_later_map_wins_equal_spans(spark):
    s = spark.createDataFrame([(1, "x", 0, True, 1, 5), (1, "x", 1, True, 3, 7), (1, "x", 2, False, 0, 99), (1, "y", 0, False, 0, 0)], "doc_id int, segment_type_id string, map_idx int, found boolean, start_page int, end_page int")
    assert rows(ranking.best_segment(s).select("segment_type_id", "map_idx")) == [("x", 1), ("y", 0)]


def test_greedy_batches_oversize_and_reset(spark):
    items = spark.createDataFrame([("g", "a", 6.0), ("g", "b", 6.0), ("g", "c", 3.0), ("g", "d", 99.0), ("g", "e", 1.0)], "g string, k string, cost double")
    assert rows(ranking.greedy_batches(items, "g", "k", "cost", 10).select("k", "batch")) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_coercion_edges(spark):
    assert [one(spark, v, T.coerce_number) for v in ("$1000", "50%", "1,000", "N/A", " '7.5' ", "", None)] == [1000.0, 50.0, None, None, 7.5, None, None]
    assert [one(spark, v, T.coerce_boolean) for v in ("Yes", "1", "no", "none")] == [True, True, False, None]
    assert [one(spark, v, T.coerce_integer) for v in ("3.9", "x")] == [3, None]


def test_page_slice_edges(spark):
    text = "[PAGE 1]\na\n[PAGE 2]\nb\n[PAGE 3]\nc"
    cut = lambda s, e, n=T.OPEN_SLICE: spark.range(1).select(T.page_slice(F.lit(text), F.lit(s), F.lit(e), n)).first()[0]
    assert cut(2, 2) == "[PAGE 2]\nb\n"
    assert cut(9, 9) == ""
    assert cut(2, 7, 10) == "[PAGE 2]\nb"


def test_citations_and_evidence(spark):
    c = one(spark, "a [7.02(b), p.14] b [p. 3] [x]", T.citations)
    assert [(x["section"], x["page"]) for x in c] == [("7.02(b)", 14), (None, 3)]
    assert one(spark, "EVIDENCE: [a1, b2 ,]\nrest", T.evidence_ids) == ["a1", "b2"]


def test_formats(spark):
    f = lambda v, g: spark.createDataFrame([(v,)], "v double").select(g(F.col("v"))).first()[0]
    assert f(1234567.5, T.dollars) == "$1,234,568" and f(0.5, T.percent) == "50%" and f(12.34, T.percent) == "12.3%" and f(3.0, T.rendered) == "3"


def test_mutations(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert rows(mutate.insert_if_absent(have, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(mutate.put(have, new)) == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]
    assert rows(mutate.replace_attribute(have, new.dropDuplicates(), "k", "v")) == [(1, "a"), (2, "c")]
    assert rows(mutate.delete_like(have.withColumn("v", F.concat("v", F.lit("_x"))), "v", "a_.*")) == [(2, "b_x")]
    writes = spark.createDataFrame([(1, "late", 5), (1, "early", 2)], "k int, v string, seq int")
    assert rows(mutate.first_write_wins(writes, ["k"], "seq").select("k", "v")) == [(1, "early")]


def test_cascade_delete_keeps_entities(spark):
    t = {
        "deals": spark.createDataFrame([(1,), (2,)], "deal_id int"),
        "provisions": spark.createDataFrame([(10, 1), (20, 2)], "provision_id int, deal_id int"),
        "answers": spark.createDataFrame([(10,), (20,)], "provision_id int"),
        "entities": spark.createDataFrame([(10,), (20,)], "provision_id int"),
    }
    left = mutate.cascade_delete(t, spark.createDataFrame([(1,)], "deal_id int"))
    assert {n: rows(df) for n, df in left.items()} == {"deals": [(2,)], "provisions": [(20, 2)], "answers": [(20,)], "entities": [(10,), (20,)]}
    assert rows(mutate.cascade_delete(t, spark.createDataFrame([(1,)], "deal_id int"), keep_entities=False)["entities"]) == [(20,)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "question_id string, confidence string, seq int")
    assert ranking.best_answer(none).count() == 0
    assert catalog.type_closure(spark.createDataFrame([], "sub string, super string")).count() == 0


def test_percent_rounds_as_the_exact_value_does(spark):
    values = [0.125, 0.025, 0.005, 1.0, 2.25, 2.35, 1.15, 1.25, 1.35, 1.45, 33.75, 49.95, 7.05, 1e6 + 0.25, 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(T.percent(F.col("v"))).collect()]
    assert got == [None if v is None else f"{v * 100:.0f}%" if v <= 1 else f"{v:.1f}%" for v in values]


def test_tokens_leave_stop_words_out(spark):
    from factloom.plans.texts import STOP_WORDS

    assert len(STOP_WORDS) == len(set(STOP_WORDS)) > 80
    text = "Would the BASKET be, under any other cap2, only 2x a basket of an EBITDA-based is?"
    row = spark.createDataFrame([(text,)], "t string").select(F.array_sort(T.tokenize(F.col("t"), STOP_WORDS))).first()[0]
    assert row == ["based", "basket", "cap2", "ebitda"]


def test_files_round_trip(spark, tmp_path):
    from factloom.sources import files as io

    df = spark.createDataFrame([(1, 'a "b"\nc', None), (2, None, 1.5), (3, "", None)], "id long, name string, x double")
    for rows in (df, df.limit(0)):
        io.save_json(rows, f"{tmp_path}/j")
        assert sorted(map(tuple, io.load_json(spark, f"{tmp_path}/j", "id long, name string, x double").collect())) == sorted(map(tuple, rows.collect()))
        io.append_rows(rows, f"{tmp_path}/t", fresh=True)
        io.append_rows(rows, f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t").count() == 2 * rows.count()
    io.save_json(df.repartition(30), f"{tmp_path}/many")
    assert io.newest(spark, f"{tmp_path}/many", 2).count() == 2
