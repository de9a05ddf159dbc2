"""Storing, clean-up, nesting, snapshots, scanning and payloads against brute force and hand-made edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions import payload, script
from factloom.functions import text as T
from factloom.operators import mutate, nest, ranking, store
from factloom.plans import registry
from factloom.plans.model import Graph
from factloom.plans.texts import route_scores
from factloom.sources import files
from factloom.sources.kept import Kept
from factloom.sources.snapshots import Snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Closure and layers.


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(100)], "sub string, super string")
    closure = catalog.type_closure(chain)
    assert closure.count() == 101 * 102 // 2
    assert closure.filter("sub = 't0' and super = 't100'").first()["depth"] == 100


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")]])
def test_cycles_of_types_raise(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        catalog.type_closure(spark.createDataFrame(edges, "sub string, super string"))
    with pytest.raises(ValueError, match="hold each other"):
        mutate.layers(spark.createDataFrame(edges, "holder_type string, held_type string"))


def test_layers_order_holders_first(spark):
    pairs = spark.createDataFrame([("deal", "provision"), ("provision", "basket"), ("basket", "source"), ("provision", "source"), (None, "x")], "holder_type string, held_type string")
    assert mutate.layers(pairs) == [["deal"], ["provision"], ["basket"], ["source"]]
    assert mutate.layers(pairs.limit(0)) == []


@pytest.mark.parametrize("seed", range(4))
def test_bottom_up_delete_on_random_graphs(spark, seed):
    rnd = random.Random(seed)
    kinds = ["a", "b", "c", "d"]
    nodes = [(t, f"{t}{i}") for t in kinds for i in range(12)]
    # Types hold later types only; ids repeat over types on purpose.
    links = [(x, f"{x}{rnd.randrange(14)}", y, f"{y}{rnd.randrange(12)}") for _ in range(40) for x, y in [sorted(rnd.sample(kinds, 2))]]
    roots = [(t, f"{t}{rnd.randrange(12)}") for t in rnd.sample(kinds, 2)] + [("a", "nowhere")]
    below, todo = set(), list(roots)
    while todo:
        t, i = todo.pop()
        if (t, i) not in below:
            below.add((t, i))
            todo += [(y, j) for x, h, y, j in links if (x, h) == (t, i)]
    frame = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    args = frame(nodes, ("type", "id")), frame(links, ("holder_type", "holder", "held_type", "held")), frame(roots, ("type", "id"))
    left, gone = mutate.bottom_up_delete(*args)
    assert rows(left) == sorted(set(nodes) - below) and rows(gone.select("type", "id")) == sorted(set(nodes) & below)
    steps = {(t, i): s for t, i, s in rows(gone)}
    assert all(steps[x, h] > steps[y, j] for x, h, y, j in links if (x, h) in steps and (y, j) in steps)
    kept, gone = mutate.bottom_up_delete(*args, keep_roots=True)
    assert rows(kept) == sorted((set(nodes) - below) | (set(nodes) & set(roots)))


# Lists, sources, nesting, words.


def test_multiset_difference_counts_repeats(spark):
    e = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (4, None)], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (1, "w"), (1, "w"), (3, "q"), (2, "z")], "k int, v string")
    got = {r["k"]: (r["missing"], r["extra"], [tuple(x) for x in r["surplus"]]) for r in mutate.multiset_difference(e, s, ["k"], "v").collect()}
    assert got == {1: (["y"], ["w"], [("x", -1)]), 2: ([], [], []), 3: ([], ["q"], []), 4: ([], [], [])}
    assert mutate.multiset_difference(e.limit(0), s.limit(0), ["k"], "v").count() == 0


def test_first_source_wins_per_key(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "c", 9), (2, "d", 8)], "k int, v string, w int")
    c = spark.createDataFrame([(2, "e"), (3, "f"), (None, "n")], "k int, v string")
    got = ranking.first_source([a, b, c], ["k"]).select("v", "source", "w").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 0, None), ("b", 0, None), ("d", 1, 8), ("f", 2, None), ("n", 2, None)], key=str)


def test_nested_children_do_not_multiply(spark):
    parents = spark.createDataFrame([(1, "p"), (2, "q"), (2, "q")], "k int, name string")
    x = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (9, 9)], "k int, v int")
    y = spark.createDataFrame([(1, "b", None), (1, "a", 1.5)], "k int, v string, w double")
    got = {r["k"]: (r["name"], [tuple(v) for v in r["x"]], [tuple(v) for v in r["y"]]) for r in nest.nested(parents, "k", {"x": x, "y": y}).collect()}
    assert got == {1: ("p", [(2,), (2,), (3,)], [("a", 1.5), ("b", None)]), 2: ("q", [], [])}
    assert nest.nested(parents.limit(0), "k", {"x": x}).count() == 0


def test_nesting_takes_one_shuffle(spark, sf):
    g = Graph(spark, sf)
    x, y = (g.table("lineitem").select(F.col("l_orderkey").alias("k"), c) for c in ("l_tax", "l_discount"))
    plan = nest.nested(g.table("orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k", {"x": x, "y": y})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_holding_words_by_grams(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(200)})
    keywords = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 6))) for _ in range(40)} | {"zzz"})
    got = T.holding_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in keywords], "keyword string"))
    assert rows(got) == sorted((w, k) for w in words for k in keywords if k in w)


def test_routing_has_no_nested_loop(spark, sf):
    plan = route_scores(Graph(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# Storing.


QUESTIONS = [
    (1, "entity_list", "Basket", "x", "holds"),
    (2, "entity_list", "Tier", "x", "bears"),
    (3, "boolean", "Blocker", "_exists", "holds"),
    (4, "number", "Blocker", "limit", "holds"),
    (5, "multiselect", "Blocker", "kinds", "holds"),
    (6, "entity_list", "Odd", "x", "unknown"),
    (7, "boolean", "Basket", "_exists", "holds"),
    (8, "number", "Basket", "cap", "holds"),
]
CONFIG = [("holds", 1, "provision", "basket", None), ("bears", 2, "basket", "tier", "holds")]
ITEMS = "array<struct<idx: int, concept: string, amount: double>>"


def id_of(provision, target, slot):
    return "e_" + hashlib.sha256("\x1f".join((str(provision), target, str(slot))).encode()).hexdigest()[:16]


def stored(spark, answers):
    rows_ = spark.createDataFrame(answers, f"answer_id long, provision_id long, question long, said string, items {ITEMS}, number double, truth boolean")
    questions = spark.createDataFrame(QUESTIONS, "question long, qtype string, target string, attr string, relation string")
    config = spark.createDataFrame(CONFIG, "relation string, tier int, parent_role string, child_role string, parent_relation string")
    routing = spark.createDataFrame([("c1", "Blocker", "a"), ("c1", "Blocker", "b"), ("c2", "Blocker", "c")], "concept string, target string, attr string")
    known = store.classified(rows_, questions)
    found = store.resolved(store.candidates(known, questions, config))
    return known, found, store.attribute_writes(known, found, questions, routing)


def test_answers_are_stored_or_rejected(spark):
    item = lambda *amounts: [(i, f"c{i + 1}", a) for i, a in enumerate(amounts)]
    answers = [
        (1, 10, 1, "entity_list", item(5.0, 6.0), None, None),  # two baskets
        (2, 10, 1, "entity_list", item(7.0), None, None),  # the same id again
        (3, 10, 2, "entity_list", item(1.0), None, None),  # a tier under the first that its parent relation holds: the single blocker
        (4, 11, 2, "entity_list", item(1.0), None, None),  # no basket to hang on
        (5, 10, 3, "scalar", None, None, True),  # a single blocker
        (6, 10, 4, "scalar", None, 2.5, None),
        (7, 10, 4, "scalar", None, 9.9, None),  # a later write
        (8, 11, 4, "scalar", None, 1.0, None),  # no blocker there
        (9, 10, 5, "entity_list", item(0.0, 0.0), None, None),  # claimed as a list of entities: a multiselect
        (10, 10, 4, "entity_list", None, 4.0, None),  # claimed as a list: a scalar
        (11, 10, 1, "entity_list", None, 4.0, None),  # asked for as a list, but none
        (12, 10, 1, "entity_list", None, None, None),
        (13, 10, 6, "entity_list", item(1.0), None, None),  # relation without configuration
        (14, 10, 7, "scalar", None, None, True),  # lists make baskets, no single one
        (15, 10, 8, "scalar", None, 3.0, None),
        (16, 10, 99, "scalar", None, 8.0, None),  # unknown question: stored flat
        (17, 12, 3, "scalar", None, None, False),  # says there is none
        (18, 10, 5, "multiselect", [], None, None),
    ]
    known, found, writes = stored(spark, answers)
    first, single = id_of(10, "Basket", 0), id_of(10, "Blocker", "single")
    got = {r["entity_id"]: (r["type_name"], r["parent_id"], r["answer_id"]) for r in store.stored_entities(found).collect()}
    assert got == {first: ("Basket", "p_10", 1), id_of(10, "Basket", 1): ("Basket", "p_10", 1), id_of(10, "Tier", 0): ("Tier", single, 3), single: ("Blocker", "p_10", 5)}
    attributes = {(r["entity_id"], r["attr"]): r["value"] for r in store.stored_attributes(writes, found).collect()}
    assert attributes == {(first, "amount"): 5.0, (id_of(10, "Basket", 1), "amount"): 6.0, (id_of(10, "Tier", 0), "amount"): 1.0, (single, "limit"): 2.5, (single, "a"): 1.0, (single, "b"): 1.0, (single, "c"): 1.0}
    assert rows(store.rejected(known, found, writes).select("answer_id", "reason")) == [(2, "id taken"), (4, "no parent"), (8, "no entity"), (11, "not a list"), (12, "no value"), (13, "no relation config")]
    flat = {r["answer_id"]: (r["text"], r["number"], r["truth"]) for r in store.flat_answers(known).collect()}
    assert set(flat) == {5, 6, 7, 8, 9, 10, 14, 15, 16, 17, 18} and flat[9] == ("c1, c2", None, None) and flat[18][0] == "" and flat[17] == (None, None, False)


def test_store_of_nothing(spark):
    known, found, writes = stored(spark, [])
    assert store.stored_entities(found).count() == store.stored_attributes(writes, found).count() == store.rejected(known, found, writes).count() == 0


def test_flags_name_every_attribute(spark):
    chosen = spark.createDataFrame([(1, "c1"), (1, "c9"), (2, "c2"), (3, "c9"), (1, "c1")], "k int, concept string")
    routing = spark.createDataFrame([("c1", "T", "a"), ("c1", "U", "z"), ("c2", "T", "b")], "concept string, target string, attr string")
    got = {(r["k"], r["target"]): r["flags"] for r in store.flags(chosen, routing, ["k"]).collect()}
    assert got == {(1, "T"): {"a": True, "b": False}, (1, "U"): {"z": True}, (2, "T"): {"a": False, "b": True}}


def test_ensured_rows_come_back(spark):
    have = spark.createDataFrame([(1, "old")], "k int, v string")
    want = spark.createDataFrame([(1, "new", 5), (2, "b", 7), (2, "a", 6)], "k int, v string, n int")
    got = store.ensured(want, have, ["k"], F.col("n").asc()).select("k", "v", "created").collect()
    assert sorted(map(tuple, got)) == [(1, "old", False), (2, "a", True)]


@pytest.mark.parametrize("name", ["qry18_entities", "qry18_attributes", "qry18_answers", "qry18_rejects", "oth10_routed_flags", "oth10_included_concepts", "qry19_cross_baskets", "qry19_wired_edges", "qry19_unresolved", "oth08_cleanup", "oth15_filled_fields", "oth24_statements", "win07_ordered_citations"])
def test_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_every_reason_occurs(spark):
    found = {r[0] for r in registry.QUERIES["qry18_rejects"](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert found == {"no value", "not a list", "no relation config", "no parent", "id taken", "no entity"}


# Snapshots.


def test_frames_stay_readable_after_a_second_call(spark, sf):
    first = registry.QUERIES["snk01_insert_rows"](spark, sf)
    second = registry.QUERIES["snk01_insert_rows"](spark, sf)
    assert first.count() == second.count() == 30


def test_two_sessions_at_once(spark, sf):
    other = spark.newSession()
    mine, theirs = registry.QUERIES["src07_universe_cache"](spark, sf), registry.QUERIES["src07_universe_cache"](other, "/root/testdata/sf0.01")
    for df, folder in ((mine, sf), (theirs, "/root/testdata/sf0.01")):
        given = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_suppkey").cast("long"), F.concat(F.lit("Article "), F.col("s_nationkey").cast("string"), F.lit('\n"'), "s_name", F.lit('"')))
        assert rows(df) == rows(given)


def test_publications_append_replace_and_go(spark, tmp_path):
    table, schema = Snapshots(spark, f"file://{tmp_path}/t"), "v long"
    assert table.read(schema).count() == 0 and table.drop_older() == 0
    table.write(spark.range(3).toDF("v"))
    table.write(spark.range(2).toDF("v"), "append")
    Snapshots(spark, table.root).write(spark.range(1).toDF("v"), "append")  # another writer
    before = table.read(schema)
    unpublished = table.fresh()
    spark.range(9).toDF("v").write.parquet(unpublished)
    assert table.read(schema).count() == 6
    table.write(spark.range(10, 14).toDF("v"))
    assert rows(table.read(schema)) == [(10,), (11,), (12,), (13,)] and before.count() == 6
    assert table.drop_older(keep=2) == 0 and before.count() == 6
    assert table.drop_older() == 3 and table.read(schema).count() == 4
    assert files.table(spark, "x").root.endswith("/factloom_files/x")


# Scanning.


def brute_statements(text):
    lines = ["" if line.lstrip(" \t\f\x0b\r").startswith("#") else line for line in text.split("\n")]
    text, out, start, quoted, escaped = "\n".join(lines), [], 0, False, False
    for i, c in enumerate([*text, None]):
        if c is None or (c == ";" and not quoted and not escaped):
            piece = text[start:i]
            bare = piece.strip(" \t\n\r\f\x0b")
            if bare:
                lead = piece[: len(piece) - len(piece.lstrip(" \t\n\r\f\x0b"))]
                out.append((text[:start].count("\n") + lead.count("\n") + 1, c is not None, bare))
            start = i + 1
        elif escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
    return [(n + 1, *s) for n, s in enumerate(out)]


def test_statements_against_a_character_walk(spark):
    rnd = random.Random(9)
    texts = [None, "", ";", "a", '";";x', "# c;\na;\n  # d\nb", "a\\;b;c\\", '"a\\";";b', "\\\\;\\\\\\;x"]
    texts += ["".join(rnd.choice(('"', ";", "\\", "\n", "#", " ", "a", "b\n#", "é")) for _ in range(rnd.randrange(40))) for _ in range(400)]
    texts += ['"; ' * 20_001 + "; end"]  # no recursion over a text's quotes
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in script.statement_spans(docs).orderBy("doc_id", "statement").collect():
        got[r["doc_id"]].append((r["statement"], r["line"], r["closed"], r["text"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_statements(t or ""), t
    twice = script.statement_spans(docs.filter("doc_id = 5").union(docs.filter("doc_id = 5")))
    assert Counter(map(tuple, twice.collect())) == Counter([(5, *s) for s in brute_statements(texts[5])] * 2)


def test_attributes_of_statements(spark):
    said = 'insert $q isa x, has a_1 "q\\"; \\\\n \\n", has n -3, has d 2.50, has t true , has u "", not_has z 1, has Z 4'
    got = spark.createDataFrame([(said,)], "s string").select(F.inline(script.attributes_of(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [("a_1", "string", 'q"; \\n \n'), ("n", "long", "-3"), ("d", "double", "2.50"), ("t", "boolean", "true"), ("u", "string", "")]


# Payloads and citations.


def test_payload_fields_of_odd_texts(spark):
    data = [(1, '{"a": 1, "b": "x", "c": null, "d": [1, "y"], "e": {"f": 2.5}, "g": 1.25, "h": true}'), (2, "[1]"), (3, "{"), (4, None), (5, "{}"), (6, '"s"')]
    docs = spark.createDataFrame(data, "k int, p string")
    found = payload.fields(docs, "k", "p")
    kinds = {(r["k"], r["field"]): (r["kind"], r["value"]) for r in found.filter("field is not null").collect()}
    assert kinds == {(1, "a"): ("integer", "1"), (1, "b"): ("string", "x"), (1, "c"): ("null", None), (1, "d"): ("list", '[1,"y"]'), (1, "e"): ("object", '{"f":2.5}'), (1, "g"): ("number", "1.25"), (1, "h"): ("boolean", "true")}
    defaults = spark.createDataFrame([("a", "integer", "0"), ("c", "string", "none")], "field string, kind string, value string")
    full = {(r["k"], r["field"]): (r["kind"], r["value"], r["given"]) for r in payload.filled(found.filter("field is not null"), docs, "k", defaults).collect()}
    assert full[1, "a"] == ("integer", "1", True) and full[1, "c"] == ("string", "none", False) and full[3, "a"] == ("integer", "0", False) and full[4, "c"] == ("string", "none", False) and full[1, "b"] == ("string", "x", True)


def test_citations_in_page_order(spark):
    data = [(1, 9, None, "a"), (1, 9, None, "b"), (1, 3, "S 1", "c"), (1, 3, None, "d"), (1, 3, "S 1", "e"), (1, 2, "S 2", "f"), (2, 9, None, "g")]
    cited = spark.createDataFrame(data, "k int, page int, section string, seq string")
    got = sorted((r["k"], r["place"], r["page"], r["section"]) for r in T.ordered_citations(cited, ["k"], "seq").collect())
    assert got == [(1, 1, 2, "S 2"), (1, 2, 3, "S 1"), (1, 3, 3, "S 1"), (1, 4, 9, None), (2, 1, 9, None)]
    shown = spark.createDataFrame([("S", 4), ("S", None), (None, 4), (None, None)], "s string, p int").select(T.cited(F.col("s"), F.col("p")))
    assert [r[0] for r in shown.collect()] == [" [S, p.4]", " [S]", " [p.4]", ""]


def test_kept_tables_age_and_serve_stale_rows(spark, tmp_path):
    table, loads = Snapshots(spark, f"file://{tmp_path}/kept"), []

    def load():
        loads.append(1)
        return spark.range(len(loads)).toDF("v")

    def broken():
        raise OSError("gone")

    count = lambda f, seconds: Kept(table, f, seconds).read().count()
    with pytest.raises(OSError):
        count(broken, 300)
    assert count(load, 300) == 1 and count(load, 300) == 1 and count(broken, None) == 1 and len(loads) == 1
    assert count(load, 0) == 2 and count(broken, 0) == 2
    # A load whose plan fails only while it runs serves older rows as well, and publishes nothing.
    late = lambda: spark.range(3).selectExpr("raise_error('late') AS v")
    assert count(late, 0) == 2 and count(broken, 300) == 2
    older = Kept(table, broken, 300).read()
    Kept(table, load).forget()
    assert older.count() == 2 and table.live() == []
    with pytest.raises(OSError):
        count(broken, None)
    assert count(load, None) == 3
    Kept(table, load).forget()
    assert count(lambda: spark.range(0).toDF("v"), 300) == 0 and count(broken, 300) == 0
    assert table.drop_older() > 0 and count(broken, 300) == 0
