"""Edge cases of the script, section and definition functions, against plain Python."""

import re

from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions import script as S


def brute_terms(text, terms):
    """By the rules: of a term's places in one stretch of 200 characters (counted from the text's start) the one of the
    first listed term stands, then the first place; its definition runs from the line's start to the next definition,
    else the next empty line, else 4,000 characters."""
    quoted = [(n, m.start()) for n, term in enumerate(terms) for m in re.finditer(f'["“]{re.escape(term)}["”]{S.MEANS}', text, re.I)]
    firsts = {}
    for n, at in quoted:
        firsts[at // 200] = min(firsts.get(at // 200, (n, at)), (n, at))
    starts_next = re.compile(r'\n\s*["“][A-Z][a-zA-Z\s]+["”]\s*(?:means?|shall mean|is defined|has the meaning)')
    rows = []
    for n, at in firsts.values():
        line = max(text.rfind("\n", max(0, at - 500), at) + 1, at - 500 if "\n" not in text[max(0, at - 500) : at] else 0, 0)
        rest = text[at + 50 : at + 4000]
        ends = [m.start() for m in [starts_next.search(rest)] if m] or [rest.find("\n\n")]
        stop = ends[0] if ends[0] >= 0 else len(rest)
        rows.append((terms[n], at, text[line : at + 50 + stop].strip()))
    return sorted(rows)


def test_defined_terms(spark):
    body = "right, title and interest in the works held by the party 😀 named here; "
    texts = [
        f'Start\n  “IP” means all {body * 3}\n\n"Patent" shall mean {body}\n “Other Term” has the meaning {body}',
        f'"License" means a "Guarantor" means b {body * 80} "transfer" is defined as {body * 90}',
        f'{"x" * 700}"Know-How" means {body}',
        "no term here",
        "",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in S.defined_terms(rows).collect():
        got.setdefault(r.doc_id, []).append((r.term, r.start, r.definition.strip()))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == (brute_terms(text, S.TERMS) if text else [])
    assert S.defined_terms(rows.limit(0)).count() == 0


def test_sections_and_definitions(spark):
    pages = [(1, 1, "intro"), (1, 2, "Section 1.01: Definitions a"), (1, 3, "b"), (1, 4, "c Section 1.02 d"), (1, 5, "e"), (2, 1, "Section 1.01 Defined Terms; Section 1.02 too"), (2, 2, "no"), (3, 1, None), (3, 2, "section 1.01. definitions"), (3, 3, "open end")]
    df = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    spans = {r.doc_id: r.definitions for r in S.definitions_span(df).collect()}
    assert spans[1] == "[PAGE 2]\nSection 1.01: Definitions a\n[PAGE 3]\nb\n[PAGE 4]\nc Section 1.02 d"
    assert spans[2].count("[PAGE") == 1 and spans[3].endswith("[PAGE 3]\nopen end")
    got = {r.doc_id: (r.page_number, r.section) for r in S.find_section(df, "1.02", 12).collect()}
    assert got == {1: (4, "Section 1.02"), 2: (1, "Section 1.02")}


def test_scripts(spark):
    text = ["# head", "has lost;", "insert $a isa t;", "", "match", "$a isa t;", "insert $b isa u;", "has k;", "insert", "$c isa t;", "match $d isa t;"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("g", 0, None)], "file string, line int, text string")
    got = sorted((r.statement, r.phase, r.text) for r in S.statements(df).collect())
    assert got == [(1, 1, "insert $a isa t;"), (2, 2, "match\n$a isa t;\ninsert $b isa u;\nhas k;"), (3, 1, "insert\n$c isa t;"), (4, 2, "match $d isa t;")]
    plain = sorted((r.statement, r.n_lines) for r in S.statements(df, mixed=False).collect())
    assert plain == [(0, 1), (1, 3), (2, 2), (3, 3)]


def test_values(spark):
    values = [("a\"b\\\n\r", "string"), ("Yes", "boolean"), ("0", "boolean"), ("5", "double"), ("5.9", "long"), ("-3", "integer"), ("x", "double"), ("1", None), (None, "string")]
    got = [r[0] for r in spark.createDataFrame(values, "v string, k string").coalesce(1).select(S.written(F.col("v"), F.col("k"))).collect()]
    assert got == ['"a\\"b\\\\\\n"', "true", "false", "5.0", "5", "-3", None, None, None]
    df = spark.createDataFrame([("b_two",), ("two",), ("zz",), ("",), (None,)], "d string").coalesce(1)
    assert [r[0] for r in df.select(catalog.resolved_subtype(F.col("d"), ["b_two", "a_one"])).collect()] == ["b_two", "b_two", "a_one", "a_one", "a_one"]
    assert [r[0] for r in df.select(catalog.resolved_subtype(F.col("d"), [])).collect()] == [None] * 5


def test_field_classes(spark):
    sub = spark.createDataFrame([("b", "a"), ("c", "b")], "sub string, super string")
    owns = spark.createDataFrame([("a", "a_id", True), ("a", "x", None), ("b", "y", False), ("c", "x", False), ("c", "page", False), ("z", "page", False)], "type_name string, attr string, is_key boolean")
    closure = catalog.type_closure(sub)
    shared = spark.createDataFrame([("page",)], "attr string")
    rows = catalog.field_classes(catalog.owned_attributes(owns, closure), closure, shared).collect()
    own = {("a", None, "x"), ("b", None, "x"), ("b", None, "y"), ("c", None, "x"), ("c", None, "y")}
    assert {tuple(r) for r in rows} == own | {("a", "b", "y"), ("a", "c", "y")} and len(rows) == 7
    assert catalog.field_classes(catalog.owned_attributes(owns.limit(0), closure), closure, shared).count() == 0


def test_relation_config(spark):
    sub = spark.createDataFrame([("has_item", "holds"), ("has_box", "holds"), ("two_items", "holds"), ("item_part", "bears"), ("lone_part", "bears")], "sub string, super string")
    roles = {
        "holds": ["provision", "extracted"],
        "has_item": ["provision", "extracted", "item"],
        "has_box": ["provision", "item"],
        "two_items": ["provision", "extracted", "p", "q"],
        "item_part": ["parent", "child", "item", "bit"],
        "lone_part": ["parent", "child", "other", "bit"],
        "limits": ["owner", "bound", "extracted"],
        "wide": ["owner", "s", "t"],
        "infra": ["owner", "s"],
    }
    relates = spark.createDataFrame([(r, x) for r, xs in roles.items() for x in xs], "rel_type string, role string")
    plays = spark.createDataFrame([("mfn", "limits", "bound"), ("rp", "limits", "owner"), ("rp", "wide", "owner"), ("rp", "infra", "owner"), ("rp", "has_item", "provision")], "type_name string, rel_type string, role string")
    closure = catalog.type_closure(sub)
    expected = {
        ("has_item", 1, "provision", "item", None),
        ("has_box", 1, "provision", "item", None),
        ("item_part", 2, "item", "bit", "has_box"),
        ("limits", 3, "owner", "bound", None),
    }
    rows = lambda *a, **k: {tuple(r) for r in catalog.relation_config(closure, relates, plays, ["rp", "mfn"], "holds", "bears", *a, **k).collect()}
    assert rows(skip=("infra",)) == expected
    assert rows() == expected | {("infra", 3, "owner", "s", None)}


def test_sums_before(spark):
    rows = [(k, [(7 * i) % 11 for i in range(k)]) for k in (0, 1, 2, 3, 4, 15, 16, 17, 1000)]
    for r in spark.createDataFrame(rows, "k int, v array<int>").select("v", S.sums_before(F.col("v")).alias("s")).collect():
        assert r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]


def test_defined_terms_of_a_long_text_and_of_rows_alike(spark):
    line = '😀é\n"IP" means all of it.\n\n' + "words " * 40
    rows = spark.createDataFrame([(1, line * 400), (1, line), (None, line), (2, None), (3, "")], "doc_id int, text string")
    got = [tuple(r) for r in S.defined_terms(rows).collect()]
    long, one = ([tuple(r) for r in brute_terms(t, S.TERMS)] for t in (line * 400, line))
    assert len(long) == 400 and len(one) == 1
    assert sorted(r[1:] for r in got if r[0] == 1) == sorted(long + one)
    assert [r[1:] for r in got if r[0] is None] == one and {r[0] for r in got} == {1, None}
