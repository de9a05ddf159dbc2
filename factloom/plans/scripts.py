"""Seed scripts, schema value types, sections and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import script as S
from .model import Graph, query
from .tables import _BANDS, _BANDS_SQL, _PREFIXES

_LINES = """l AS (SELECT l_orderkey AS file, l_linenumber AS line, CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN 'match $x isa t;' WHEN 1 THEN 'insert $y isa t;' WHEN 2 THEN '# note' WHEN 3 THEN ''
ELSE 'has a "' || CAST(l_partkey AS VARCHAR) || '";' END AS text FROM lineitem), k AS (SELECT *, CASE WHEN starts_with(text, 'match') THEN 'match' WHEN starts_with(text, 'insert') THEN 'insert' END AS head FROM l WHERE text <> '' AND NOT starts_with(text, '#'))"""


def script_lines(g: Graph) -> DataFrame:
    """Orders stand for scripts, their items for lines."""
    pick = (F.col("l_partkey") + F.col("l_suppkey")) % 5
    text = F.when(pick == 0, "match $x isa t;").when(pick == 1, "  insert $y isa t; ").when(pick == 2, "# note").when(pick == 3, " ").otherwise(F.concat(F.lit('has a "'), F.col("l_partkey").cast("string"), F.lit('";')))
    return g.table("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), text.alias("text"))


_OUT = "CAST(count(*) AS BIGINT) AS n_lines, md5(string_agg(text, chr(10) ORDER BY line, text)) AS digest"


@query(
    "src10_mixed_statements",
    f"""WITH {_LINES}, h AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM k),
    s AS (SELECT *, CAST(sum(CASE WHEN head = 'match' OR (head = 'insert' AND coalesce(ahead, '') <> 'match') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS statement FROM h)
    SELECT file, statement, max(CASE WHEN head = 'match' THEN 2 ELSE 1 END) AS phase, {_OUT} FROM s WHERE statement > 0 GROUP BY 1, 2""",
)
def mixed_statements(g: Graph) -> DataFrame:
    return S.statements(script_lines(g)).select("file", "statement", "phase", "n_lines", F.md5("text").alias("digest"))


@query("src11_insert_statements", f"WITH {_LINES}, s AS (SELECT *, CAST(sum(CASE WHEN head = 'insert' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS statement FROM k) SELECT file, statement, {_OUT} FROM s GROUP BY 1, 2")
def insert_statements(g: Graph) -> DataFrame:
    return S.statements(script_lines(g), mixed=False).select("file", "statement", "n_lines", F.md5("text").alias("digest"))


@query("str12_escape", r"""SELECT doc_id, md5(replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '')) AS digest FROM documents""")
def escape(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", F.md5(S.escaped(F.col("text"))).alias("digest"))


@query("str16_variables", "SELECT conv_id, turn, 'x' || CAST(turn AS VARCHAR) || ',' || role AS names FROM conversations")
def variables(g: Graph) -> DataFrame:
    said = F.concat(F.lit("match $a isa t;\nSELECT $x"), F.col("turn").cast("string"), F.lit(",\n $"), "role", F.lit("; fetch $b;"))
    return g.table("conversations").select("conv_id", "turn", F.array_join(S.selected_variables(said), ",").alias("names"))


_KINDS = ["string", "boolean", "double", "long", "integer", "blob"]
_KIND_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@query(
    "cst03_write_format",
    f"""WITH e AS (SELECT event_id, {_KIND_SQL} AS kind, CAST(event_id % 997 AS DOUBLE) / 4 AS v FROM events)
    SELECT event_id, CASE WHEN kind = 'string' THEN '"' || CAST(v AS VARCHAR) || '"' WHEN kind = 'boolean' THEN 'false' WHEN kind = 'double' THEN CAST(v AS VARCHAR) WHEN kind IN ('long', 'integer') THEN CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) END AS literal FROM e""",
)
def write_format(g: Graph) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 6 + 1).cast("int"))
    return g.table("events").select("event_id", S.written(((F.col("event_id") % 997).cast("double") / 4).cast("string"), kind).alias("literal"))


_DECLARED = "CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN substr(p_brand, 6) ELSE 'unknown' END"


@query(
    "cst06_subtype",
    f"""WITH q AS (SELECT p_partkey, {_DECLARED} AS declared FROM part), t AS (SELECT DISTINCT p_brand AS name FROM part)
    SELECT p_partkey, coalesce(max(CASE WHEN name = declared THEN name END), min(CASE WHEN contains(name, declared) THEN name END), min(name)) AS type_name FROM q, t GROUP BY 1""",
)
def subtype(g: Graph) -> DataFrame:
    """The declared type if known, else the first whose name holds it, else the first."""
    part = g.table("part")
    names = catalog.subtypes(part.select(F.col("p_brand").alias("sub"), F.lit("basket").alias("super")).distinct(), "basket")
    known = [n for n in names if n != "basket"]
    return part.select("p_partkey", catalog.resolved_subtype(F.expr(_DECLARED), known).alias("type_name"))


_OWNS = "o AS (SELECT DISTINCT p_type AS type_name, split_part(p_name, ' ', 1) AS attr FROM part), v AS (SELECT attr, CASE length(attr) % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'date' WHEN 2 THEN 'decimal' ELSE 'duration' END AS declared FROM (SELECT DISTINCT attr FROM o))"
_LABEL = "CASE declared WHEN 'integer' THEN 'long' WHEN 'date' THEN 'datetime' WHEN 'decimal' THEN 'double' ELSE 'string' END"


@query("sch04_value_types", f"WITH {_OWNS}, u AS (SELECT type_name, attr FROM o UNION SELECT p_type || '/' || p_brand, attr FROM part JOIN o ON o.type_name = p_type) SELECT type_name, attr, {_LABEL} AS value_type FROM u JOIN v USING (attr)")
def value_types(g: Graph) -> DataFrame:
    """Value types of own and inherited attributes."""
    attr = F.split("p_name", " ")[0].alias("attr")
    owns = g.table("part").select(F.col("p_type").alias("type_name"), attr).distinct().withColumn("is_key", F.lit(False))
    n = F.length("attr") % 4
    declared = owns.select("attr").distinct().withColumn("value_type", F.when(n == 0, "integer").when(n == 1, "date").when(n == 2, "decimal").otherwise("duration"))
    return catalog.value_types(catalog.owned_attributes(owns, catalog.type_closure(g.sub())), declared)


@query("sch09_child_bearing", "SELECT ptype, coalesce(bool_or(type_name IN (SELECT p_brand FROM part WHERE p_size = 50)), FALSE) AS has_children FROM p LEFT JOIN b USING (provision_id) GROUP BY 1", "pb")
def child_bearing(g: Graph) -> DataFrame:
    """Whether a provision type has entities of a type that plays a parent's role."""
    extracted = g.provisions.select("provision_id", "ptype").join(g.baskets.select("provision_id", "type_name"), "provision_id", "left").select("ptype", "type_name")
    return catalog.child_bearing(extracted, g.table("part").filter("p_size = 50").select(F.col("p_brand").alias("type_name")))


@query(
    "val07_category_order",
    f"WITH {_BANDS_SQL}, x(pre, covenant) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PREFIXES) + "), y AS (SELECT p_partkey, p_size, max_by(covenant, length(pre)) AS t FROM part JOIN x ON starts_with(p_name, pre) GROUP BY 1, 2) SELECT p_partkey, p_size, y.t AS covenant FROM y JOIN bands ON bands.t = y.t WHERE NOT p_size BETWEEN lo AND hi",
)
def category_order(g: Graph) -> DataFrame:
    """Order outside the band of the covenant that the longest known prefix of an id names."""
    prefixes = g.spark.createDataFrame(_PREFIXES, "pre string, covenant string")
    bands = g.spark.createDataFrame(_BANDS, "covenant string, lo int, hi int")
    hit = g.table("part").join(F.broadcast(prefixes), F.startswith("p_name", "pre"))
    named = hit.groupBy("p_partkey", "p_size").agg(F.max_by("covenant", F.length("pre")).alias("covenant"))
    return named.join(F.broadcast(bands), "covenant").filter("p_size not between lo and hi").select("p_partkey", "p_size", "covenant")


# Agreements: a conversation is a document, a turn a page; headings stand before the turns' texts.
_TURNS = "t AS (SELECT conv_id AS doc_id, turn + 1 AS page_number, 'Intro. ' || CASE turn % 3 WHEN 0 THEN 'SECTION 1.01: Defined Terms' WHEN 1 THEN 'x' ELSE 'Section  1.02. Other' END || chr(10) || coalesce(text, '') AS text FROM conversations)"


def turn_pages(g: Graph) -> DataFrame:
    n = F.col("turn") % 3
    heading = F.when(n == 0, "SECTION 1.01: Defined Terms").when(n == 1, "x").otherwise("Section  1.02. Other")
    return g.table("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), F.concat(F.lit("Intro. "), heading, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query("str05_find_section", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, text) AS rn FROM t WHERE contains(text, 'Section  1.02')) SELECT doc_id, page_number, md5(substr(text, 8, 5000)) AS digest FROM r WHERE rn = 1")
def section(g: Graph) -> DataFrame:
    return S.find_section(turn_pages(g), "1.02").select("doc_id", "page_number", F.md5("section").alias("digest"))


@query(
    "str06_definitions_span",
    f"""WITH {_TURNS}, s AS (SELECT doc_id, min(page_number) AS a FROM t WHERE contains(text, 'SECTION 1.01: ') GROUP BY 1), e AS (SELECT doc_id, min(page_number) AS z FROM t JOIN s USING (doc_id) WHERE page_number >= a AND contains(text, 'Section  1.02') GROUP BY 1)
    SELECT doc_id, md5(string_agg('[PAGE ' || CAST(page_number AS VARCHAR) || ']' || chr(10) || text, chr(10) ORDER BY page_number, text)) AS digest FROM t JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) WHERE page_number >= a AND page_number <= coalesce(z, page_number) GROUP BY 1""",
)
def definitions(g: Graph) -> DataFrame:
    return S.definitions_span(turn_pages(g)).select("doc_id", F.md5("definitions").alias("digest"))


@query("str07_defined_terms", "SELECT p_partkey AS doc_id, CASE WHEN p_size > 25 THEN 'Know-How' ELSE 'IP' END AS term, CAST(6 AS INT) AS start, '\"' || CASE WHEN p_size > 25 THEN 'know-how' ELSE 'IP' END || '\" means all rights in and to the ' || p_name || ', wherever they are held.' AS definition FROM part")
def defined(g: Graph) -> DataFrame:
    term = F.when(F.col("p_size") > 25, "know-how").otherwise("IP")
    text = F.concat(F.lit('Title\n"'), term, F.lit('" means all rights in and to the '), "p_name", F.lit(", wherever they are held."), F.when(F.col("p_size") % 2 == 0, '\n\nMore.').otherwise('\n “Other Term” shall mean more.'))
    return S.defined_terms(g.table("part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
