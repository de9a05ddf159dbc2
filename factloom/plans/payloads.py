"""Statements scanned with their quotes, payloads of unknown type, rendered answers with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import script as S
from ..functions import text as T
from .model import Graph, query


@query(
    "oth24_statements",
    """WITH x AS (SELECT doc_id, row_number() OVER () AS r, string_split(translate(text, '.,', ';"'), '"') AS parts FROM documents WHERE text IS NOT NULL),
    j AS (SELECT doc_id, r, string_split(array_to_string(list_transform(parts, lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, ';', chr(1)) ELSE p END), '"'), ';') AS ps FROM x),
    e AS (SELECT doc_id, r, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM j),
    l AS (SELECT *, coalesce(sum(length(p) - length(replace(p, chr(10), ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e),
    k AS (SELECT doc_id, r, i, n, b, p, regexp_extract(p, '^[ \\t\\n\\f\\v\\r]*') AS lead FROM l WHERE regexp_matches(p, '[^ \\t\\n\\f\\v\\r]'))
    SELECT doc_id, row_number() OVER (PARTITION BY r ORDER BY i) AS statement, CAST(b + length(lead) - length(replace(lead, chr(10), '')) + 1 AS BIGINT) AS line, i < n AS closed, md5(replace(regexp_replace(p, '^[ \\t\\n\\f\\v\\r]+|[ \\t\\n\\f\\v\\r]+$', '', 'g'), chr(1), ';')) AS digest FROM k""",
)
def statements(g: Graph) -> DataFrame:
    """Statements of every document, whose full stops end them and whose commas stand for quotes."""
    docs = g.table("documents").select("doc_id", F.translate("text", ".,", ';"').alias("text"))
    return S.statement_spans(docs).select("doc_id", "statement", "line", "closed", F.md5("text").alias("digest"))


def scripts(g: Graph, gaps: bool = False) -> DataFrame:
    """(file, text): seed scripts of three lines a question: a comment, then a statement whose values hold semicolons, escapes and quotes.

    With ``gaps``, some statements lack a share or have a blank id.
    """
    k, q, size = F.col("p_partkey").cast("string"), '"', F.col("p_size")
    share = F.concat(F.lit(", has share "), (size + 0.5).cast("string"))
    name = F.concat(F.lit(f"{q}p;"), k, F.lit(f"\\{q}x\\\\{q}"))
    if gaps:
        share, name = F.when(size % 6 == 0, "").otherwise(share), F.when(size % 11 == 0, f"{q} {q}").otherwise(name)
    lines = F.concat(
        F.lit("  # part "), k, F.lit(f"; not {q}here\ninsert $q isa question, has question_id "), name, F.lit(",\n    has display_order "), size.cast("string"), share, F.lit(", has shown "), (size > 25).cast("string"), F.lit(";\n"),
    )
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", lines.alias("x"))))
    return g.table("part").groupBy(F.col("p_type").alias("file")).agg(F.array_join(F.transform(listed, lambda s: s["x"]), "").alias("text"))


@query(
    "oth24_attributes",
    """WITH n AS (SELECT p_type AS file, 3 * row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS line, p_partkey, p_size FROM part)
    SELECT file, line, 'question_id' AS attr, 'string' AS kind, concat('p;', p_partkey, '"x', chr(92)) AS value FROM n UNION ALL SELECT file, line, 'display_order', 'long', CAST(p_size AS VARCHAR) FROM n
    UNION ALL SELECT file, line, 'share', 'double', concat(p_size, '.5') FROM n UNION ALL SELECT file, line, 'shown', 'boolean', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM n""",
)
def statement_attributes(g: Graph) -> DataFrame:
    """Attributes of every statement of the seed scripts with the statement's line."""
    return S.statement_spans(scripts(g), "file").select("file", "line", F.inline(S.attributes_of(F.col("text"))))


_REQUIRED = ("question_id", "display_order", "share", "shown")


@query(
    "val03_missing_attributes",
    """WITH n AS (SELECT p_type AS file, 3 * row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS line, p_size FROM part)
    SELECT file, line, 'share' AS attr FROM n WHERE p_size % 6 = 0 UNION ALL SELECT file, line, 'question_id' FROM n WHERE p_size % 11 = 0""",
)
def missing_attributes(g: Graph) -> DataFrame:
    """Required attributes that a statement of the seed scripts lacks or leaves blank, with the statement's line."""
    has = lambda a: F.exists("held", lambda x: (x["attr"] == a) & (F.trim(x["value"]) != ""))
    held = S.statement_spans(scripts(g, gaps=True), "file").select("file", "line", S.attributes_of(F.col("text")).alias("held"))
    wrong = F.filter(F.array(*[F.when(~has(a), F.lit(a)) for a in _REQUIRED]), lambda x: x.isNotNull())
    return held.select("file", "line", F.explode(wrong).alias("attr"))


def payloads(g: Graph) -> DataFrame:
    """(event_id, payload): objects of mixed fields, some of them cut off."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    doc = F.to_json(F.struct(k.alias("k"), F.when(n % 3 != 0, F.col("value")).alias("value"), F.col("event_type").alias("name"), (n % 2 == 0).alias("even"), F.array("user_id").alias("users"), F.when(n % 4 == 0, F.struct("user_id")).alias("who")))
    return g.table("events").select("event_id", F.when(n % 17 == 0, F.concat(F.lit("{"), doc)).otherwise(doc).alias("payload"))


_FIELDS = """v AS (SELECT event_id, event_type, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 17 <> 0),
f AS (SELECT event_id, 'k' AS field, 'integer' AS kind, CAST(k AS VARCHAR) AS value FROM v UNION ALL SELECT event_id, 'value', CASE WHEN value = floor(value) THEN 'number' ELSE 'number' END, CAST(value AS VARCHAR) FROM v WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'name', 'string', event_type FROM v UNION ALL SELECT event_id, 'even', 'boolean', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM v
  UNION ALL SELECT event_id, 'users', 'list', concat('[', user_id, ']') FROM v UNION ALL SELECT event_id, 'who', 'object', concat('{"user_id":', user_id, '}') FROM v WHERE event_id % 4 = 0)"""


def numbers(df: DataFrame) -> DataFrame:
    """Numbers rounded to cents, so that they show alike everywhere."""
    return df.withColumn("value", F.when(F.col("kind") == "number", F.format_string("%.2f", F.col("value").cast("double"))).otherwise(F.col("value")))


_CENTS = "CASE WHEN kind = 'number' THEN format('{:.2f}', CAST(value AS DOUBLE)) ELSE value END"


@query("oth12_payload_fields", f"WITH {_FIELDS} SELECT event_id, field, kind, {_CENTS} AS value FROM f")
def payload_fields(g: Graph) -> DataFrame:
    """One row a field of every payload, with its type; payloads that are no JSON have none."""
    return numbers(P.fields(payloads(g), "event_id", "payload"))


_DEFAULTS = [("value", "number", "0"), ("who", "object", "{}"), ("name", "string", "")]


@query(
    "oth15_filled_fields",
    f"""WITH {_FIELDS}, d(field, dkind, dvalue) AS (VALUES {", ".join(str(x) for x in _DEFAULTS)}), y AS (SELECT event_id, field, kind, value, true AS given FROM f UNION ALL
    SELECT e.event_id, d.field, dkind, dvalue, false FROM events e CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.event_id = e.event_id AND f.field = d.field)) SELECT event_id, field, kind, {_CENTS} AS value, given FROM y""",
)
def filled_fields(g: Graph) -> DataFrame:
    """Fields of every payload with the defaults of those that it lacks."""
    rows = payloads(g)
    defaults = g.spark.createDataFrame(_DEFAULTS, "field string, kind string, value string")
    return numbers(P.filled(P.fields(rows, "event_id", "payload"), rows, "event_id", defaults))


@query("oth15_round_trip", """SELECT event_id, concat('{"a":', user_id, ',"k":', CAST(json_extract(props, '$.k') AS BIGINT), ',"z":"', event_type, '"}') AS cached FROM events""")
def round_trip(g: Graph) -> DataFrame:
    """A cached object parsed and written again: fields by name, values as they were."""
    doc = F.to_json(F.struct(F.col("event_type").alias("z"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("user_id").alias("a")))
    return g.table("events").select("event_id", F.to_json(F.try_parse_json(doc)).alias("cached"))


@query("oth15_payload_schema", "SELECT event_type, 'OBJECT<k: BIGINT>' AS schema FROM events GROUP BY 1")
def payload_schema(g: Graph) -> DataFrame:
    """The schema that the payloads of every type have in common."""
    return g.table("events").groupBy("event_type").agg(F.schema_of_variant_agg(F.try_parse_json("props")).alias("schema"))


# Answers of a provision as context: by category and question, each with its citation.


_CONTEXT = """w AS (SELECT provision_id, question_id, max_by(answer_id, answer_id) AS id FROM a WHERE confidence <> 'not_found' GROUP BY 1, 2),
c AS (SELECT w.provision_id, w.question_id, id, CASE WHEN id % 3 <> 0 THEN 'Section ' || (id % 9) || '.0' || (id % 5) END AS section, CASE WHEN id % 4 <> 0 THEN id % 300 END AS page,
  CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'Yes' ELSE 'No' END WHEN id % 5 = 1 THEN CAST(id % 70 AS VARCHAR) ELSE (id % 70) || '.5' END AS shown, CASE WHEN id % 7 <> 0 THEN upper(left(w.question_id, 1)) END AS category FROM w),
l AS (SELECT provision_id, coalesce(category, 'ZZ') AS category, question_id, page, section, concat('- ', question_id, ': ', shown, CASE WHEN section IS NOT NULL AND page IS NOT NULL THEN concat(' [', section, ', p.', page, ']') WHEN section IS NOT NULL THEN concat(' [', section, ']') WHEN page IS NOT NULL THEN concat(' [p.', page, ']') ELSE '' END) AS line FROM c)"""


def context_lines(g: Graph) -> DataFrame:
    """(provision_id, category, question_id, page, section, line): the last answer to every question, rendered and cited; uncategorised ones come last."""
    n = F.col("id")
    found = g.answers.filter(F.col("confidence") != "not_found").groupBy("provision_id", "question_id").agg(F.max("answer_id").alias("id"))
    section = F.when(n % 3 != 0, F.concat(F.lit("Section "), (n % 9).cast("string"), F.lit(".0"), (n % 5).cast("string")))
    half = F.when(n % 5 == 1, n % 70).otherwise(n % 70 + 0.5)
    shown = F.when(n % 5 == 0, F.when(n % 2 == 0, "Yes").otherwise("No")).otherwise(T.rendered(half.cast("double")))
    rows = found.select("provision_id", "question_id", section.alias("section"), F.when(n % 4 != 0, n % 300).alias("page"), shown.alias("shown"), F.when(n % 7 != 0, F.upper(F.left("question_id", F.lit(1)))).alias("category"))
    line = F.concat(F.lit("- "), "question_id", F.lit(": "), "shown", T.cited(F.col("section"), F.col("page")))
    return rows.select("provision_id", F.coalesce("category", F.lit("ZZ")).alias("category"), "question_id", "page", "section", line.alias("line"))


@query(
    "qry23_context",
    f"""WITH {_CONTEXT}, h AS (SELECT provision_id, category, concat('### ', category, chr(10), string_agg(line, chr(10) ORDER BY question_id)) AS block FROM l GROUP BY 1, 2)
    SELECT provision_id, concat('## EXTRACTED ANSWERS', chr(10), string_agg(block, chr(10) ORDER BY category)) AS context FROM h GROUP BY 1""",
    "a",
)
def context(g: Graph) -> DataFrame:
    """The structured context of every provision; a provision has as many lines as there are questions."""
    blocks = context_lines(g).groupBy("provision_id", "category").agg(F.array_sort(F.collect_list(F.struct("question_id", "line"))).alias("x"))
    shown = blocks.select("provision_id", "category", F.concat(F.lit("### "), "category", F.lit("\n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("block"))
    whole = shown.groupBy("provision_id").agg(F.array_sort(F.collect_list(F.struct("category", "block"))).alias("x"))
    return whole.select("provision_id", F.concat(F.lit("## EXTRACTED ANSWERS\n"), F.array_join(F.transform("x", lambda s: s["block"]), "\n")).alias("context"))


@query("qry23_flat_context", f"WITH {_CONTEXT} SELECT provision_id, string_agg(line, chr(10) ORDER BY page NULLS FIRST, question_id) AS context FROM l GROUP BY 1", "a")
def flat_context(g: Graph) -> DataFrame:
    """The same answers as one list in page order."""
    whole = context_lines(g).groupBy("provision_id").agg(F.array_sort(F.collect_list(F.struct("page", "question_id", "line"))).alias("x"))
    # array_sort puts a null field first, as the order asks.
    return whole.select("provision_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("context"))


@query(
    "win07_ordered_citations",
    f"""WITH {_CONTEXT}, s AS (SELECT provision_id, question_id, page, section, 0 AS alone FROM l WHERE page IS NOT NULL AND section IS NOT NULL UNION ALL
      SELECT provision_id, min(question_id), page, NULL, 1 FROM l x WHERE page IS NOT NULL AND section IS NULL AND NOT EXISTS (SELECT 1 FROM l y WHERE y.provision_id = x.provision_id AND y.page = x.page AND y.section IS NOT NULL) GROUP BY provision_id, page)
    SELECT provision_id, page, section, row_number() OVER (PARTITION BY provision_id ORDER BY page, alone, question_id) AS place FROM s""",
    "a",
)
def ordered_citations(g: Graph) -> DataFrame:
    """Citations of a provision's answers by page; those with a section first, and a page alone only once and only where no section has named it."""
    cited = context_lines(g).filter("page is not null").select("provision_id", "question_id", "page", "section")
    return T.ordered_citations(cited, ["provision_id"], "question_id")
