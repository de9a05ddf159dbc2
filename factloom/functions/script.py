"""Functions on seed scripts, sections and definitions. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import page_marker

SECTION_LENGTH, DEFINITION_LENGTH, BUCKET = 5_000, 4_000, 200

# The terms whose definitions are looked for, in order of preference.
TERMS = [
    "Intellectual Property", "Material Intellectual Property", "Material IP", "IP", "Transfer", "Disposition", "Material", "Materiality",
    "Unrestricted Subsidiary", "Excluded Subsidiary", "Restricted Subsidiary", "Non-Guarantor Restricted Subsidiary", "Loan Party", "Credit Party",
    "Guarantor", "Subsidiary Guarantor", "Permitted Investment", "Investment", "Permitted Lien", "Permitted Encumbrance", "Collateral", "Pledged Assets",
    "Exclusive License", "License", "Trade Secret", "Know-How", "Patent", "Trademark", "Copyright", "Principal Property", "Material Asset",
]
# What may follow a quoted term in its definition.
MEANS = r"\s*(?:means?|shall mean|is defined as|has the meaning)"


def lines_of(lines: DataFrame) -> DataFrame:
    """(file, line, text) trimmed, without blank and comment lines; a null text counts as blank."""
    return lines.select("file", "line", F.trim("text").alias("text")).filter("text <> '' and text not like '#%'")


def statements(lines: DataFrame, mixed: bool = True) -> DataFrame:
    """(file, statement, phase, n_lines, text): a script's statements, standalone inserts in phase 1.

    With ``mixed``, ``match`` opens a statement and the first ``insert`` after it belongs
    to it; any other ``insert`` stands alone, and lines before the first of them are
    dropped. Without, every line that starts with ``insert`` opens a statement and
    earlier lines form one. A script's lines meet in one window; scripts are
    schema-sized, and many of them are worked on side by side. Lines with one number are
    taken in the order of their texts.
    """
    w = Window.partitionBy("file").orderBy("line", "text")
    text = F.col("text")
    if mixed:
        head = F.when(text.rlike(r"^match( |$)"), "match").when(text.rlike(r"^insert( |$)"), "insert")
        before = F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = lines_of(lines).withColumn("head", head).withColumn("before", before)
        opens = (F.col("head") == "match") | ((F.col("head") == "insert") & ~F.col("before").eqNullSafe(F.lit("match")))
    else:
        marked = lines_of(lines).withColumn("head", F.lit("insert"))
        opens = text.startswith("insert")
    numbered = marked.withColumn("statement", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = numbered.filter("statement > 0") if mixed else numbered
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    phase = F.max(F.when(F.col("head") == "match", 2).otherwise(1)).alias("phase")
    return kept.groupBy("file", "statement").agg(phase, F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def escaped(c: Column) -> Column:
    """Backslashes, quotes and line feeds escaped, carriage returns gone; null becomes empty."""
    out = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def written(value: Column, kind: Column, limit: int = 2000) -> Column:
    """A value's text as a literal of its schema type; null for null values, unknown types and unfit numbers.

    Integer types are coerced like ``long``.
    """
    number = value.try_cast("double")
    return (
        F.when(value.isNull(), None)
        .when(kind == "string", F.concat(F.lit('"'), escaped(F.left(value, F.lit(limit))), F.lit('"')))
        .when(kind == "boolean", F.lower(value).isin("true", "yes", "1").cast("string"))
        .when(kind == "double", number.cast("string"))
        .when(kind.isin("long", "integer"), number.try_cast("long").cast("string"))
    )


def selected_variables(statement: Column) -> Column:
    """Names of the variables in a statement's select clause, in order; empty without one."""
    clause = F.regexp_extract(statement, r"(?is)select\s+(.+?);", 1)
    return F.regexp_extract_all(clause, F.lit(r"\$(\w+)"), F.lit(1))


def find_section(pages: DataFrame, section_id: str, limit: int = SECTION_LENGTH) -> DataFrame:
    """(doc_id, page_number, section): the first page with ``Section <id>``, from there on, ``limit`` characters at most."""
    ahead = F.split("text", rf"(?i)Section\s+\Q{section_id}\E", 2)
    found = pages.select("doc_id", "page_number", F.when(F.size(ahead) > 1, F.substring("text", F.length(ahead[0]) + 1, F.lit(limit))).alias("section")).filter("section is not null")
    return found.groupBy("doc_id").agg(F.min(F.struct("page_number", "section")).alias("x")).select("doc_id", "x.page_number", "x.section")


def definitions_span(pages: DataFrame) -> DataFrame:
    """(doc_id, definitions): marked pages from the first start heading through the first page, the same or later, with the next section's."""
    w = Window.partitionBy("doc_id")
    starts = F.col("text").rlike(r"(?i)Section\s+1\.01[:.]?\s*(Defined Terms|Definitions)")
    first = pages.withColumn("_start", F.min(F.when(starts, F.col("page_number"))).over(w)).filter("page_number >= _start")
    last = first.withColumn("_end", F.min(F.when(F.col("text").rlike(r"Section\s+1\.02"), F.col("page_number"))).over(w))
    inside = last.filter("_end is null or page_number <= _end").select("doc_id", "page_number", F.concat(page_marker(F.col("page_number")), F.lit("\n"), "text").alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return inside.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("definitions"))


def defined_terms(docs: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """(doc_id, term, start, definition): definitions of known quoted terms, one for each 200 characters of text.

    A definition runs from its line's start (at most 500 characters back) to the next
    quoted definition, else the next blank line, else 4,000 characters on. Terms of one
    stretch of text compete; the one listed first, then the first in the text, wins.
    Rows are read one by one, so null and repeated ids do no harm, and no text is shuffled.
    """
    any_term = "|".join(rf"\Q{t}\E" for t in terms)
    pattern = rf'(?i)["“](?:{any_term})["”]{MEANS}'
    text, listed = F.col("text"), F.array(*(F.lit(t.lower()) for t in terms))
    cut = docs.filter(text.rlike(pattern)).select("doc_id", "text", F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    gaps = F.slice("gaps", 1, F.size("hits"))
    starts = F.zip_with(sums_before(F.zip_with(gaps, "hits", lambda g, h: F.length(g) + F.length(h))), gaps, lambda n, g: n + F.length(g))
    rank = lambda h: F.array_position(listed, F.lower(F.regexp_extract(h, r'^["“]([^"”]*)', 1)))
    found = F.zip_with(starts, "hits", lambda s, h: F.struct(F.floor(s / BUCKET).alias("bucket"), rank(h).alias("rank"), s.alias("start")))
    best = _once(F.array_sort(found), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["bucket"] != x["bucket"])))

    def definition(near: Column) -> Column:
        text, start = near["text"], near["start"]
        lead = F.length(F.substring_index(F.substring(text, F.greatest(start - 500, F.lit(0)) + 1, F.least(start, F.lit(500))), "\n", -1))
        ahead = F.substring(text, start + 51, F.lit(DEFINITION_LENGTH - 50))
        following = F.split(ahead, r'\n\s*["“][A-Z][a-zA-Z\s]+["”]\s*(?:means?|shall mean|is defined|has the meaning)', 2)
        rest = F.when(F.size(following) > 1, following[0]).otherwise(F.substring_index(ahead, "\n\n", 1))
        return F.trim(F.concat(F.substring(text, start - lead + 1, lead + 50), rest))

    def around(pieces: Column, start: Column) -> Column:
        """The piece of a place with the one before and the one after, so that no definition reads the whole text."""
        first = F.greatest(F.floor(start / DEFINITION_LENGTH).cast("int") - 1, F.lit(0))
        return F.struct(F.array_join(F.slice(pieces, first + 1, F.lit(3)), "").alias("text"), (start - first * DEFINITION_LENGTH).alias("start"))

    term = lambda x: F.element_at(F.array(*map(F.lit, terms)), x["rank"].cast("int"))
    row = lambda pieces, x: F.struct(term(x).alias("term"), x["start"].alias("start"), _once(around(pieces, x["start"]), definition).alias("definition"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DEFINITION_LENGTH}}}"), F.lit(0))
    return cut.select("doc_id", F.inline(_once(pieces, lambda ps: F.transform(best, lambda x: row(ps, x)))))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def sums_before(numbers: Column) -> Column:
    """For each entry of an array the sum of those before it. Entries are summed by blocks, so n of them take n ** 1.5 steps."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)

    def sums(all_: Column) -> Column:
        n = F.size(all_)
        size = F.ceil(F.sqrt(n)).cast("int")
        places = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        number = lambda i: F.floor(i / size).cast("int")
        blocks = F.transform(F.filter(places(all_), lambda i: i % size == 0), lambda i: total(F.slice(all_, i + 1, size)))
        before = lambda found: F.transform(places(found), lambda b: total(F.slice(found, F.lit(1), b)))
        each = lambda ahead: F.transform(places(all_), lambda i: F.get(ahead, number(i)) + total(F.slice(all_, i - i % size + 1, i % size)))
        return _once(_once(blocks, before), each)

    return _once(numbers, sums)


# Stand for an escaped backslash, quote or semicolon while a text is cut. They are no characters
# of any text (noncharacters of Unicode); where a text has them all the same, they become those.
_HELD = ("\ufdd0", "\ufdd1", "\ufdd2")


def _swapped(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without_comments(c: Column) -> Column:
    """Lines that begin with ``#`` made empty, so that line numbers stay."""
    return F.regexp_replace(c, r"(^|\n)[ \t\f\x0B\r]*#[^\n]*", "$1")


def statement_pieces(c: Column) -> Column:
    """A text cut at the semicolons that end statements: those that are neither escaped nor inside quotes.

    Escaped pairs are held apart first. What is left between quotes is, by turns, outside
    and inside, so one split by quotes settles every semicolon at once.
    """
    slash, quote, end = _HELD
    held = _swapped(c, [("\\\\", slash * 2), ('\\"', "\\" + quote), ("\\;", "\\" + end)])
    inside = F.transform(F.split(held, '"', -1), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(";"), F.lit(end))).otherwise(x))
    return F.transform(F.split(F.array_join(inside, '"'), ";", -1), lambda x: _swapped(x, [(slash, "\\"), (quote, '"'), (end, ";")]))


def statement_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, statement, line, closed, text): the statements of every text in order, with the line each begins in; blank ones are left out, and the last may lack its semicolon.

    A null text has none. Texts of one key are told apart by row.
    """
    cut = docs.select(F.monotonically_increasing_id().alias("_row"), key, statement_pieces(without_comments(F.col("text"))).alias("pieces"))
    each = cut.select("_row", key, F.size("pieces").alias("of"), F.posexplode("pieces").alias("at", "piece"))
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lead = ends(F.regexp_extract("piece", r"^[\s\x0B]*", 0))
    placed = each.withColumn("line", F.coalesce(F.sum(ends(F.col("piece"))).over(before), F.lit(0)) + lead + 1)
    full = placed.filter(F.col("piece").rlike(r"[^\s\x0B]"))
    numbered = full.withColumn("statement", F.row_number().over(Window.partitionBy("_row").orderBy("at")))
    return numbered.select(key, "statement", "line", (F.col("at") + 1 < F.col("of")).alias("closed"), F.regexp_replace("piece", r"^[\s\x0B]+|[\s\x0B]+$", "").alias("text"))


def attributes_of(statement: Column) -> Column:
    """Array of (attr, kind, value) from the ``has <attr> <value>`` pairs of a statement; quoted values without quotes and escapes."""
    pair = r'\bhas\s+([a-z_][a-z0-9_]*)\s+("(?:[^"\\]|\\.)*+"|true|false|-?[0-9]+(?:\.[0-9]+)?)'
    value = lambda m: F.regexp_extract(m, pair, 2)
    kind = lambda v: F.when(F.startswith(v, F.lit('"')), "string").when(v.isin("true", "false"), "boolean").when(F.contains(v, F.lit(".")), "double").otherwise("long")
    bare = lambda v: F.when(F.startswith(v, F.lit('"')), _swapped(F.substring(v, F.lit(2), F.length(v) - 2), [("\\\\", _HELD[0]), ("\\n", "\n"), ("\\t", "\t"), ("\\", ""), (_HELD[0], "\\")])).otherwise(v)
    found = F.regexp_extract_all(statement, F.lit(pair), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pair, 1).alias("attr"), kind(value(m)).alias("kind"), bare(value(m)).alias("value")))
