"""Text functions: tokens, page slices, citations, coercion, rendering. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_SLICE = 200_000
# Fixed value: the answer that stands for none.
NOT_FOUND = ("not_found", "n/a", "none", "null")


def tokenize(c: Column, stop_words: list[str], least: int = 3) -> Column:
    """Distinct lower-case words ``[a-z][a-z0-9]+`` of at least ``least`` letters, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9]+)"), F.lit(1))
    stops = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stops, w)))


def grams(c: Column, size: int = 3) -> Column:
    """Distinct stretches of ``size`` letters; empty for shorter words."""
    places = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substr(c, i, F.lit(size)))), F.array().cast("array<string>"))


def holding_words(words: DataFrame, keywords: DataFrame, size: int = 3) -> DataFrame:
    """(word, keyword) for every word that holds a keyword of at least ``size`` letters.

    An inverted index: words by all their grams, a keyword by the one of its grams that the
    fewest words have. They meet by equality and are verified, so no pair is tried in vain
    but for that gram. Both tables have distinct rows.
    """
    indexed = words.select("word", F.explode(grams(F.col("word"), size)).alias("gram"))
    often = indexed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = keywords.filter(F.length("keyword") >= size).select("keyword", F.explode(grams(F.col("keyword"), size)).alias("gram")).join(often, "gram", "left")
    rarest = own.groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("keyword", "r.gram")
    return indexed.join(rarest.hint("shuffle_hash"), "gram").filter(F.contains("word", "keyword")).select("word", "keyword")


def page_marker(n: Column) -> Column:
    return F.concat(F.lit("[PAGE "), n.cast("string"), F.lit("]"))


def marked_text(pages: DataFrame, sep: str = "\n") -> DataFrame:
    """(doc_id, full_text): pages in order, each after its marker. A document's pages meet in one row."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    part = lambda p: F.concat(page_marker(p["page_number"]), F.lit("\n"), F.coalesce(p["text"], F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, part), sep).alias("full_text"))


def page_slice(text: Column, start: Column, end: Column, open_slice: int = OPEN_SLICE) -> Column:
    """From the start page's marker to the marker after the end page; '' without a start, a long cut without an end."""
    at, stop = F.instr(text, page_marker(start)), F.instr(text, page_marker(end + 1))
    return F.when(at == 0, F.lit("")).when(stop == 0, F.substring(text, at, F.lit(open_slice))).otherwise(F.substring(text, at, F.greatest(stop - at, F.lit(0))))


def citations(text: Column) -> Column:
    """Array of (section, page) from ``[Section, p.N]`` and ``[p.N]``."""
    found = F.regexp_extract_all(text, F.lit(r"\[(?:[^\[\],]+, ?)?p\.\s?[0-9]+\]"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.nullif(F.trim(F.regexp_extract(m, r"^\[([^\[\],]+), ?p\.", 1)), F.lit("")).alias("section"), F.regexp_extract(m, r"p\.\s?([0-9]+)\]", 1).cast("int").alias("page")))


def cited(section: Column, page: Column) -> Column:
    """`` [Section, p.N]`` by what there is of both; empty without either."""
    p = F.concat(F.lit("p."), page.cast("string"))
    inner = F.concat_ws(", ", section, p)
    return F.when(section.isNull() & page.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ["), inner, F.lit("]")))


def ordered_citations(cited: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, page, section, place): citations in page order, those with a section before a page alone, then by ``seq``.

    A page alone is kept once, and only where no citation with a section has it.
    """
    page = Window.partitionBy(*keys, "page")
    alone = F.col("section").isNull()
    first = F.row_number().over(page.orderBy(alone, seq))
    marked = cited.withColumn("_named", F.bool_or(~alone).over(page)).withColumn("_n", first).filter(~alone | (~F.col("_named") & (F.col("_n") == 1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("page", F.col("section").isNull(), seq))
    return marked.select(*keys, "page", "section", place.alias("place"))


def section_reference(text: Column) -> Column:
    """First ``Section 1.02(a)``-like reference, else ``§``-like."""
    one = F.nullif(F.regexp_extract(text, r"(?i)section\s+([0-9]+\.[0-9]+(?:\([a-z0-9]+\))*)", 1), F.lit(""))
    two = F.nullif(F.trim(F.regexp_extract(text, r"§\s*([0-9]+(?:\.[0-9]+)?)", 1)), F.lit(""))
    return F.coalesce(one, two)


def evidence_ids(text: Column) -> Column:
    """Ids listed after ``EVIDENCE:``, trimmed, in order."""
    block = F.regexp_extract(text, r"(?i)evidence:\s*\[?([^\]\n]*)", 1)
    return F.filter(F.transform(F.split(block, ","), lambda x: F.trim(x)), lambda x: x != "")


def _bare(c: Column, ends: str) -> Column:
    return F.regexp_replace(F.trim(c), f"^[{ends}]+|[{ends}]+$", "")


def _present(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NOT_FOUND) & (F.trim(c) != ""), c)


def coerce_number(c: Column) -> Column:
    """Number text to double: quotes, $, % and commas go at the ends only, so ``1,000`` is null."""
    return _bare(_present(c), "'\"$%,").try_cast("double")


def coerce_integer(c: Column) -> Column:
    return coerce_number(c).try_cast("long")


def coerce_boolean(c: Column) -> Column:
    low = F.lower(F.trim(_present(c)))
    return F.when(low.isNotNull(), low.isin("true", "yes", "1"))


def coerce_legacy_integer(c: Column) -> Column:
    """The older coercion: numbers become integers, only quotes are stripped."""
    return _bare(_present(c), "'\"").try_cast("double").try_cast("long")


def storage_type(answer_type: Column) -> Column:
    return F.when(answer_type.isin("number", "currency", "percentage"), "double").when(answer_type == "boolean", "boolean").when(answer_type.isin("string", "multiselect"), "string").when(answer_type == "integer", "integer")


def typed_answer(value: Column, kind: Column) -> list[Column]:
    """Five columns of which the storage type's own is filled."""
    return [
        F.when(kind == "boolean", coerce_boolean(value)).alias("answer_boolean"),
        F.when(kind == "integer", coerce_integer(value)).alias("answer_integer"),
        F.when(kind == "double", coerce_number(value)).alias("answer_double"),
        F.when(kind == "string", _present(value)).alias("answer_string"),
        F.when(kind == "date", F.to_date(_present(value).try_cast("date"))).alias("answer_date"),
    ]


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(c, 0), 0))


def tenths(c: Column) -> Column:
    """A number to one decimal as its exact binary value has it, halves to even: ten times the number is taken with its rounding error."""
    a, b = c * 8, c * 2
    whole = F.floor(a + b).cast("double")
    part, error = a + b - whole, (a - (a + b - (a + b - a))) + (b - (a + b - a))
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1))))
    return (whole + up.cast("double")) / 10


def percent(c: Column) -> Column:
    """Shares up to 1 become whole per cents, larger numbers keep one decimal; halves go to the even digit."""
    return F.when(c.isNull(), None).when(c <= 1, F.format_string("%.0f%%", F.bround(c * 100, 0))).otherwise(F.format_string("%.1f%%", tenths(c)))


def rendered(c: Column) -> Column:
    """Whole doubles without decimals, others as they are."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def provision_type(pid: Column) -> Column:
    suffix = F.substring_index(pid, "_", -1)
    return F.when(suffix.isin("mfn", "di"), suffix).otherwise("rp")


def category_fallback(question_id: Column) -> Column:
    second = F.upper(F.substring(F.try_element_at(F.split(question_id, "_"), F.lit(2)), 1, 1))
    return F.coalesce(F.nullif(second, F.lit("")), F.lit("Z"))


def json_block(c: Column) -> Column:
    """From the first { to the last }, trailing commas mended."""
    return F.regexp_replace(F.regexp_extract(c, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1")


def json_array_block(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"(?s)(\[.*\])", 1), r",\s*([}\]])", "$1")
