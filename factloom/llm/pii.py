"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations only.

Base finds are the leftmost non-overlapping matches of one pattern a kind, checked
and never retried. They are the seeds of the bootstrap. *Slots* are all tokens of
an identifier's shape (digits or an at sign, or grouped digits). The words around a
slot give its lexical patterns, from specific to general: two words before, one
before and one after, two after, one before (lower case, without punctuation at the
edges; a slot beside it counts as the word ``#``). Patterns and slot values form a
bipartite graph. In every round a pattern's confidence for a kind is the number of
its distinct values known so far over the number of its values plus one; patterns
with ``MIN_SUPPORT`` known values and ``MIN_CONFIDENCE`` make their other values of
the kind's shape known, with the best confidence among their patterns, and those are
support in the next round. Rounds end when neither a pattern nor a value is new. Slots
with a known value under an accepted pattern are spans too, where they don't touch
a base find. Confidence is a ratio of counts, so that results repeat.

The texts are read once; what leaves the scan is one row a find, slot or document.
Positions come from the lengths of the gaps between matches, summed in order.

Defined results: a null text counts as empty; ids and texts may repeat (each row
has its own result); an empty table gives an empty result; a document without
finds has an empty ``spans``; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Matches equal those of the plain patterns; atomic runs and the look-behinds only keep the search linear
#: (a run's later starts fail as its first does; \G lets a match start where the last one ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can match at all.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
SLOT = r"(?<!\S)(?:[+(]?[0-9](?:[().\x20-]{0,3}+[0-9]){5,}+|[^\s0-9@]*+[0-9@]\S*+)"
EDGE = r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$"
MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.6
#: Least and most digits of a discovered value; a discovered email has an at sign.
SHAPES = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
MASKS = {k: f"[{k.upper()}]" for k in KINDS}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.transform(at, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    card = F.length(digits).between(16, 19) & F.coalesce(F.when(F.length(digits).between(16, 19), luhn(digits)), F.lit(False))
    return F.coalesce(F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.length(digits).between(8, 15)), F.lit(False))


def shaped(kind: Column, value: Column) -> Column:
    """Whether a slot's value has the shape of a kind."""
    n, at = F.length(_digits(value)), F.contains(value, F.lit("@"))
    of = {k: n.between(*v) & ~at for k, v in SHAPES.items()} | {"email": at}
    of["ip"] = of["ip"] & (F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))) == 3)
    return reduce(lambda a, k: a.when(kind == k, of[k]), of, F.when(F.lit(False), False))


def _words(near: Column) -> Column:
    """The words of a piece of text in lower case, without punctuation at the edges."""
    words = F.filter(F.split(near, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.transform(words, lambda w: F.lower(F.when(bare(w) != "", bare(w)).otherwise(w)))


def patterns_of(before: Column, after: Column) -> Column:
    """The lexical patterns of a slot between two words before and two after."""
    b2, b1, a1, a2 = before[0], before[1], after[0], after[1]
    word = lambda *c: reduce(lambda x, y: x | y, [~x.isin("#", "^", "$") for x in c])  # noqa: E731 (a word at all)
    some = [F.when(word(*c), F.concat(F.lit(f"{name} "), *[x for y in c for x in (F.lit(" "), y)])) for name, c in (("before", (b2, b1)), ("between", (b1, a1)), ("after", (a1, a2)), ("next", (b1,)))]
    return F.array_distinct(F.filter(F.array(*some), lambda p: p.isNotNull()))


def finds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, th, src, start, end, value, patterns): every base match and slot, and one bare row a document.

    ``rid`` numbers the rows, ``th`` is a hash of the text; start and end are code points.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = PATTERNS | {"slot": SLOT}
    none, no_words = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    found = rows.select("*", F.xxhash64("text").alias("th"), *[(F.when(F.contains("text", F.lit(HINTS[k])), m).otherwise(none) if k in HINTS else m).alias(k) for k, p in patterns.items() for m in [F.regexp_extract_all("text", F.lit(p), F.lit(0))]])
    split = found.select("*", *[F.when(F.size(k) > 0, F.split("text", p, -1)).alias(f"{k}_gaps") for k, p in patterns.items()])

    def listed(k: str) -> Column:
        gap = lambda i: F.col(f"{k}_gaps")[i]

        plain = lambda c: F.regexp_replace(c, r"\s+", " ")

        def near(i: Column) -> Column:
            # The last and the first words, whatever white space stands between them.
            left, right = F.when(i == 0, "^").otherwise("#"), F.when(i + 1 == F.size(k), "$").otherwise("#")
            before = F.concat(F.array(left, left), _words(F.substring_index(plain(gap(i)), " ", -4)))
            after = F.concat(_words(F.substring_index(plain(gap(i + 1)), " ", 4)), F.array(right, right))
            return patterns_of(F.slice(before, -2, 2), F.slice(after, 1, 2))

        wanted = lambda m: (F.length(_digits(m)) >= 4) | F.contains(m, F.lit("@"))
        around = lambda m, i: F.when(wanted(m), near(i)).otherwise(no_words) if k == "slot" else no_words
        return F.transform(F.col(k), lambda m, i: F.struct(F.lit(k).alias("src"), i.alias("at"), F.length(gap(i)).cast("long").alias("gap"), around(m, i).alias("patterns"), m.alias("value")))

    bare = F.array(F.struct(F.lit(None).cast("string").alias("src"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("gap"), no_words.alias("patterns"), F.lit("").alias("value")))
    each = split.select("rid", "doc_id", "th", F.inline(F.concat(bare, *[listed(k) for k in patterns])))
    w = Window.partitionBy("rid", "src").orderBy("at")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(w)).withColumn("start", F.col("end") - F.length("value"))
    slot = F.col("src") == "slot"
    lead = F.when(slot, F.length("value") - F.length(F.regexp_replace("value", r"^[^0-9A-Za-z+(]+", ""))).otherwise(0)
    clean = F.when(slot, F.regexp_replace("value", EDGE, "")).otherwise(F.col("value"))
    keep = F.col("src").isNull() | (slot & (F.size("patterns") > 0)) | (~slot & valid(F.col("src"), F.col("value")))
    out = placed.filter(keep).select("rid", "doc_id", "th", "src", (F.col("start") + lead).alias("start"), clean.alias("value"), "patterns")
    return out.withColumn("end", F.col("start") + F.length("value"))


def bootstrap(found: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(patterns: pattern, kind, confidence; values: value, kind, confidence) once a round adds nothing.

    Known values only grow in number, and with them the confidence of patterns, so the rounds end.
    """
    seeds = found.filter(F.col("src").isin(*KINDS)).select("value", F.col("src").alias("kind")).distinct().withColumn("confidence", F.lit(1.0))
    edges = cut_lineage(found.filter("src = 'slot'").select(F.explode("patterns").alias("pattern"), "value").distinct())
    # Patterns with too few values can never have the support.
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
    edges = cut_lineage(edges.join(sizes, "pattern"))
    known, before = seeds, None
    while True:
        hits = edges.join(known.select("value", "kind"), "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"))
        accepted = hits.select("pattern", "kind", (F.col("hits") / (F.col("n") + 1)).alias("confidence"), "hits").filter((F.col("hits") >= min_support) & (F.col("confidence") >= min_confidence))
        patterns = cut_lineage(accepted.drop("hits"))
        fresh = edges.join(patterns, "pattern").filter(shaped(F.col("kind"), F.col("value"))).join(seeds.select("value", "kind"), ["value", "kind"], "left_anti")
        known = cut_lineage(seeds.unionByName(fresh.groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))))
        now = (patterns.count(), known.count())
        if now == before or not now[0]:
            return patterns, known
        before = now


def apart(new: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of ``new`` that don't overlap a row of ``base`` of the same ``rid``: the spans of a row in order, from either side."""
    both = base.join(new.select("rid").distinct(), "rid", "left_semi").select("rid", "start", "end", "kind", F.lit(1).alias("is_base")).unionByName(new.select("rid", "start", "end", "kind", F.lit(0).alias("is_base")))
    so_far = lambda *order: Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of_base = lambda c: F.when(F.col("is_base") == 1, F.col(c))
    placed = both.withColumn("reach", F.max(of_base("end")).over(so_far("start", F.desc("is_base")))).withColumn("next", F.min(of_base("start")).over(so_far(F.desc("start"), F.desc("is_base"))))
    return placed.filter((F.col("is_base") == 0) & (F.coalesce("reach", "start") <= F.col("start")) & (F.coalesce("next", "end") >= F.col("end"))).select("rid", "start", "end", "kind")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tuning) -> DataFrame:
    """doc_id, th, base, added for every row: arrays of (kind number, start, end), each in order."""
    found = cut_lineage(finds(docs, id_col, text_col))
    patterns, known = bootstrap(found, **tuning)
    number = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c).cast("int")
    best = F.max_by("kind", F.struct("confidence", -number(F.col("kind")))).alias("kind")
    slots = found.filter("src = 'slot'").select("rid", "start", "end", "value", F.explode("patterns").alias("pattern"))
    seen = slots.join(patterns.select("pattern", "kind"), "pattern").join(known, ["value", "kind"]).filter("confidence < 1.0").groupBy("rid", "start", "end").agg(best)
    base = found.filter(F.col("src") != "slot").select("rid", "doc_id", "th", F.col("src").alias("kind"), "start", "end", F.lit(True).alias("is_base"))
    new = apart(seen, base)
    bare = found.filter("src is null").select("rid", "doc_id", "th", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(True).alias("is_base"))
    added = new.select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("th"), "kind", "start", "end", F.lit(False).alias("is_base"))
    every = reduce(DataFrame.unionByName, (base, bare, added))
    span = F.struct(number(F.col("kind")).alias("kind"), F.col("start").alias("start"), F.col("end").alias("end"))
    some = F.col("kind").isNotNull()
    rows = every.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("th").alias("th"), F.array_sort(F.collect_list(F.when(some & F.col("is_base"), span))).alias("base"), F.array_sort(F.collect_list(F.when(some & ~F.col("is_base"), span))).alias("added"))
    return rows.select("doc_id", "th", "base", "added")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"] - 1], s["start"], s["end"])), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base finds, base_sha256 and spans (kind:start:end by kind, then start) for every row."""
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i + 1)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", "added"))
    return personal_data(docs, id_col, text_col).select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind's mask; overlapping spans by the mask of the first."""
    spans = personal_data(docs, id_col, text_col).select("doc_id", "th", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans")).filter(F.size("spans") > 0)
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.any_value("spans").alias("_spans"))
    t, masks = F.col(text_col), F.array(*[F.lit(MASKS[k]) for k in KINDS])
    part = lambda a, b: F.substring(t, a.cast("int") + 1, (b - a).cast("int"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(F.struct(F.concat(acc["out"], part(acc["at"], s["start"]), masks[s["kind"] - 1]).alias("out"), s["end"].alias("at")))
    new = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.length(t).cast("long"))))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col("_th")), "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), t).otherwise(new)).drop("_id", "_th", "_spans")
