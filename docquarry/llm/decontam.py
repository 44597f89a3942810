"""Benchmark decontamination by template windows, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, let, may_match

#: Tokens of a template window, and how many of them are literal words at least; with fewer, its values count too.
WINDOW, LITERALS = 8, 4
#: Share of an item's windows that a document must hold, with consistent slots.
COVERAGE = 0.4
#: English and international units of measure, as they stand after a number; other languages' unit words are literals.
UNITS = "km|m|cm|mm|mi|miles|mile|ft|feet|inch|inches|kg|g|mg|lb|lbs|oz|tons|t|l|ml|liters|litres|s|sec|seconds|second|min|minutes|minute|h|hours|hour|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|eur|usd|pounds|cents|percent|mph|kmh|hz|kw|w|v|gb|mb|kb"

_NAME, _UNIT, _NUMBER = "\u0001", "\u0002", "\u0003"
_DIGITS = r"\p{N}+(?:[.,]\p{N}+)*"
_TOKEN = r"[\p{L}\p{M}]+|" + _DIGITS


def tokens_of(text: F.Column) -> F.Column:
    """The lower-cased words and numbers of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def kinds_of(text: F.Column, names: bool) -> F.Column:
    """The text's template, token by token: a placeholder for a number, a unit after a number or a name (a capitalised word), or the token."""
    marks = _NAME + _UNIT + _NUMBER
    text = F.when(text.contains(_NAME) | text.contains(_UNIT) | text.contains(_NUMBER), F.translate(text, marks, "   ")).otherwise(text)
    named = F.regexp_replace(text, r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}+(?![\p{L}\p{M}])", _NAME) if names else text
    units = F.regexp_replace(named, rf"(?i)(?<=\p{{N}}\s?)({UNITS})(?![\p{{L}}\p{{M}}])", _UNIT)
    form = F.when(text.rlike(r"\p{N}"), F.regexp_replace(units, _DIGITS, _NUMBER)).otherwise(named)
    return F.regexp_extract_all(F.lower(form), F.lit(rf"[{marks}]|{_TOKEN}"), F.lit(0))


def template_windows(rows: DataFrame, names: bool = True, widths: Sequence[int] = (WINDOW,)) -> DataFrame:
    """Every window of each of ``widths`` (1 to ``WINDOW``) tokens of ``rows.text``'s templates, beside the rows' other columns.

    Adds ``at`` (from 1), ``width``, ``hash``, ``dense``, ``n`` (tokens of the whole text) and ``w``: the tokens of this window, ``t0``, ``t1``,
    ..., and whether each is a placeholder, ``o0``, ..., from which ``slots_at`` takes its values.  No row holds more of the text than its
    window.  A window with placeholders and fewer than ``LITERALS`` literal words has no template: it is ``dense`` and hashed with its values.
    Null, empty and shorter texts give no window.
    """
    others = [c for c in rows.columns if c != "text"]
    split = rows.where("text is not null").select(*others, tokens_of(F.col("text")).alias("tokens"), kinds_of(F.col("text"), names).alias("kinds"))
    split = split.where(F.size("tokens") >= min(widths))
    opens = F.transform("kinds", lambda k: (k < F.lit("\u0004")).cast("int"))
    hashed = split.select(*others, "tokens", F.transform("kinds", lambda k: F.xxhash64(k)).alias("h"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("v"), opens.alias("o"))
    both, most = (lambda a, b: F.xxhash64(a, b)), max(widths)
    wide = hashed.withColumn("width", F.explode(F.array(*[F.lit(x) for x in widths])) if len(widths) > 1 else F.lit(most))
    of_width = lambda c, join: reduce(lambda rest, x: rest.when(F.col("width") == x, _joined(F.col(c), x, join)), widths, F)
    runs = wide.select(*others, "width", "tokens", "o", of_width("h", both).alias("template"), of_width("v", both).alias("value"), of_width("o", lambda a, b: a + b).alias("open"))
    beside = F.arrays_zip("template", "value", "open", *[_from(F.col(c), j).alias(f"{c[0]}{j}") for c in ("tokens", "o") for j in range(most)])
    spread = runs.select(*others, "width", F.size("tokens").alias("n"), F.posexplode(beside).alias("before", "w")).where("before + width <= n")
    dense = (F.col("w.open") > 0) & (F.col("width") - F.col("w.open") < LITERALS)
    return spread.select(*others, "n", "w", (F.col("before") + 1).alias("at"), "width", F.when(dense, F.xxhash64(F.lit("values"), "w.value")).otherwise(F.col("w.template")).alias("hash"), dense.alias("dense"))


def _from(array: F.Column, j: int) -> F.Column:
    """The array without its first ``j`` elements."""
    return F.slice(array, j + 1, F.greatest(F.lit(0), F.size(array) - j)) if j else array


def _joined(array: F.Column, width: int, join) -> F.Column:
    """For each place of the array what ``join`` makes of ``width`` elements from there on, by doubling: runs of 2, of 4, of 8.

    Each token costs a few steps, not ``width``.  The last ``width - 1`` places have no meaning.
    """

    def grown(run: F.Column, length: int) -> F.Column:
        if 2 * length <= width:
            return let(F.zip_with(run, _from(run, length), join), lambda r: grown(r, 2 * length))
        rest = width - length
        return F.zip_with(run, _from(_joined(array, rest, join), length), join) if rest else run

    return grown(array, 1)


def slots_at(most: int) -> F.Column:
    """The values of a window's placeholders, empty for literal words, joined by U+0003; null for a window without template or without any."""
    values = F.concat_ws("\u0003", *[F.when(F.col("width") > j, F.when(F.col(f"w.o{j}") == 1, F.col(f"w.t{j}")).otherwise("")) for j in range(most)])
    return F.when(~F.col("dense") & (F.col("w.open") > 0), values)


def _differs(pair: F.Column) -> F.Column:
    return pair["item"] != pair["doc"]


def _consistent(found: F.Column) -> F.Column:
    """``(pos, dense)`` of a diagonal's windows ``(pos, dense, pairs)`` that have no slot, are word for word, or fill each slot with its value's choice.

    An item value's choice is the document value that most slots of the windows have for it, then its own, then the greatest.
    """

    def judged(pairs: F.Column) -> F.Column:
        votes = F.transform(F.array_distinct(pairs), lambda p: F.struct(F.size(F.filter(pairs, lambda q: q == p)).alias("votes"), (~_differs(p)).alias("same"), p["doc"].alias("doc"), p["item"].alias("item")))
        best = let(votes, lambda v: F.filter(v, lambda x: ~F.exists(v, lambda y: (y["item"] == x["item"]) & (y > x))))
        fits = lambda w, chosen: F.forall(w["pairs"], lambda p: F.exists(chosen, lambda x: (x["item"] == p["item"]) & (x["doc"] == p["doc"])))
        return let(best, lambda chosen: F.filter(found, lambda w: F.forall(w["pairs"], lambda p: ~_differs(p)) | fits(w, chosen)))

    distinct = lambda pairs, of: F.size(F.array_distinct(F.transform(pairs, of)))
    kept = let(F.flatten(F.transform(found, lambda w: w["pairs"])), lambda pairs: F.when(distinct(pairs, lambda p: p["item"]) == distinct(pairs, lambda p: p), found).otherwise(judged(pairs)))
    return F.array_distinct(F.transform(kept, lambda w: F.struct(w["pos"].alias("pos"), w["dense"].alias("dense"))))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, word for word or with other numbers, names and units.

    Returns ``doc_id, item_id, windows, item_windows, coverage, reworded``, one row per pair; documents without a leak have none.

    Texts become templates: lower-cased words, with numbers, units after numbers and capitalised words, also at the start of a sentence,
    replaced by typed placeholders.  Windows of 8 template tokens are hashed in place and joined with the benchmark's; the benchmark also
    enters with names as words, for texts whose case is lost.  On one diagonal (the same offset between document and item) each value of
    the item stands for one value of the document, the one that most of its slots have; windows with another value in a slot don't count,
    unless they are the item's word for word.  Two values of the item may stand for the same one.  A pair counts from ``coverage`` of the
    item's windows, or of those with a template; ``reworded`` tells that some slot has another value than in the item.

    An item of fewer than 8 tokens is one window.  A window with fewer than 4 literal words matches on its values, word for word.
    A literal word that is changed breaks all windows over it: an item of 8 to 15 tokens may keep none.  Numbers written as words, names in
    capitals throughout or in scripts without capitals, and unit words of other languages than English are literals.

    Texts are read once, and a filter of fixed size keeps the windows that the benchmark may have.  A document that holds enough of an item
    holds one of the item's windows that fewest items share, so pairs start from those: a window that many items share makes no pairs.  A
    pair then asks for its item's windows among its document's; no step has all of a document's windows beside all of its items.

    An item id with several texts is found by each of them alone; the row is that of the best covered.  Null ids are dropped; null and empty
    texts have no window.  Repeated rows count as one document.  Other columns are not read.  Empty tables give an empty result.
    """
    spark, spent = docs.sparkSession, []
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    # Numbers from 1 to 8, whatever the benchmark's size.
    lengths = items.select(F.least(F.size(tokens_of(F.col("text"))), F.lit(WINDOW)).alias("n")).where("n > 0").distinct()
    widths = sorted({WINDOW, *(r["n"] for r in lengths.collect())})
    of_form = lambda names: template_windows(items.select("item_id", F.xxhash64("text").alias("form"), "text"), names, widths).where(F.col("width") == F.least(F.col("n"), F.lit(WINDOW)))
    forms = [of_form(names).select("item_id", "form", F.col("at").alias("pos"), "width", "hash", slots_at(WINDOW).alias("item_slots"), "dense") for names in (True, False)]
    # A text with and without its names shares the windows that have none.
    known = cut(forms[0].unionByName(forms[1]).groupBy("item_id", "form", "pos", "width", "hash").agg(F.max("item_slots").alias("item_slots"), F.min("dense").alias("dense")), spent)
    sizes = known.groupBy("item_id", "form").agg(F.countDistinct("pos").alias("all_of"), F.countDistinct(F.when(~F.col("dense"), F.col("pos"))).alias("open_of"))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    met = may_match(template_windows(rows, True, widths), known, "hash")
    hits = cut(met.select("doc_id", "at", "width", "hash", slots_at(WINDOW).alias("slots")), spent)

    shared = known.groupBy("width", "hash").agg(F.countDistinct("item_id", "form").alias("df"))
    places = known.join(shared, ["width", "hash"]).groupBy("item_id", "form", "pos").agg(F.max("df").alias("df"), F.min("dense").alias("dense"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("item_id", "form", *by).orderBy("df", "pos"))
    first = lambda n: n - F.ceil(F.lit(coverage) * n) + 1
    ranked = places.withColumns({"rank": rank(), "open_rank": rank("dense")}).join(sizes, ["item_id", "form"])
    leading = ranked.where((F.col("rank") <= first(F.col("all_of"))) | ~F.col("dense") & (F.col("open_rank") <= first(F.col("open_of")))).select("item_id", "form", "pos")
    leads = cut(known.join(leading, ["item_id", "form", "pos"]).select("item_id", "form", "width", "hash").distinct(), spent)
    pairs = cut(hits.join(leads, ["width", "hash"]).select("doc_id", "item_id", "form").distinct(), spent)

    # Each pair asks for its item's windows, and the keys spread a document's windows over the tasks.
    found = hits.join(pairs.join(known, ["item_id", "form"]), ["doc_id", "width", "hash"]).select("doc_id", "item_id", "form", "pos", (F.col("at") - F.col("pos")).alias("diagonal"), "slots", "item_slots", "dense")
    split = lambda c: F.split(F.coalesce(c, F.lit("")), "\u0003")
    values = F.filter(F.arrays_zip(split("item_slots").alias("item"), split("slots").alias("doc")), lambda p: F.coalesce(p["item"], F.lit("")) != "")
    found = found.withColumn("pairs", F.when(F.col("item_slots").isNull(), F.lit(None)).otherwise(F.transform(values, lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc")))))
    lines = found.groupBy("doc_id", "item_id", "form", "diagonal").agg(F.collect_set(F.struct("pos", "dense", F.coalesce("pairs", F.array().cast("array<struct<item:string,doc:string>>")).alias("pairs"))).alias("found"))
    lines = lines.select("doc_id", "item_id", "form", F.explode(_consistent(F.col("found"))).alias("window"), F.exists("found", lambda w: F.exists(w["pairs"], _differs)).alias("reworded"))
    each = lines.groupBy("doc_id", "item_id", "form", F.col("window.pos").alias("pos")).agg(F.min("window.dense").alias("dense"), F.bool_or("reworded").alias("reworded"))
    held = each.groupBy("doc_id", "item_id", "form").agg(F.count("*").alias("n"), F.count_if(~F.col("dense")).alias("open_n"), F.bool_or("reworded").alias("reworded"))
    share = lambda n, of: F.struct(F.coalesce(F.round(F.try_divide(n, of), 6), F.lit(0.0)).alias("coverage"), (~F.col("reworded")).alias("verbatim"), n.alias("windows"), of.alias("item_windows"))
    # Windows that match on values only must not lessen the share of those that also match reworded.
    best = F.greatest(share(F.col("n"), F.col("all_of")), share(F.col("open_n"), F.col("open_of")))
    out = held.join(sizes, ["item_id", "form"]).groupBy("doc_id", "item_id").agg(F.max(best).alias("best")).where(F.col("best.coverage") >= coverage)
    out = cut(out.select("doc_id", "item_id", "best.windows", "best.item_windows", "best.coverage", (~F.col("best.verbatim")).alias("reworded")))
    discard(spark, spent)
    return out
