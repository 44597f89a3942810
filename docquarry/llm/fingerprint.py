"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds, bucket_of, let

#: Samples of a fingerprint; the standard error of a similarity s is sqrt(s (1 - s) / SAMPLES).
SAMPLES = 48
#: Rows that stand side by side in one bucket, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 20_000


def _uniform(h: F.Column, shift: int, bits: int) -> F.Column:
    """``bits`` bits of a hash as a number strictly between 0 and 1."""
    part = F.shiftrightunsigned(h, shift) if shift else h
    return (part.bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def sample(term: str, weight: str, k: int) -> F.Column:
    """Logarithm of sample ``k``'s value for a term of positive weight; a document keeps the least over its terms.

    With r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of the term: t = floor(ln w / r + b), y = exp(r (t - b)),
    a = c / (y exp(r)).  Two documents keep the same value just when they keep the same term and t, which happens with
    the probability sum of least weights / sum of greatest weights.
    """
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(first, 44, 20) * _uniform(first, 24, 20))
    b = _uniform(first, 0, 24)
    c = -F.ln(_uniform(second, 32, 32) * _uniform(second, 0, 32))
    t = F.floor(F.ln(weight) / r + b).cast("double")
    return F.ln(c) - r * (t - b + 1.0)


def signatures(terms: DataFrame, keys: list[str], term: str = "term", weight: str = "weight", samples: int = SAMPLES) -> DataFrame:
    """One row for each key of a table of weighted terms: ``keys, signature array<int>``.

    Weights are positive numbers; a null term or a weight that is null or not positive gives no sample, and a key without
    other rows has a null signature.
    """
    usable = F.when(F.col(term).isNotNull() & (F.col(weight) > 0), F.col(weight).cast("double"))
    rows = terms.select(*keys, F.col(term).alias("_term"), usable.alias("_weight"))
    least = rows.groupBy(*keys).agg(*[F.min(sample("_term", "_weight", k)).alias(f"_s{k}") for k in range(samples)])
    values = F.array(*[F.xxhash64(f"_s{k}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for k in range(samples)])
    return least.select(*keys, F.when(F.col("_s0").isNotNull(), values).alias("signature"))


def word_counts(text: F.Column) -> F.Column:
    """Array of ``(term, weight)``: hashes of the lower-cased words with their counts, from sorted runs within the row."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(s: F.Column) -> F.Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        ends = lambda x: F.concat(F.slice(x, 2, F.size(x)), F.array(F.size(s) + 1))
        return let(starts, lambda x: F.zip_with(x, ends(x), lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (b - a).alias("weight"))))

    return let(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), lambda s: F.when(F.size(s) > 0, runs(s)))


def likeness(left: str, right: str) -> F.Column:
    """Share of equal samples: estimates the generalised Jaccard similarity.  1 for two empty documents, 0 if one is empty."""
    equal = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x)) / F.size(left)
    a, b = F.col(left).isNull(), F.col(right).isNull()
    return F.when(a & b, 1.0).when(a | b, 0.0).otherwise(equal)


def in_hex(signature: str) -> F.Column:
    """A signature as text; empty for a document without terms."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its end replaced by the next document's beginning).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  Terms are the
    lower-cased words with their counts as weights.  48 samples are few: a likeness has a standard error of up to 0.07.

    Rows are dealt into buckets by quantiles of the id (the driver holds two numbers for each), and each bucket also
    gets the first row of the next one, so that neighbours meet in one task.  This is the only shuffle: counts,
    samples and comparisons all keep the bucket in their key.

    A null text counts as empty; null ids come first; repeated ids are ordered by a hash of the text, and equal rows are
    each other's neighbours.  After the last row comes the first.  Other columns are not read.  An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    count = rows.count()
    buckets = rows.withColumn("bucket", bucket_of("doc_id", bounds(rows, "doc_id", min(MOST_BUCKETS, 1 + count // BUCKET_ROWS))))
    order = F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "tie")
    first = sorted((r["bucket"], r["low"]) for r in buckets.groupBy("bucket").agg(F.min(order).alias("low")).collect())
    before = {b: first[i - 1][0] for i, (b, _) in enumerate(first)}
    guests = docs.sparkSession.createDataFrame([(b, before[b], low["doc_id"], low["tie"], b == first[0][0]) for b, low in first], "bucket int, guest_of int, low_id long, low_tie long, wraps boolean")
    starts = buckets.join(F.broadcast(guests), "bucket").where(F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("tie") == F.col("low_tie")))
    starts = starts.select("doc_id", "text", "tie", F.col("guest_of").alias("bucket"), F.col("wraps").cast("int").alias("guest") + 1)
    starts = starts.toDF("doc_id", "text", "tie", "bucket", "guest").dropDuplicates(["bucket"])
    near = buckets.select("doc_id", "text", "tie", "bucket", F.lit(0).alias("guest")).unionByName(starts)

    line = Window.partitionBy("bucket").orderBy("guest", "doc_id", "tie")
    half = F.floor(F.length("text") / 2).cast("int")
    # The guest's own edited text belongs to the bucket where it is at home.
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next", 1, half))
    placed = near.withColumns({"pos": F.row_number().over(line), "next": F.lead("text").over(line)})
    placed = placed.select("bucket", "pos", "guest", "doc_id", "text", F.when(F.col("guest") == 0, edited).alias("edited"))

    # Everything of a row rides in one plan: its facts are part of the key, so that nothing is joined back.
    facts = ["bucket", "pos", "guest", "doc_id", "n_chars", "sha"]
    placed = placed.withColumns({"n_chars": F.length("text").cast("long"), "sha": F.unhex(F.sha2("edited", 256))})
    sides = F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("t")))
    texts = placed.select(*facts, F.inline(sides).alias("is_edited", "t"))
    counted = texts.select(*facts, "is_edited", F.inline_outer(word_counts(F.col("t"))).alias("term", "weight"))
    marked = signatures(counted, [*facts, "is_edited"])
    picked = {"own": ~F.col("is_edited"), "other": F.col("is_edited")}
    both = marked.groupBy(*facts).agg(*[F.first(F.when(side, F.col("signature")), ignorenulls=True).alias(c) for c, side in picked.items()])
    both = both.withColumn("edited_sha256", F.lower(F.hex("sha")))
    after = Window.partitionBy("bucket").orderBy("pos")
    both = both.withColumn("after", F.lead("own").over(after)).where("guest = 0")
    return both.select("doc_id", "n_chars", "edited_sha256", in_hex("own").alias("fingerprint"), in_hex("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "after").alias("near_next"))
