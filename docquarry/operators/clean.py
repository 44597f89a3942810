"""Text cleaning: each step is a ``Column -> Column`` function, ``clean_text`` runs them in order."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What UTF-8 read as another code page looks like and what it stood for, Markdown marks, phones, addresses.
MOJIBAKE = (
    ("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ('â€"', "–"), ("Â", ""), ("â\x80\x99", "'"), ("â\x80\x9c", '"'), ("â\x80\x9d", '"'),
)
MARKDOWN = (
    (r"(?m)^#+\s*", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"__(.+?)__", "$1"), (r"_(.+?)_", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"(?s)```[^`]*```", ""), (r"`([^`]+)`", "$1"),
)
PHONES = (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\(\d{3}\)\s?\d{3}[-.]?\d{4}\b", r"\b\d{3}\s\d{3}\s\d{4}\b", r"\+\d{1,3}[-.\s]?\d{1,14}\b")
_ADDRESS = r"[^\s<>\"{}|\\^`\[\]]"
DOMAINS = r"\.(?:com|org|net|edu|gov|mil|int|co\.uk|de|fr|it|es|ru|jp|cn)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CONTRACTIONS = (("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"))
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}]"


def fix_mojibake(c: Column) -> Column:
    for bad, good in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_entities(c: Column) -> Column:
    """Character references; texts without an ampersand stay in the JVM's value."""
    return F.when(c.contains("&"), _unescape(c)).otherwise(c)


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")


def strip_xml(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def strip_markdown(c: Column) -> Column:
    for pattern, to in MARKDOWN:
        c = F.regexp_replace(c, "(?d)" + pattern, to)  # lines end at a newline only
    return c


def remove_urls(c: Column) -> Column:
    """Addresses with a scheme, with ``www.``, and bare domains.  A bare domain is looked for only where a run of its characters begins, so long runs cost no more."""
    return F.regexp_replace(c, rf"(?i)https?://{_ADDRESS}+|www\.{_ADDRESS}+|(?<!{_ADDRESS}){_ADDRESS}+{DOMAINS}{_ADDRESS}*", "")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "")


def remove_phones(c: Column) -> Column:
    for pattern in PHONES:
        c = F.regexp_replace(c, pattern, "")
    return c


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form; texts of ASCII alone are not sent to Python."""

    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.when(c.rlike(r"[^\x00-\x7F]"), normal(c)).otherwise(c)


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "“”„‘’‚", "\"\"\"'''")


def plain_dashes(c: Column) -> Column:
    return F.translate(F.replace(F.replace(c, F.lit("—"), F.lit("--")), F.lit("―"), F.lit("--")), "–−‒", "---")


def tabs_to_spaces(c: Column) -> Column:
    return F.replace(c, F.lit("\t"), F.lit(" "))


def expand_tabs(c: Column, width: int = 4) -> Column:
    """Tabs to the next column that is a multiple of ``width``."""

    @F.pandas_udf(T.StringType())
    def expanded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.expandtabs(width), na_action="ignore")

    return F.when(c.contains("\t"), expanded(c)).otherwise(c)


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, " +", " "), r"[\t\f\x0B]+", " ")


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def strip_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def drop_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, "[​‌‍﻿]", "")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def calm_punctuation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.{4,}", "..."), "!{2,}", "!")


@F.pandas_udf(T.StringType())
def _title(s: pd.Series) -> pd.Series:
    return s.map(str.title, na_action="ignore")


def change_case(c: Column, case: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": _title}[case](c)


def drop_short_lines(c: Column, least: int) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: F.length(x) >= least), "\n")


def wrap_lines(c: Column, most: int) -> Column:
    """Lines broken at spaces so that none is longer than ``most``, unless a single word is."""

    def wrapped(line: Column) -> Column:
        fits = lambda acc, w: F.length(acc["line"]) + 1 + F.length(w) <= most
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
        step = lambda acc, w: F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line"))).when(fits(acc, w), F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), w).alias("line"))).otherwise(F.struct(F.concat(acc["done"], acc["line"], F.lit("\n")).alias("done"), w.alias("line")))
        return F.aggregate(F.split(line, " "), start, step, lambda acc: F.concat(acc["done"], acc["line"]))

    return F.array_join(F.transform(F.split(c, "\n"), lambda line: F.when(F.length(line) <= most, line).otherwise(wrapped(line))), "\n")


def join_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"([\p{L}\p{N}_]+)-[ \t\r\f]*\n\s*([\p{L}\p{N}_]+)", "$1$2")


@dataclass(frozen=True)
class Rule:
    """A custom rule; rules run by descending priority."""

    name: str
    pattern: str
    replacement: str = ""
    priority: int = 0
    enabled: bool = True


def apply_rules(c: Column, rules: list[Rule]) -> Column:
    for rule in sorted((r for r in rules if r.enabled), key=lambda r: -r.priority):
        c = F.regexp_replace(c, rule.pattern, rule.replacement)
    return c


#: Steps in their order: name, function, on by default.
STEPS: list[tuple[str, Callable[[Column], Column], bool]] = [
    ("encoding", fix_mojibake, True), ("html_entities", unescape_entities, True), ("html_tags", strip_html, True), ("xml_tags", strip_xml, False), ("markdown", strip_markdown, False),
    ("urls", remove_urls, False), ("emails", remove_emails, False), ("phones", remove_phones, False), ("zero_width", drop_zero_width, True), ("line_ends", unix_newlines, True), ("unicode", normalize_unicode, True), ("quotes", plain_quotes, True), ("dashes", plain_dashes, True),
    ("tabs", tabs_to_spaces, True), ("whitespace", squeeze_spaces, True), ("newlines", squeeze_newlines, True), ("hyphenation", join_hyphenated, False), ("ends", strip_ends, True),
]


def text_stats(before: Column, after: Column) -> Column:
    """Characters, lines and words before and after, and how much was removed."""
    chars = lambda c: F.length(c)
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    removed = chars(before) - chars(after)
    return F.struct(
        chars(before).alias("chars_before"), chars(after).alias("chars_after"), lines(before).alias("lines_before"), lines(after).alias("lines_after"), words(before).alias("words_before"), words(after).alias("words_after"),
        removed.alias("removed"), F.round(F.when(chars(before) > 0, 100.0 * removed / chars(before)).otherwise(0.0), 4).alias("removed_percent"),
    )


def clean_text(rows: DataFrame, column: str, enabled: dict[str, bool] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``cleaned``, ``rules_applied`` (steps that changed the text) and ``stats``.  Null or blank text stays as it is, with a warning."""
    on = {name: default for name, _, default in STEPS} | (enabled or {})
    steps = [(name, f) for name, f, _ in STEPS if on[name]] + ([("custom", lambda c: apply_rules(c, rules))] if rules else [])
    out, last = rows, column
    for i, (_, f) in enumerate(steps):
        out = out.withColumn(f"_c{i}", f(F.col(last)))
        last = f"_c{i}"
    blank = F.col(column).isNull() | (F.trim(column) == "")
    changed = F.filter(F.array(*[F.when(F.col(column if i == 0 else f"_c{i - 1}") != F.col(f"_c{i}"), F.lit(name)) for i, (name, _) in enumerate(steps)]), lambda x: x.isNotNull())
    out = out.withColumns({"cleaned": F.when(blank, F.col(column)).otherwise(F.col(last)), "rules_applied": F.when(blank, F.array().cast("array<string>")).otherwise(changed), "warning": F.when(blank, "blank text")})
    out = out.withColumn("stats", text_stats(F.col(column), F.col("cleaned")))
    return out.drop(*[f"_c{i}" for i in range(len(steps))])


def validate_text(c: Column) -> Column:
    """Problems of a text, as an array of names."""
    scripts = [F.when(c.rlike(rf"\p{{Is{s}}}"), 1).otherwise(0) for s in ("Latin", "Cyrillic", "Greek", "Han", "Hangul", "Hiragana", "Arabic", "Hebrew")]
    many = sum(scripts[1:], scripts[0]) > 3
    checks = {"replacement_character": c.contains("�"), "long_whitespace": c.rlike(r"\s{10,}"), "control_characters": c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "many_scripts": many}
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())


def clean_episode(c: Column) -> Column:
    c = F.regexp_replace(strip_ends(c), r"[ \t]+", " ")
    return squeeze_newlines(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def clean_query(c: Column) -> Column:
    c = F.lower(strip_ends(squeeze_spaces(c)))
    for short, long in CONTRACTIONS:
        c = F.replace(c, F.lit(short), F.lit(long))
    return F.trim(F.regexp_replace(F.regexp_replace(c, EMOJI, ""), r"\s+", " "))


def clean_queries(rows: DataFrame, column: str, enabled: dict[str, bool] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``cleaned``: the query after all steps that ``clean_text`` runs, lower-cased, contractions written out, without emoji, its words one space apart.

    A null or blank query becomes null or empty.
    """
    out = clean_text(rows, column, enabled, rules).drop("rules_applied", "warning", "stats")
    return out.withColumn("cleaned", clean_query(F.col("cleaned")))
