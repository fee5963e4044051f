"""Row-local text functions: token sets, similarity, score parsing, clean-up, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .keys import BLANKS, strip
from .numbers import clamp01

# Word pattern of the TF-IDF tokens (two or more word characters),
# band limits of a score, length at which a context is cut.
TERM_CHARACTER = r"[\p{L}\p{N}_]"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
BAND_LIMITS = (0.33, 0.67)
CONTEXT_LIMIT = 4000
# Fragments of file names and the bank they stand for, first match first.
BANK_NAMES = [
    ("JP Morgan Chase", ("jpmorgan", "jp morgan")),
    ("Bank of America", ("bankofamerica", "bank of america")),
    ("Wells Fargo", ("wells",)),
    ("Citigroup", ("citi",)),
    ("Goldman Sachs", ("goldman",)),
    ("Morgan Stanley", ("morgan stanley",)),
]


def word_set(c: Column) -> Column:
    """Distinct lower-cased words, split on white space; missing text has no words."""
    words = F.split(F.lower(strip(F.coalesce(c, F.lit("")))), f"{BLANKS}+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def terms(c: Column) -> Column:
    """All lower-cased terms of two or more word characters, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Shared over combined size of two sets (arrays without repeats); 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_of_sets(word_set(a), word_set(b))


def simple_score(question: Column, answer: Column, contexts: Column | None = None,
                 truth: Column | None = None) -> Column:
    """Share of the answer's words found in the question, averaged in turn with the share
    found in the contexts (array of text) and in the ground truth; 0 for an empty answer."""
    a = word_set(answer)

    def share(words: Column) -> Column:
        return F.try_divide(F.size(F.array_intersect(a, words)).cast("double"), F.size(a))

    score = share(word_set(question))
    extra = []
    if contexts is not None:
        extra.append(word_set(F.array_join(contexts, " ")))
    if truth is not None:
        extra.append(word_set(truth))
    for words in extra:
        score = F.when(F.size(words) > 0, (score + share(words)) / 2).otherwise(score)
    return F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0))


def extract_score(c: Column) -> Column:
    """Last number in a reply, clamped to 0..1; 0.5 when there is none."""
    found = F.regexp_extract_all(c, F.lit(r"([0-9]+\.[0-9]+|[0-9]+)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1)).try_cast("double")
    return F.coalesce(clamp01(last), F.lit(0.5))


def score_band(c: Column) -> Column:
    low, high = BAND_LIMITS
    return F.when(c < low, "red").when(c < high, "yellow").otherwise("green")


def shorten(c: Column, limit: int = CONTEXT_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def numbered_text(title: Column, items: Column) -> Column:
    """Title line followed by the items numbered from 1, one per line."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(title, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))


def prefix(c: Column, n: int) -> Column:
    return F.substring(c.cast("string"), 1, n)


def clean_reply(c: Column) -> Column:
    """Turn escaped newlines into real ones, drop other backslashes, strip lines, drop empty lines."""
    text = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\"))
    lines = F.transform(F.split(text, r"\R"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def compact_lines(c: Column) -> Column:
    """Split at carriage returns, strip, drop blank lines, rejoin with newlines."""
    return F.array_join(F.filter(F.transform(F.split(c, "\r"), strip), lambda x: x != ""), "\n")


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace each ``$name$`` slot by the value of that name."""
    start = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda t, kv: F.replace(t, F.lit(f"${kv[0]}$"), kv[1]), values.items(), start)


def canonical_name(c: Column, patterns: list[tuple[str, tuple[str, ...]]] = BANK_NAMES, default: str = "Unknown") -> Column:
    """Name of the first entry one of whose fragments occurs in the text, ignoring case."""
    text = F.lower(c)
    hits = [F.when(reduce(lambda a, b: a | b, [text.contains(p) for p in parts]), name) for name, parts in patterns]
    return F.coalesce(*hits, F.lit(default))
