"""Response text: think blocks, answers, options, and the JSON snippet of a free-form answer."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_think(text: Column) -> Column:
    """struct<text, think_only>: closed think blocks go; an open one without an end makes the response invalid."""
    opened, closed = text.contains("<think>"), text.contains("</think>")
    rest = F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))
    return F.struct(F.when(opened & closed, rest).when(opened, "").otherwise(text).alias("text"), (opened & ~closed).alias("think_only"))


def remove_think(text: Column) -> Column:
    """The other rule: all up to the first closing tag goes; then the content of an answer tag, if there is one."""
    rest = F.regexp_replace(F.regexp_replace(text, "(?s)^.*?</think>", ""), "(?s)^.*?</thought>", "")
    return F.trim(F.when(rest.rlike("(?is)<answer>.*?</answer>"), F.regexp_extract(rest, "(?is)<answer>(.*?)</answer>", 1)).otherwise(rest))


def unfence(text: Column) -> Column:
    """The content of a text that is one fenced block, else the text."""
    return F.when(text.rlike(r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"), F.regexp_extract(text, r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$", 1)).otherwise(text)


# What is replaced, in this order, and the signs before which a blank goes.
DETOKENIZED = ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"'))
CLOSING = "'.,"


def detokenize(text: Column) -> Column:
    """Undoes spaces before punctuation and contractions."""
    for a, b in DETOKENIZED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, f" ([{CLOSING}])", "$1")


def sanitize(name: Column) -> Column:
    return F.regexp_replace(name, r'["<>:/|\\?*\[\]]+', "__")


def regex_extract(responses: Column, pattern: str, group: int = 0, fallback: str = "[invalid]") -> Column:
    """Of each response the k-th match (from the end if negative), trimmed; without any match the fallback.

    Of a pattern with groups, a match stands for its first group that isn't empty (empty, if all are). Without a k-th
    match the result is null.
    """
    many = re.compile(pattern).groups
    found = lambda r, g: F.regexp_extract_all(r, F.lit(pattern), F.lit(g))
    which = F.lit(group + 1 if group >= 0 else group)

    def one(r):
        picks = [F.try_element_at(found(r, g), which) for g in range(1, many + 1)] if many else [F.try_element_at(found(r, 0), which)]
        first = F.coalesce(*[F.nullif(x, F.lit("")) for x in picks], picks[0])
        return F.when(F.size(found(r, 0)) == 0, F.lit(fallback)).otherwise(F.trim(first))

    return F.transform(responses, one)


def drop_one_space(responses: Column) -> Column:
    return F.transform(responses, lambda r: F.when(r.startswith(" "), r.substr(F.lit(2), F.length(r))).otherwise(r))


def map_values(responses: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(responses, lambda r: F.coalesce(F.try_element_at(table, r), F.lit(default)))


def majority(responses: Column) -> Column:
    """The most frequent value; of ties the one seen first."""
    score = lambda v: F.struct(F.size(F.filter(responses, lambda r: r == v)).alias("n"), (-F.array_position(responses, v)).alias("p"), v.alias("v"))
    return F.array_max(F.transform(F.array_distinct(responses), score))["v"]


def exact_match(pred: Column, gold: Column, ignore_case: bool = False, ignore_punctuation: bool = False, ignore_numbers: bool = False, drop: tuple[str, ...] = ()) -> Column:
    """1.0 if equal after the same clean-up on both sides."""
    def clean(x):
        for p in drop:
            x = F.regexp_replace(x, p, "")
        if ignore_case:
            x = F.lower(x)
        if ignore_punctuation:
            x = F.translate(x, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
        return F.translate(x, "0123456789", "") if ignore_numbers else x

    return (clean(pred) == clean(gold)).cast("double")


def anls(pred: Column, refs: Column, threshold: float = 0.5) -> Column:
    """Least normalised edit distance to a reference as a similarity, 0 beyond the threshold.

    Distances compare trimmed lower-case text with white space as single blanks; lengths are those of the raw text.
    """
    clean = lambda x: F.lower(F.array_join(F.filter(F.split(x, r"\s+"), lambda w: w != ""), " "))

    def one(r):
        longest = F.greatest(F.char_length(r), F.char_length(pred))
        return F.when(longest == 0, 0.0).otherwise(F.levenshtein(clean(r), clean(pred)) / longest)

    best = F.array_min(F.transform(refs, one))
    return F.when(best < threshold, 1.0 - best).otherwise(0.0)


# Ways in which answers name an option; the first that matches counts.
OPTION_PATTERNS = [
    r"Final answer\s*[:：]?\s*([A-Z])\b",
    r"Answer\s+is\s*[:：]?\s*([A-Z])\b",
    r"The correct option is\s*([A-Z])\b",
    r"So the answer is\s*([A-Z])\b",
    r"Option\s*([A-Z])\b",
    r"^\s*([A-Z])\s*[:\-]",
    r"^\s*([A-Z])\s*$",
    r"=>\s*([A-Z])\b",
    r"\(([A-Z])\)",
    r"\[([A-Z])\]",
]


def option(text: Column) -> Column:
    """The option letter that a free text names, or null."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?im){p}", 1), F.lit("")) for p in OPTION_PATTERNS]))


_BRACE = re.compile("[{}]")


@F.pandas_udf(T.StringType())
def last_boxed(text: pd.Series) -> pd.Series:
    r"""The last ``\boxed{...}`` (``\fbox{...}`` if there is none) with its braces matched; null if there is neither."""
    def one(s):
        at = s.rfind("\\boxed")
        at = s.rfind("\\fbox") if at < 0 else at
        depth = 0
        for m in _BRACE.finditer(s, at) if at >= 0 else ():
            depth += 1 if m[0] == "{" else -1
            if m[0] == "}" and depth == 0:
                return s[at : m.end()]
        return None

    return text.map(one, na_action="ignore")


FEW = 64  # pages that are Python texts at once


@F.arrow_udf(T.StringType())
def visible_text(html: pa.Array) -> pa.Array:
    """Visible text of a page: stripped strings, one a line, without scripts and styles.

    Pages are long: a few of a batch at a time are Python texts, the others stay in the batch's buffers.
    """
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "template")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "template") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.parts.append(data.strip())

    def one(s):
        r = Reader()
        r.feed(s)
        r.close()
        return "\n".join(r.parts)

    few = lambda at: [None if s is None else one(s) for s in html[at : at + FEW].to_pylist()]
    return pa.chunked_array([pa.array(few(at), pa.string()) for at in range(0, len(html), FEW)], pa.string()).combine_chunks()
