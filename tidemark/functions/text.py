"""Text, markup, hashing and key functions: Column in, Column out."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark import fixed_values as fv
from tidemark.functions.arrays import let, null_if_empty, one_of

# Unicode white space, as str.split() sees it.  Java's \s is ASCII only.
SPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)

_NODE = "\x01"  # stands between two text nodes
_PART = "\x02"  # stands between two fragments unescaped in one call
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<template\b[^>]*>.*?(?:</template\s*>|\z)"
)
_TAG = r"""<[/!?]?[a-zA-Z](?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+>"""

# The entities replaced inside the JVM; '&amp;' is last so that nothing is
# unescaped twice.  Any other entity is respelled first.
_COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&lsquo;", "‘"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&bull;", "•"), ("&hellip;", "…"),
    ("&amp;", "&"),
)
_NOT_COMMON = "(?!(?:" + "|".join(e[1:-1] for e, _ in _COMMON_ENTITIES) + ");)[#a-zA-Z]"
_OTHER_ENTITY = "&" + _NOT_COMMON
_OTHER_ENTITY_TWICE = "&(?:amp;)?" + _NOT_COMMON


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_ws(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "), F.lit(" "))


def fold(c: Column) -> Column:
    """Trimmed lower case, the form names and queue keys are compared in."""
    return strip(F.lower(c))


def match_key(c: Column) -> Column:
    """Comparison key of a skill spelling: only a-z, 0-9, + and # count."""
    return F.regexp_replace(F.lower(c), fv.MATCH_KEY_DROPPED, "")


def content_hash(title: Column, company: Column, location: Column, description: Column) -> Column:
    """SHA-256 over the four fields that make up 'the same content'."""
    parts = [title, company, F.coalesce(location, F.lit("")), description]
    return F.sha2(F.concat_ws("\x1f", *[F.lower(collapse_ws(p)) for p in parts]), 256)


def parse_ts(c: Column) -> Column:
    """ISO-8601 text to timestamp; anything else is NULL, never an error."""
    looks_iso = c.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ].*)")
    return F.when(looks_iso, c).try_cast("timestamp")


def epoch_ms_ts(c: Column) -> Column:
    """Epoch milliseconds to timestamp, NULL unless numeric."""
    return F.timestamp_micros((c.try_cast("decimal(20,3)") * 1000).cast("bigint"))


def strip_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def long_id(url: Column) -> Column:
    """The trailing 7+ digit id of a posting url."""
    return null_if_empty(F.regexp_extract(url, fv.LONG_ID_PATTERN, 1))


def cut(c: Column, max_chars: int) -> Column:
    """The first max_chars characters, for callers whose next step has a size limit."""
    return F.substring(c, 1, max_chars)


def slug_guesses(name: Column) -> Column:
    """Likely board tokens of a company name: words joined, then hyphenated."""
    # a legal form at the end, with a full stop behind it or not
    base = F.regexp_replace(fold(name), rf"(?U)\b(?:{one_of(fv.LEGAL_SUFFIXES)})\.?$", "")
    words = F.split(F.regexp_replace(strip(base), "[^a-z0-9 ]", ""), " ")

    def join(found: Column) -> Column:
        return F.array_distinct(F.array(F.array_join(found, ""), F.array_join(found, "-")))

    return let(
        F.filter(words, lambda w: w != ""),
        lambda found: F.when(F.size(found) > 0, join(found)).otherwise(
            F.array().cast("array<string>")
        ),
    )


# --- markup -----------------------------------------------------------------


def _respelling(unescape_first: bool):
    """A pandas UDF: every entity as its character, or as a common entity where
    markup needs one.

    Built from closures, so that it travels whole and executors need not have
    this package installed.
    """
    entity = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{0,31};?)")

    def respell(text: str) -> str:
        given = html.unescape(text) if unescape_first else text
        return entity.sub(lambda found: html.escape(html.unescape(found.group(0))), given)

    @F.pandas_udf(StringType())
    def respelled(texts: pd.Series) -> pd.Series:
        return texts.map(respell, na_action="ignore")

    return respelled


_respelled = _respelling(unescape_first=False)
_unescaped_respelled = _respelling(unescape_first=True)


def _usual_entities(c: Column, escaped: bool = False) -> Column:
    """c, unescaped once if it is escaped as a whole, with nothing but common entities.

    Only texts that hold another one are handed to Python, the rest travel as NULL.
    """
    if escaped:
        rare = _unescaped_respelled(F.when(c.rlike(_OTHER_ENTITY_TWICE), c))
        return F.coalesce(rare, _unescaped(c))
    return F.coalesce(_respelled(F.when(c.rlike(_OTHER_ENTITY), c)), c)


def _unescaped(c: Column) -> Column:
    out = c
    for entity, char in _COMMON_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), out).otherwise(c)


def unescape(c: Column) -> Column:
    """HTML entities to characters, once."""
    return let(_usual_entities(c), _unescaped)


def _marked(markup: Column) -> Column:
    """Tags and hidden parts replaced by node marks; entities untouched."""
    clean = F.translate(markup, _NODE + _PART, "")
    return F.regexp_replace(F.regexp_replace(clean, _HIDDEN, _NODE), _TAG, _NODE)


def _lines(marked: Column) -> Column:
    """The text between the marks: unescaped, trimmed, one node per line."""
    def joined(t: Column) -> Column:
        nodes = F.transform(F.split(_unescaped(t), _NODE), strip)
        return F.array_join(F.filter(nodes, lambda n: n != ""), "\n")

    return F.replace(let(marked, joined), F.lit("\xa0"), F.lit(" "))


def html_to_text(markup: Column, inline: bool = False, escaped: bool = False) -> Column:
    """The text nodes of markup, each trimmed, one per line; inline puts one space instead.

    escaped: the markup itself is entity-escaped (&lt;p&gt;) and is unescaped first.
    """
    given = _usual_entities(F.coalesce(markup, F.lit("")), escaped)
    text = let(given, lambda m: _lines(_marked(m)))
    return collapse_ws(text) if inline else text


def html_parts_to_text(parts: Column) -> Column:
    """html_to_text over an array of fragments, keeping the array."""
    given = _usual_entities(F.array_join(parts, _PART, ""))
    return F.transform(F.split(given, _PART), lambda p: _lines(_marked(p)))


def element_markup(markup: Column, tag: str, attribute_pattern: str = "") -> Column:
    """Inside of the first <tag …> whose attributes match; NULL if there is none.

    Nested elements of the same name are followed by depth; an element that is
    never closed runs to the end.
    """
    opening = rf"(?is)<{tag}(?=[\s>/])[^>]*>"
    if attribute_pattern:
        opening = rf"(?is)<{tag}(?=\s[^>]*{attribute_pattern})[^>]*>"

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.startswith("</"), -1).otherwise(1)
        closes = state["end"].isNull() & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            (state["at"] + 1).alias("at"),
            F.when(closes, state["at"]).otherwise(state["end"]).alias("end"),
        )

    outside = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end")
    )

    def to_closing(pieces: Column) -> Column:
        end = F.coalesce(F.aggregate(pieces, outside, step)["end"], F.size(pieces))
        return F.array_join(F.slice(pieces, F.lit(1), end), "")

    def from_opening(start: Column) -> Column:
        pieces = F.split(F.substr(markup, start), rf"(?i)(?=</?{tag}[\s>/])")
        inside = F.regexp_replace(let(pieces, to_closing), r"(?s)\A<[^>]*>", "")
        return F.when(start > 0, inside)

    return let(F.regexp_instr(markup, F.lit(opening)), from_opening)


def _class_pattern(name: str, how: str) -> str:
    value = rf"[^\"'>]*{name}[^\"'>]*"
    if how == "word":
        value = rf"(?:[^\"'>]*\s)?{name}(?:\s[^\"'>]*)?"
    return rf"\bclass\s*=\s*[\"']{value}[\"']"


def main_content(markup: Column, containers=fv.CONTENT_CONTAINERS, min_chars: int = fv.MIN_CONTENT_CHARS) -> Column:
    """Text of the first container that holds more than min_chars, else of the body, else ''.

    A container is (tag, class, 'word' or 'part'), or (tag, '', '') for any such tag.
    """
    def inside(clean: Column) -> Column:
        body = F.coalesce(
            element_markup(clean, "body"),
            F.regexp_replace(clean, r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
        )
        named = [
            element_markup(clean, tag, _class_pattern(name, how) if name else "")
            for tag, name, how in containers
        ]

        def long_text(found: Column) -> Column:
            return let(
                _lines(_marked(F.coalesce(found, F.lit("")))),
                lambda t: F.when(F.length(t) > min_chars, t),
            )

        # coalesce stops at the first container that is long enough
        return F.coalesce(*[long_text(c) for c in [*named, body]], F.lit(""))

    given = _usual_entities(F.coalesce(markup, F.lit("")))
    return let(F.regexp_replace(given, _HIDDEN, _NODE), inside)
