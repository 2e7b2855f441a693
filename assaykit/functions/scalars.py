"""Column helpers for arithmetic, text and sets, where Spark's own functions differ from what assessments need."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of a text, as a Java regular expression.
ENDS = "^[\\s\\u00A0\\uFEFF]+|[\\s\\u00A0\\uFEFF]+$"
#: Everything that ends a line in a text (fixed value).
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Words that say nothing about what a question is about (fixed values).
STOP_WORDS = "a an and are be do does for how in is it its of on or our should the to we what when which who with".split()


def ascii_words(pattern: str) -> str:
    """A pattern whose \\b knows ASCII letters, digits and _ only, as \\w does; Java's own counts é as part of a word too."""
    parts, out = re.findall(r"\\.|.", pattern, re.S), []
    for i, part in enumerate(parts):
        after, before = "".join(parts[i + 1 : i + 2]), parts[i - 1] if i else ""
        plain = re.compile("[A-Za-z0-9_]")
        edge = r"(?<!\w)" if plain.fullmatch(after) else r"(?!\w)" if plain.fullmatch(before) else r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        out.append(edge if part == r"\b" else part)
    return "".join(out)


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, ties towards plus infinity, on the binary value."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, ENDS, "")


def has_text(x: Column) -> Column:
    """Whether x is neither null nor blank; never null."""
    return F.coalesce(F.length(stripped(x)) > 0, F.lit(False))


def slug(x: Column) -> Column:
    """Lower case, each run of other characters a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def or_else(x: Column, default: Column) -> Column:
    """default where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default)


def choice(x: Column, values: Mapping[str, object], default: object = None) -> Column:
    """The value of x in a small fixed table."""
    out = None
    for key, value in values.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default))


def position_in(x: Column, order: Sequence[str]) -> Column:
    """Where x is in an ordered domain, from 1; 0 if it isn't."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), x)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def token_set(x: Column) -> Column:
    """Distinct lower-case alphanumeric words without stop words, sorted."""
    # array_except makes distinct too, in a hash set
    return F.sort_array(F.array_except(F.split(F.lower(x), "[^a-z0-9]+"), F.array(F.lit(""), *map(F.lit, STOP_WORDS))))


def set_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard similarity and containment of two sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.greatest(both / either, both / smaller)).otherwise(F.lit(0.0))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once a row however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def lines_of(x: Column) -> Column:
    """The lines of a text; an end of line at its end starts no further one, and an empty text has none."""
    return bound(F.split(x, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def canonical_map(x: Column) -> Column:
    """JSON of a map with its keys in order, the same for equal maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))


def script_safe(x: Column) -> Column:
    """JSON that may stand inside a script element."""
    for plain, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def html_safe(x: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x
