"""Nested fixtures: indented maps and lists of a small YAML as VARIANTs.

A text's lines are folded over a stack of open containers by their indentation into one tree. Taken are block maps and lists of any
depth, list entries that begin a map or list, flow lists and maps on one line, quoted and plain scalars, literal and folded
blocks, and comments. Anchors, tags, several documents and flow over lines aren't: such a text is an error row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"\[\]{},#&*!|>%@`-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?:\s+|$)""")
NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)(\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$")
FLAT = re.compile(r"""\[[^\[\]{}"']*\]$""")
BLOCK = re.compile(r"[|>][-+]?")
#: Texts of up to so many characters whose reading a task remembers, and how many of them: keys and values come again and again.
SHORT, REMEMBERED = 256, 4096
WORDS = {"": None, "~": None, "null": None, "true": True, "false": False}


class Unreadable(ValueError):
    pass


def remembered(f: Callable[[str], Any]) -> Callable[[str], Any]:
    """f with its values for short texts kept; they must not be changed."""
    kept = lru_cache(REMEMBERED)(f)
    return lambda text: kept(text) if len(text) <= SHORT else f(text)


def uncommented(text: str) -> str:
    """A line's text without a comment, which begins at # at the start or behind white space, outside quotes."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            if c == quote and not (quote == '"' and text[i - 1] == "\\"):
                quote = ""
        elif c in "\"'" and (i == 0 or text[i - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


def scalar(text: str) -> Any:
    """A plain, quoted or flow value."""
    if text[:1] in ("[", "{"):
        if FLAT.match(text):
            return list(flat(text))
        value, rest = flow(text)
        if rest.strip():
            raise Unreadable(f"text behind a flow value: {rest}")
        return value
    return single(text)


@remembered
def single(text: str) -> Any:
    """A plain or quoted value."""
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise Unreadable("a quote isn't closed")
        return text[1:-1].replace("''", "'")
    if text[:1] in ("&", "*", "!", "|", ">", "%", "@", "`"):
        raise Unreadable(f"not taken: {text}")
    if text.lower() in WORDS:
        return WORDS[text.lower()]
    if m := NUMBER.match(text):
        return float(text) if m[1] or "e" in text.lower() else int(text)
    return text


@remembered
def flat(text: str) -> tuple:
    """The values of a flow list without quotes and further lists or maps."""
    parts = [x.strip() for x in text[1:-1].split(",")]
    return tuple(single(x) for x in (parts if parts[-1] else parts[:-1]))


def flow(text: str) -> tuple[Any, str]:
    """The flow value at the start of a text, and what follows it."""
    text = text.lstrip()
    if text[:1] in ("[", "{"):
        end, out = {"[": "]", "{": "}"}[text[0]], [] if text[0] == "[" else {}
        text = text[1:].lstrip()
        while not text.startswith(end):
            if not text:
                raise Unreadable("a flow value isn't closed")
            if isinstance(out, dict):
                m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^:,\[\]{}]+?)\s*:\s*""", text)
                if not m:
                    raise Unreadable("a flow map without a key")
                out[str(scalar(m[1]))], text = flow(text[m.end() :])
            else:
                value, text = flow(text)
                out.append(value)
            text = text.lstrip()
            if text.startswith(","):
                text = text[1:].lstrip()
            elif not text.startswith(end):
                raise Unreadable("a flow value isn't closed")
        return out, text[1:]
    m = re.match(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*)""", text)
    return scalar(m[1].strip()), text[m.end() :]


@remembered
def told(raw: str) -> tuple[str, int, bool]:
    """A line's text without comment, its indentation, and whether a tab is part of that."""
    lead = len(raw) - len(raw.lstrip())
    return uncommented(raw.strip()), len(raw) - len(raw.lstrip(" ")), "\t" in raw[:lead]


@remembered
def parts(body: str) -> tuple[type | None, str, str, bool]:
    """What a line's text is (list: an entry, dict: a key, None: neither), its key, what follows, and if that begins a container."""
    if body == "-" or body.startswith("- "):
        rest = body[1:].lstrip()
        return list, "", rest, bool(rest and (rest == "-" or rest.startswith("- ") or KEY.match(rest)))
    if m := KEY.match(body):
        return dict, str(scalar(m[1])), body[m.end() :], False
    return None, "", "", False


def tree(text: str) -> Any:
    """The value of a text; a blank one is null. Raises Unreadable."""
    root: list = []
    # open containers: indentation, the container (None: not known yet), and how to put a value there
    stack: list[list] = [[-1, root, root.append]]
    lines = text.split("\n")
    i = 0

    def put(indent: int, kind: type, holder: list) -> Any:
        """The container of a kind at an indentation, opened in its holder where it isn't yet."""
        if holder[0] == indent and isinstance(holder[1], kind):
            return holder[1]
        raise Unreadable("a list and a map in one place")

    while i < len(lines):
        body, indent, tabbed = told(lines[i])
        i += 1
        if not body or (body == "---" and not root):
            continue
        if tabbed:
            raise Unreadable("a tab as indentation")
        while True:
            kind, key, rest, opens = parts(body)
            while stack[-1][0] > indent or (stack[-1][0] == indent and kind is dict and isinstance(stack[-1][1], list)):
                stack.pop()
            if kind is None:
                if root or len(stack) > 1:
                    raise Unreadable(f"neither a key nor an entry: {body}")
                root.append(scalar(body))
                break
            top = stack[-1]
            waits = top[1] is None
            if waits and top[0] < indent or waits and kind is list and top[0] == indent or not waits and top[0] < indent and top[1] is root and not root:
                container = kind()
                if waits:
                    top[2](container)
                    stack.pop()
                else:
                    root.append(container)
                stack.append([indent, container, None])
            container = put(indent, kind, stack[-1])
            if kind is list:
                container.append(None)
                place = lambda v, c=container: c.__setitem__(-1, v)
                if opens:
                    # an entry that begins a container goes on as a line of its own
                    stack.append([indent, None, place])
                    indent += len(body) - len(rest)
                    body = rest
                    continue
            else:
                if key in container:
                    raise Unreadable(f"a key twice: {key}")
                container[key] = None
                place = lambda v, c=container, k=key: c.__setitem__(k, v)
            if BLOCK.fullmatch(rest):
                held = []
                while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > indent):
                    held.append(lines[i])
                    i += 1
                cut = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
                held = [x[cut:].rstrip() for x in held]
                while held and not held[-1]:
                    held.pop()
                joined = "\n".join(held) if rest[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(held)).replace("\n\n", "\n")
                place(joined + ("" if rest.endswith("-") or not held else "\n"))
            elif rest:
                place(scalar(rest))
            else:
                stack.append([indent, None, place])
            break
    return root[0] if root else None


def fixtures(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `record` (VARIANT) and `error`: fixture-absent for a null or blank text, fixture-unreadable for one not taken."""
    columns = rows.columns
    schema = rows.select("*").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for x in batch.column(text).to_pylist():
                value, error = None, None
                if not (x or "").strip():
                    error = "fixture-absent"
                else:
                    try:
                        value = json.dumps(tree(x), ensure_ascii=False)
                    except (ValueError, RecursionError):
                        error = "fixture-unreadable"
                found.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(errors, pa.string())], [*columns, "_json", "error"])

    out = rows.mapInArrow(run, schema.add("_json", "string").add("error", "string"))
    # exploded, as a filter on a plain column would parse the text twice
    return out.select(*columns, F.explode(F.array(F.try_parse_json("_json"))).alias("record"), "error")
