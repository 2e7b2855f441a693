"""Canonical JSON: one text for equal values, whatever the order of keys and the spelling of numbers.

Values are VARIANTs of any depth. Each is written within its row, by Arrow batches: nothing is shuffled, and what a task holds is a batch.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A string as JSON, as Spark writes it: escapes have capital digits."""
    return re.sub(r"\\u00[01][0-9a-f]", lambda m: "\\u" + m[0][2:].upper(), json.dumps(text, ensure_ascii=False))


def js_number(x: float) -> str:
    """A number as JavaScript writes it: shortest digits, plain from 1e-6 to under 1e21, else with an exponent.

    Infinities and NaN, which JSON hasn't, come as strings.
    """
    if not math.isfinite(x):
        return '"NaN"' if x != x else '"Infinity"' if x > 0 else '"-Infinity"'
    if x == int(x) and abs(x) < 2**53:
        return str(int(x))
    part, _, power = repr(abs(x)).partition("e")
    whole, _, rest = part.partition(".")
    first = (whole + rest).lstrip("0")
    digits = first.rstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + rest) - len(first))
    if len(digits) <= point <= 21:
        told = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        told = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        told = "0." + "0" * -point + digits
    else:
        told = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1:+d}"
    return ("-" if x < 0 else "") + told


def canonical_text(text: str) -> str:
    """Canonical JSON of a JSON text. Open containers are on a list, so depth isn't bounded by calls."""
    out, todo = [], [json.loads(text, parse_int=float)]
    while todo:
        value = todo.pop()
        if type(value) is tuple:
            out.append(value[0])
        elif isinstance(value, dict):
            todo.append(("}",))
            for i, k in reversed(list(enumerate(sorted(value)))):
                todo += [value[k], (("," if i else "") + quoted(k) + ":",)]
            out.append("{")
        elif isinstance(value, list):
            todo.append(("]",))
            for i in range(len(value) - 1, -1, -1):
                todo.append(value[i])
                if i:
                    todo.append((",",))
            out.append("[")
        elif isinstance(value, float):
            out.append(js_number(value))
        else:
            out.append(quoted(value) if isinstance(value, str) else json.dumps(value))
    return "".join(out)


def number_text(x: Column) -> Column:
    """Doubles as js_number() writes them."""

    @F.arrow_udf("string")
    def told(numbers: pa.Array) -> pa.Array:
        return pa.array([None if n is None else js_number(n) for n in numbers.to_pylist()], pa.string())

    return told(x)


def canonical(rows: DataFrame, value: str, text: str = "canonical") -> DataFrame:
    """rows with the canonical JSON of their VARIANT column `value` as `text`; a null value has none.

    Keys are sorted by their UTF-8 bytes and numbers are doubles, as in JSON.stringify.
    """

    @F.arrow_udf("string")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical_text(t) for t in texts.to_pylist()], pa.string())

    return rows.withColumn(text, told(F.to_json(F.col(value))))
