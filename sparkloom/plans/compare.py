"""Whether two results are the same: names, kinds, and rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import pyarrow as pa


def kind(t: pa.DataType) -> str:
    """Types that compare with each other have one kind."""
    if pa.types.is_integer(t) or pa.types.is_decimal(t):
        return "whole" if pa.types.is_integer(t) or t.scale == 0 else "decimal"
    tests = {"float": pa.types.is_floating, "text": lambda x: pa.types.is_string(x) or pa.types.is_large_string(x), "time": pa.types.is_timestamp, "truth": pa.types.is_boolean}
    return next((k for k, test in tests.items() if test(t)), str(t))


def _cell(x):
    """Whole numbers, texts and times as they are; others to nine digits."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(f"{float(x):.9g}")
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


def differences(a: pa.Table, b: pa.Table) -> str:
    """Empty if the tables agree, else what differs first."""
    if sorted(a.column_names) != sorted(b.column_names):
        return f"columns {sorted(a.column_names)} and {sorted(b.column_names)}"
    names = sorted(a.column_names)
    kinds = [[kind(t.schema.field(n).type) for n in names] for t in (a, b)]
    if kinds[0] != kinds[1]:
        return f"kinds {dict(zip(names, zip(*kinds, strict=True), strict=True))}"
    one, two = (Counter(zip(*([_cell(x) for x in t.column(n).to_pylist()] for n in names), strict=True)) for t in (a, b))
    if one == two:
        return ""
    less, more = one - two, two - one
    return f"{a.num_rows} and {b.num_rows} rows; of {names} the first has {list(less.items())[:3]}, the second {list(more.items())[:3]}"
