"""Date and age rules: boolean expressions over diff."""

from __future__ import annotations

import re

import numpy as np
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\s*(?:(diff)|(-?\d+(?:\.\d+)?)|(<=|>=|==|!=|<|>)|(&&|\|\|)|([()])|(!))")

#: Rules are tried for gaps of so many years.
_MOST_YEARS = 1000

#: Bounds of the standard rules (fixed values): process, check, condition.
STANDARD = {
    ("within_b_d", "timegapdiff"): "diff >= 0 && diff <= 110", ("within_b_d", "consistencytolerance"): "diff <= 2",
    ("within_m_m", "timegapdiff"): "diff >= 0 && diff <= 92", ("within_m_m", "consistencytolerance"): "diff <= 2",
    ("within_b_m", "timegapdiff"): "diff >= 14 && diff <= 80", ("between_b_d", "timegapdiff"): "diff >= -1 && diff <= 96",
    ("between_b_m", "timegapdiff"): "diff >= -5 && diff <= 36", ("between_d_m", "timegapdiff"): "diff >= -5 && diff <= 146",
    ("between_m_m", "timegapdiff"): "diff >= 14 && diff <= 100",
}


def condition(text: str, diff):
    """A condition over diff, a Column or a numpy array; only numbers, diff, comparisons, &&, ||, ! and brackets are read."""
    sql, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"rule can't be read at {text[at:]!r}")
        name, number, compare, join, bracket, no = m.groups()
        sql.append("_d" if name else number or {"==": "="}.get(compare, compare) if (number or compare) else {"&&": "and", "||": "or"}[join] if join else bracket or "not")
        at = m.end()
    return _bound(sql, diff)


def _bound(sql: list[str], value):
    """The tokens as an expression over value, by precedence: ! && ||."""
    at = 0

    def term():
        nonlocal at
        token = sql[at]
        at += 1
        if token == "not":
            return ~term()
        if token == "(":
            inner = either()
            at += 1
            return inner
        left, op, right = token, sql[at], sql[at + 1]
        at += 2
        side = lambda t: value if t == "_d" else float(t)
        a, b = side(left), side(right)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "!=": a != b}[op]

    def both():
        nonlocal at
        out = term()
        while at < len(sql) and sql[at] == "and":
            at += 1
            out = out & term()
        return out

    def either():
        nonlocal at
        out = both()
        while at < len(sql) and sql[at] == "or":
            at += 1
            out = out | both()
        return out

    out = either()
    if at != len(sql):
        raise ValueError("rule has words left over")
    return out


def load(text: str) -> dict[tuple[str, str], str]:
    """Rules of a multi-document YAML text, by (process, check)."""
    found = {}
    for doc in yaml.safe_load_all(text):
        if doc:
            process, _, check = str(doc["name"]).lower().partition(".")
            condition(str(doc["condition"]), F.lit(0))
            found[process, check] = str(doc["condition"])
    return found


def time_ok(process: str, gap: Column, rules: dict[tuple[str, str], str] | None = None) -> Column:
    """A missing rule accepts; a missing date rejects."""
    rule = (STANDARD if rules is None else rules).get((process, "timegapdiff"))
    return F.coalesce(condition(rule, gap), F.lit(False)) if rule else F.lit(True)


def span(process: str, backwards: bool, rules: dict[tuple[str, str], str] | None = None) -> tuple[int, int] | None:
    """B's year less A's, at least and at most, where the rule on years (from B to A if backwards) can hold; None if unbounded."""
    rule = (STANDARD if rules is None else rules).get((process, "timegapdiff"))
    if not rule:
        return None
    gaps = np.arange(-_MOST_YEARS, _MOST_YEARS + 1)
    held = gaps[np.broadcast_to(condition(rule, gaps), gaps.shape)]
    if not len(held):
        return 0, -1
    low, high = int(held[0]), int(held[-1])
    if low == -_MOST_YEARS or high == _MOST_YEARS:
        return None
    return (-high - 1, -low + 1) if backwards else (low - 1, high + 1)


def age_ok(process: str, gap: Column, age: Column, rules: dict[tuple[str, str], str] | None = None) -> Column:
    """An unknown age (below 0) or a missing rule accepts."""
    rule = (STANDARD if rules is None else rules).get((process, "consistencytolerance"))
    return (age < 0) | F.coalesce(condition(rule, F.abs(gap - age)), F.lit(False)) if rule else F.lit(True)
