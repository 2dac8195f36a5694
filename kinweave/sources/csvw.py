"""Column maps: which column of a CSV holds what, as a CSVW description (JSON) with translations of values.

A map's columns have a name, and either titles (a header) or, if virtual, a value. Both may hold
{name} for another column's value, or {name.property} for a property of that column or
of the choice its value was translated by. Choices are listed in notes: rdf:value is what the
file holds and rdfs:label what it means. Everything becomes one expression a column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of the parts of a date, which are filled up with zeros (fixed values).
_DIGITS = {"eventYear": 4, "eventMonth": 2, "eventDay": 2}
_VARIABLE = re.compile(r"\{([\w:]+)(?:\.([\w:]+))?\}")
_NULL = "NULL"


def load(text: str) -> dict[str, dict]:
    """The columns of a description by name."""
    description = json.loads(text)
    columns = description.get("tableSchema", {}).get("columns")
    if not columns or not all(isinstance(c, dict) and c.get("name") for c in columns):
        raise ValueError("a column map needs tableSchema.columns, each with a name")
    return {c["name"]: c for c in columns}


def choices(column: dict) -> list[dict]:
    """The items of a column's choices."""
    bodies = [n.get("body") for n in column.get("notes") or () if isinstance(n, dict) and n.get("type") == "Annotation"]
    return [i for b in bodies if isinstance(b, dict) and b.get("type") == "Choice" for i in b.get("items") or ()]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed (and written in the plan) once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by(value: Column, table: dict[str, Column | str], otherwise: Column) -> Column:
    """What a table has for a value."""
    out = F
    for key, result in table.items():
        out = out.when(value == key, result)
    return out.otherwise(otherwise) if table else otherwise


class Values:
    """Expressions for the named values of a table read with its headers."""

    def __init__(self, columns: dict[str, dict], headers: list[str]):
        self.columns, self.headers = columns, headers

    def _cell(self, header: str) -> Column:
        if header not in self.headers:
            return F.lit(None).cast("string")
        text = F.trim(F.col(f"`{header}`").cast("string"))
        return F.when(~text.isin("", _NULL), text)

    def _property(self, name: str, prop: str, use: Callable[[str], Column]) -> Column:
        """use(value) of a property of a column, or of the choice that its value stands for; null without one."""
        column = self.columns[name]
        if prop in column:
            return use(str(column[prop]))
        found = {i["rdfs:label"]: use(str(i[prop])) for i in choices(column) if prop in i and "rdfs:label" in i}
        return _let(self.value(name), lambda v: _by(v, found, F.lit(None).cast("string")))

    def _filled(self, template: str, path: tuple[str, ...]) -> Column:
        """A value with variables; null if one of them is."""
        parts, at = [], 0
        for m in _VARIABLE.finditer(template):
            parts.append(F.lit(template[at : m.start()]))
            if m[2]:
                parts.append(self._property(m[1], m[2], F.lit))
            else:
                parts.append(self.value(m[1], path))
            at = m.end()
        return F.concat(*parts, F.lit(template[at:]))

    def _titled(self, title: str) -> Column:
        """The cell under a header; a header with variables is chosen by row."""
        m = _VARIABLE.search(title)
        if not m:
            return self._cell(title)
        if not m[2]:
            raise ValueError(f"a header can't depend on any value: {title}")
        return self._property(m[1], m[2], lambda v: self._titled(title[: m.start()] + v + title[m.end() :]))

    def value(self, name: str, path: tuple[str, ...] = ()) -> Column:
        column = self.columns.get(name)
        if column is None:
            return F.lit(None).cast("string")
        if name in path:
            raise ValueError(f"columns depend on each other: {' '.join((*path, name))}")
        if column.get("virtual") and column.get("value") is not None:
            out = self._filled(column["value"], (*path, name))
        else:
            out = self._titled(column["titles"]) if column.get("titles") else F.lit(None).cast("string")
        meant = {i["rdf:value"]: F.lit(i["rdfs:label"]) for i in reversed(choices(column)) if "rdf:value" in i and "rdfs:label" in i}
        if meant:
            out = _let(out, lambda v: _by(v, meant, v))
        if n := _DIGITS.get(name):
            out = _let(out, lambda v: F.when(F.length(v) < n, F.lpad(v, n, "0")).otherwise(v))
        return _let(out, lambda v: F.when(v != _NULL, v))


def values(table: DataFrame, columns: dict[str, dict], names: dict[str, str]) -> DataFrame:
    """The named values of a table, a column for each of names (its name here: the map's)."""
    v = Values(columns, table.columns)
    return table.select(*(v.value(theirs).alias(ours) for ours, theirs in names.items()))
