"""SELECT queries over triples, compiled to joins, filters and groupings.

Read are PREFIX, SELECT (DISTINCT, *, expressions, aggregates), groups with ; and , lists,
OPTIONAL, FILTER with [NOT] EXISTS, UNION, MINUS, BIND, VALUES, sub-SELECT, property paths, GROUP BY,
HAVING, ORDER BY, LIMIT and OFFSET; anything else raises ValueError. Patterns that share
no variable are an error, as they would pair all rows; so are solutions that leave every shared variable
unbound, which only the data can show. Values are their lexical forms;
two values compare as numbers if both read as numbers, else as texts. An unbound variable is null.
Variables whose language, datatype or kind a query asks for carry these along.

Paths of any length are followed a step a round, each written to the shared folder, until no new pair of
ends comes up; from a fixed end only what it reaches is followed.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.shared import kept

_RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s"{}|^`\\]*>)|(?P<var>[?$]\w+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z-]+)
    |(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z][\w-]*)?(?P<local>:(?:[\w-]|\\.|\.(?=\w))*)|(?P<word>[A-Za-z_]+)|(?P<op>\^\^|&&|\|\||<=|>=|!=|[{}().;,*=<>!+/^|?-])""",
    re.X,
)
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _compare(op: str, a: Column, b: Column) -> Column:
    def by(x: Column, y: Column) -> Column:
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    return F.when(_number(a).isNotNull() & _number(b).isNotNull(), by(_number(a), _number(b))).otherwise(by(a.cast("string"), b.cast("string")))


_FUNCTIONS = {
    "STR": lambda a: a.cast("string"),
    "LCASE": F.lower,
    "UCASE": F.upper,
    "STRLEN": F.length,
    "CONTAINS": lambda a, b: a.contains(b),
    "STRSTARTS": lambda a, b: a.startswith(b),
    "STRENDS": lambda a, b: a.endswith(b),
    "REGEX": lambda a, b, flags=None: F.regexp_like(a, b if flags is None else F.concat(F.lit("(?"), flags, F.lit(")"), b)),
    "REPLACE": F.regexp_replace,
    "SUBSTR": lambda a, i, n=None: F.substr(a, i.cast("int"), F.lit(2**31 - 1) if n is None else n.cast("int")),
    "CONCAT": lambda *a: F.concat(*a),
    "COALESCE": lambda *a: F.coalesce(*a),
    "IF": lambda c, a, b: F.when(c, a).otherwise(b),
    "ABS": lambda a: F.abs(_number(a)),
    "YEAR": lambda a: F.year(F.try_to_timestamp(a)),
    "MONTH": lambda a: F.month(F.try_to_timestamp(a)),
    "DAY": lambda a: F.dayofmonth(F.try_to_timestamp(a)),
}


#: Start of the columns that tell a variable's language, datatype and kind.
_META = "_meta_"
#: Variables that may be unbound on either side of a join, at most.
_MOST_LOOSE = 4
#: Rounds of a path of any length, at most.
_MOST_STEPS = 1000


def _meta(name: str, part: str) -> Column:
    return F.col(f"{_META}{name}.{part}")


def _language(name: str) -> Column:
    return F.coalesce(_meta(name, "o_lang"), F.when(_meta(name, "o_kind") == "literal", ""))


def _datatype(name: str) -> Column:
    plain = F.when(_meta(name, "o_lang").isNotNull(), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise("http://www.w3.org/2001/XMLSchema#string")
    return F.when(_meta(name, "o_kind") == "literal", F.coalesce(_meta(name, "o_datatype"), plain))


#: Functions of a variable that need more than its value.
_OF_TERMS = {
    "LANG": _language, "DATATYPE": _datatype, "ISIRI": lambda n: _meta(n, "o_kind") == "iri", "ISURI": lambda n: _meta(n, "o_kind") == "iri",
    "ISLITERAL": lambda n: _meta(n, "o_kind") == "literal", "ISBLANK": lambda n: _meta(n, "o_kind") == "bnode",
}


class _Rows:
    """Solutions: a column a variable, and the variables that may be unbound."""

    def __init__(self, df: DataFrame | None, maybe: frozenset[str] = frozenset()):
        self.df, self.maybe = df, maybe

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(_META)] if self.df is not None else []

    def where(self, condition: Column, used: set[str]) -> _Rows:
        missing = sorted(used - set(self.names))
        df = self.df.withColumns({v: F.lit(None).cast("string") for v in missing}) if missing else self.df
        return _Rows(df.filter(condition).drop(*missing), self.maybe)

    def join(self, other: _Rows, how: str = "inner", conditions: tuple[Column, ...] = ()) -> _Rows:
        """Compatible solutions: shared variables equal, or unbound on a side; conditions see both sides' variables."""
        if self.df is None:
            if how != "inner":
                raise ValueError("an optional or excluded part needs a pattern before it")
            return other
        shared = [v for v in self.names if v in other.names]
        if how == "left_anti" and not shared:
            return self
        if not shared:
            raise ValueError(f"patterns share no variable: {self.names} and {other.names}")
        right = other.df.drop(*(c for c in self.df.columns if c.startswith(_META)))
        loose = sorted((self.maybe | other.maybe) & set(shared))
        if not conditions and not loose:
            df = self.df.join(right, shared, how)
        else:
            df = self._loosely(right, shared, loose, other.maybe, how, conditions)
        if how in ("left_semi", "left_anti"):
            return _Rows(df, self.maybe)
        fresh = set(other.names) - set(shared)
        maybe = self.maybe | fresh if how == "left" else (self.maybe - (set(shared) - other.maybe)) | (other.maybe & (fresh | self.maybe))
        return _Rows(df, frozenset(maybe))


    def _loosely(self, right: DataFrame, shared: list[str], loose: list[str], right_maybe: frozenset[str], how: str, conditions: tuple[Column, ...]) -> DataFrame:
        """A join whose shared variables may be unbound: an equi-join for each way in which they are, all together."""
        if len(loose) > _MOST_LOOSE:
            raise ValueError(f"too many variables may be unbound: {loose}")
        right = right.withColumnsRenamed({v: f"{v}__r" for v in shared})
        here, there = ([v for v in loose if v in m] for m in (self.maybe, right_maybe))
        extra = [c for c in right.columns if not c.endswith("__r") or c[:-3] not in shared]
        mine = [F.coalesce(v, f"{v}__r").alias(v) if v in shared else F.col(v) for v in self.df.columns]

        def bound(df: DataFrame, names: list[str], mask: tuple[bool, ...], end: str) -> DataFrame:
            for v, there_is in zip(names, mask):
                df = df.filter(F.col(v + end).isNotNull() if there_is else F.col(v + end).isNull())
            return df

        out = []
        for mask in product((True, False), repeat=len(here)):
            left = bound(self.df, here, mask, "")
            free = {v for v, there_is in zip(here, mask) if not there_is}
            alone = left
            for other_mask in product((True, False), repeat=len(there)):
                part = bound(right, there, other_mask, "__r")
                on = [F.col(v) == F.col(f"{v}__r") for v in shared if v not in free and v not in {w for w, there_is in zip(there, other_mask) if not there_is}]
                if not on:  # such rows would pair with all: none may be there
                    zero = lambda df: F.length(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit(""))) * 0
                    pair = left.limit(1).withColumn("_zero", zero(left)).join(part.limit(1).withColumn("_zero", zero(part)), "_zero")
                    told = F.raise_error(F.lit(f"solutions share no bound variable of {shared}"))
                    pair = pair.withColumn(shared[0], F.when(F.col("_zero") == 0, told.cast("string")))
                    out.append(pair.select(*mine, *extra) if how in ("inner", "left") else pair.select(*self.df.columns))
                    continue
                condition = reduce(lambda x, y: x & y, [*on, *conditions])
                if how in ("inner", "left"):
                    out.append(left.join(part, condition, "inner").select(*mine, *extra))
                    if how == "left":
                        alone = alone.join(part, condition, "left_anti")
                elif how == "left_anti":
                    alone = alone.join(part, condition, "left_anti")
                else:
                    out.append(left.join(part, condition, "left_semi"))
            if how == "left":
                out.append(alone.select(*self.df.columns, *(F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in extra)))
            elif how == "left_anti":
                out.append(alone)
        df = reduce(DataFrame.unionByName, out)
        return df.distinct() if how == "left_semi" and there else df


class _Reader:
    def __init__(self, triples: DataFrame, text: str):
        self.triples, self.at, self.tokens, self.prefixes = triples, 0, [], {}
        pos = 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"query can't be read at {text[pos : pos + 30]!r}")
            pos = m.end()
            if m.group("local") is not None:
                self.tokens.append(("pname", (m.group("name") or "", re.sub(r"\\(.)", r"\1", m.group("local")[1:]))))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
        self.used: set[str] = set()
        called = lambda i: self.tokens[i][0] == "word" and str(self.tokens[i][1]).upper() in _OF_TERMS and self.tokens[i + 1][1] == "("
        #: Variables whose terms are asked for.
        self.termed = {str(self.tokens[i + 2][1])[1:] for i in range(len(self.tokens) - 2) if called(i) and self.tokens[i + 2][0] == "var"}

    # tokens
    def peek(self, *words: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return kind in ("word", "op") and value.upper() in words

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word} expected, {self.tokens[self.at : self.at + 1]} found")

    def next(self) -> tuple[str, object]:
        if self.at >= len(self.tokens):
            raise ValueError("query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    # terms
    def term(self) -> tuple[str, str]:
        """(var, iri, literal; value)."""
        kind, value = self.next()
        if kind == "var":
            return "var", value[1:]
        if kind == "iri":
            return "iri", value[1:-1]
        if kind == "pname":
            if value[0] not in self.prefixes:
                raise ValueError(f"unknown prefix {value[0]}:")
            return "iri", self.prefixes[value[0]] + value[1]
        if kind == "text":
            if self.kind() == "lang":
                self.next()
            elif self.take("^^"):
                self.term()
            return "literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1])
        if kind == "number":
            return "literal", value
        if kind == "word" and value == "a":
            return "iri", _RDF_TYPE
        raise ValueError(f"no term: {value}")

    # paths
    def path(self) -> tuple[str, object]:
        """A predicate (var or iri) or a path: a function of fixed ends to rows (s, o, o_kind, o_datatype, o_lang)."""
        if self.kind() == "var":
            return self.term()
        out = self._sequence()
        while self.take("|"):
            first, second = self._edges(out), self._edges(self._sequence())
            out = "path", lambda s, o, x=first, y=second: x(s, o).unionByName(y(s, o)).distinct()
        return out

    def _sequence(self) -> tuple[str, object]:
        out = self._step()
        while self.take("/"):
            first, second = self._edges(out), self._edges(self._step())

            def both(s, o, x=first, y=second):
                left = x(s, None).select("s", F.col("o").alias("_m"))
                right = y(None, o).withColumnRenamed("s", "_m")
                return left.join(right, "_m").drop("_m")

            out = "path", both
        return out

    def _step(self) -> tuple[str, object]:
        back = self.take("^")
        if self.take("!"):
            names = [self.term()[1]] if not self.take("(") else self._names()
            out = "path", lambda s, o: self._fixed(self.triples.filter(~F.col("p").isin(names)), s, o)
        elif self.take("("):
            out = self.path()
            self.need(")")
        else:
            out = self.term()
        if self.kind() == "op" and self.peek("+", "*", "?"):
            mark, edges = self.next()[1], self._edges(out)
            out = "path", lambda s, o: self._repeated(edges, mark, s, o)
        if back:
            edges = self._edges(out)
            out = "path", lambda s, o: edges(o, s).select(F.col("o").alias("s"), F.col("s").alias("o"), *self._as_node("s"))
        return out

    def _names(self) -> list[str]:
        names = [self.term()[1]]
        while self.take("|"):
            names.append(self.term()[1])
        self.need(")")
        return names

    @staticmethod
    def _as_node(column: str) -> list[Column]:
        kind = F.when(F.col(column).startswith("_:"), "bnode").otherwise("iri")
        return [kind.alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")]

    @staticmethod
    def _fixed(rows: DataFrame, s: str | None, o: str | None) -> DataFrame:
        rows = rows.filter(F.col("s") == s) if s is not None else rows
        rows = rows.filter(F.col("o") == o) if o is not None else rows
        return rows.select("s", "o", "o_kind", "o_datatype", "o_lang")

    def _edges(self, step: tuple[str, object]):
        kind, value = step
        if kind == "path":
            return value
        return lambda s, o: self._fixed(self.triples.filter(F.col("p") == value), s, o)

    def _repeated(self, edges, mark: str, s: str | None, o: str | None) -> DataFrame:
        """Pairs of ends of any number of steps; with * and ? also every node and itself."""
        one = edges(s, None if mark != "?" else o)
        backwards = s is None and o is not None and mark != "?"
        if backwards:  # from the fixed end back
            one = edges(None, o)
        found = one.distinct() if mark == "?" else kept(one.distinct(), "path")
        if mark != "?":
            steps, new = edges(None, None), found
            for _ in range(_MOST_STEPS):
                if backwards:
                    next_ = steps.select("s", F.col("o").alias("_m")).join(new.withColumnRenamed("s", "_m"), "_m").drop("_m")
                else:
                    next_ = new.select("s", F.col("o").alias("_m")).join(steps.withColumnRenamed("s", "_m"), "_m").drop("_m")
                new = kept(next_.select(*found.columns).distinct().join(found.select("s", "o"), ["s", "o"], "left_anti"), "path")
                if new.isEmpty():
                    break
                found = found.unionByName(new)
            else:
                raise RuntimeError("a path did not end")
        if mark in "*?":
            nodes = self.triples.select(F.col("s").alias("o"), *self._as_node("s")).unionByName(self.triples.select("o", "o_kind", "o_datatype", "o_lang")).distinct()
            nodes = nodes.filter(F.col("o") == (s if s is not None else o)) if s is not None or o is not None else nodes
            found = found.unionByName(nodes.withColumn("s", F.col("o")).select(*found.columns)).distinct()
        return self._fixed(found, s, o)

    def _pattern(self, s, p, o) -> _Rows:
        rows, out = self.triples, {}
        if p[0] == "path":
            ends = [x[1] if x[0] != "var" else None for x in (s, o)]
            rows, p = p[1](*ends), None
        for column, (kind, value) in (("s", s), ("o", o)) if p is None else (("s", s), ("p", p), ("o", o)):
            if kind != "var":
                rows = rows.filter(F.col(column) == value)
                if column == "o":
                    rows = rows.filter((F.col("o_kind") == "literal") if kind == "literal" else (F.col("o_kind") != "literal"))
            elif value in out:
                rows = rows.filter(F.col(column) == F.col(out[value]))
            else:
                out[value] = column
        if not out:
            raise ValueError("a pattern needs a variable")
        about = [F.struct("o_lang", "o_datatype", "o_kind") if c == "o" else F.struct(F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_datatype"), F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri").alias("o_kind")) for v, c in out.items() if v in self.termed]
        return _Rows(rows.select(*(F.col(c).alias(v) for v, c in out.items()), *(x.alias(f"{_META}{v}") for x, v in zip(about, (v for v in out if v in self.termed)))))

    def _triples(self, rows: _Rows) -> _Rows:
        found = []
        while self.kind() in ("var", "iri", "pname"):
            s = self.term()
            while True:
                p = self.path()
                while True:
                    found.append(self._pattern(s, p, self.term()))
                    if not self.take(","):
                        break
                if not self.take(";") or self.peek(".", "}"):
                    break
            if not self.take("."):
                break
        while found:  # the next pattern shares a variable with those before it, where one does
            k = next((i for i, f in enumerate(found) if rows.df is None or set(f.names) & set(rows.names)), 0)
            rows = rows.join(found.pop(k))
        return rows

    # groups
    def group(self) -> tuple[_Rows, list[tuple[Column, set[str]]]]:
        """Solutions without the group's own filters, and the filters."""
        self.need("{")
        rows, filters = _Rows(None), []
        if self.peek("SELECT"):
            df = self.select()
            self.need("}")
            return _Rows(df, frozenset(self.loose)), []
        while not self.take("}"):
            if self.kind() in ("var", "iri", "pname"):
                rows = self._triples(rows)
            elif self.take("OPTIONAL"):
                part, conditions = self.group()
                known = set(rows.names) | set(part.names)
                columns = tuple(c for c, used in conditions if used <= known)
                if len(columns) < len(conditions):
                    raise ValueError("a filter of an optional part names unknown variables")
                rows = rows.join(part, "left", columns)
            elif self.take("MINUS"):
                rows = rows.join(self.closed(), "left_anti")
            elif self.take("FILTER"):
                no = self.take("NOT")
                if no or self.peek("EXISTS"):
                    self.need("EXISTS")
                    rows = rows.join(self.closed(), "left_anti" if no else "left_semi")
                else:
                    filters.append(self.condition())
            elif self.take("BIND"):
                self.need("(")
                value, uses = self.condition()
                self.need("AS")
                name = self.term()[1]
                self.need(")")
                if name in rows.names:
                    raise ValueError(f"?{name} has a value already")
                if rows.df is None:  # a value by itself
                    if uses:
                        raise ValueError("a value that comes first can't use variables")
                    rows = _Rows(self.triples.sparkSession.range(1).select(value.cast("string").alias(name)), frozenset())
                else:
                    rows = _Rows(rows.df.withColumn(name, value.cast("string")), rows.maybe | {name})
            elif self.take("VALUES"):
                rows = rows.join(self._values())
            elif self.peek("{"):
                part = self.closed()
                while self.take("UNION"):
                    other = self.closed()
                    apart = set(part.names) ^ set(other.names)
                    part = _Rows(part.df.unionByName(other.df, allowMissingColumns=True), part.maybe | other.maybe | apart)
                rows = rows.join(part)
            elif not self.take("."):
                raise ValueError(f"can't read {self.tokens[self.at : self.at + 3]}")
        return rows, filters

    def closed(self) -> _Rows:
        rows, filters = self.group()
        for condition, used in filters:
            rows = rows.where(condition, used)
        return rows

    def _values(self) -> _Rows:
        one = not self.take("(")
        names = []
        while self.kind() == "var" and not (one and names):
            names.append(self.term()[1])
        if not one:
            self.need(")")
        self.need("{")
        values = []
        while not self.take("}"):
            if not one:
                self.need("(")
            values.append(tuple(None if self.take("UNDEF") else self.term()[1] for _ in names))
            if not one:
                self.need(")")
        spark = self.triples.sparkSession
        unbound = frozenset(n for k, n in enumerate(names) if any(v[k] is None for v in values))
        return _Rows(spark.createDataFrame(values, ", ".join(f"`{n}` string" for n in names)), unbound)

    # expressions
    def condition(self) -> tuple[Column, set[str]]:
        before, self.used = self.used, set()
        out, used = self.either(), self.used
        self.used = before | used
        return out, used

    def either(self) -> Column:
        out = self.both()
        while self.take("||"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.relation()
        while self.take("&&"):
            out = out & self.relation()
        return out

    def relation(self) -> Column:
        left = self.sum()
        no = self.take("NOT")
        if no or self.peek("IN"):
            self.need("IN")
            hits = reduce(lambda a, b: a | b, (_compare("=", left, x) for x in self.arguments()), F.lit(False))
            return ~hits if no else hits
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return _compare(op, left, self.sum())
        return left

    def sum(self) -> Column:
        out = self.product()
        while self.peek("+", "-"):
            plus = self.next()[1] == "+"
            right = _number(self.product())
            out = _number(out) + right if plus else _number(out) - right
        return out

    def product(self) -> Column:
        out = self.unary()
        while self.peek("*", "/"):
            times = self.next()[1] == "*"
            right = _number(self.unary())
            out = _number(out) * right if times else _number(out) / F.nullif(right, F.lit(0.0))
        return out

    def unary(self) -> Column:
        if self.take("!"):
            return ~self.unary()
        if self.take("-"):
            return -_number(self.unary())
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.kind() == "word" and not self.peek("A"):
            return self.call(self.next()[1].upper())
        kind, value = self.term()
        if kind == "var":
            self.used.add(value)
            return F.col(value)
        return F.lit(value)

    def arguments(self) -> list[Column]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.either())
            self.take(",")
        return out

    def call(self, name: str) -> Column:
        if name in ("TRUE", "FALSE"):
            return F.lit(name == "TRUE")
        if name in _AGGREGATES:
            return self.aggregate(name)
        if name in _OF_TERMS:
            self.need("(")
            kind, value = self.term()
            if kind != "var":
                raise ValueError(f"{name} needs a variable")
            self.need(")")
            self.used.add(value)
            return _OF_TERMS[name](value)
        arguments = self.arguments()
        if name == "LANGMATCHES":
            return F.when(arguments[1] == "*", arguments[0] != "").otherwise((F.lower(arguments[0]) == F.lower(arguments[1])) | F.lower(arguments[0]).startswith(F.concat(F.lower(arguments[1]), F.lit("-"))))
        if name == "BOUND":
            return arguments[0].isNotNull()
        if name not in _FUNCTIONS:
            raise ValueError(f"unknown function {name}")
        return _FUNCTIONS[name](*arguments)

    def aggregate(self, name: str) -> Column:
        self.aggregated = True
        self.need("(")
        once = self.take("DISTINCT")
        if self.take("*"):
            self.need(")")
            return F.count("*")
        value, between = self.either(), " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            between = self.term()[1]
        self.need(")")
        if name == "COUNT":
            return F.count_distinct(value) if once else F.count(value)
        if name in ("SUM", "AVG"):
            number = _number(value)
            if name == "SUM":
                return F.sum_distinct(number) if once else F.sum(number)
            return F.sum_distinct(number) / F.count_distinct(number) if once else F.avg(number)
        if name == "GROUP_CONCAT":
            return F.array_join(F.array_sort((F.collect_set if once else F.collect_list)(value)), between)
        if name == "SAMPLE":
            return F.min(value)
        pick = F.min_by if name == "MIN" else F.max_by
        return pick(value, F.struct(_number(value), value))

    # queries
    def select(self) -> DataFrame:
        self.need("SELECT")
        once, start = self.take("DISTINCT", "REDUCED"), self.at
        while not self.peek("WHERE", "{"):
            self.next()
        self.take("WHERE")
        rows = self.closed()
        if rows.df is None:
            raise ValueError("a query needs a pattern")
        end, self.at, self.aggregated = self.at, start, False
        shown, everything = {}, self.take("*")
        while not self.peek("WHERE", "{"):
            if self.take("("):
                value = self.either()
                self.need("AS")
                shown[self.term()[1]] = value
                self.need(")")
            else:
                name = self.term()[1]
                shown[name] = F.col(name) if name in rows.names else F.lit(None).cast("string")
        self.at, keys, having = end, [], None
        if self.take("GROUP"):
            self.need("BY")
            while self.kind() == "var":
                keys.append(self.term()[1])
        if self.take("HAVING"):
            having = self.either()
        df = rows.df
        if keys or self.aggregated or having is not None:
            values = {n: c for n, c in shown.items() if n not in keys}
            df = df.groupBy(*keys).agg(*(c.alias(n) for n, c in values.items()), *([having.alias("_having")] if having is not None else [F.count("*").alias("_n")] * (not values)))
            df = df.filter("_having") if having is not None else df
            df = df.select(*shown)
            keep = list(shown)
        else:
            keep = rows.names if everything else list(shown)
            df = df.withColumns({n: c for n, c in shown.items() if n not in rows.names})
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while self.peek("ASC", "DESC", "(") or self.kind() == "var":
                down = self.peek("DESC")
                self.take("ASC", "DESC")
                value = self.unary()
                order += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in (_number(value), value)]
        if once:
            df = df.select(*keep).distinct()
        df = df.orderBy(*order) if order else df
        limit = offset = None
        while self.peek("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                limit = int(self.next()[1])
            else:
                self.need("OFFSET")
                offset = int(self.next()[1])
        self.loose = set(keep) & (set(rows.maybe) | (set(shown) - set(rows.names)) | ((set(keep) - set(keys)) if self.aggregated or keys else set()))
        df = df.offset(offset) if offset else df
        return (df if limit is None else df.limit(limit)).select(*keep)

    def query(self) -> DataFrame:
        while self.take("PREFIX"):
            _, (name, _) = self.next()
            self.prefixes[name] = self.next()[1][1:-1]
        out = self.select()
        if self.at < len(self.tokens):
            raise ValueError(f"query goes on: {self.tokens[self.at : self.at + 3]}")
        return out


def query(triples: DataFrame, text: str, bound: dict[str, str] | None = None) -> DataFrame:
    """Rows of a SELECT query, a column a variable; bound gives variables their values."""
    out = _Reader(triples, text).query()
    for name, value in (bound or {}).items():
        out = out.filter(F.col(name) == value)
    return out
