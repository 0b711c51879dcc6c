"""A front end for SPARQL text on a triple table.

PREFIX, SELECT (DISTINCT) with expressions, basic graph patterns with ; and , lists and sequence paths, OPTIONAL,
UNION, FILTER with (NOT) EXISTS, BIND, VALUES, GROUP BY, HAVING, ORDER BY, LIMIT and OFFSET. The text becomes a DataFrame plan:
patterns are filters of the triple table, joined on shared variables, so Catalyst prunes and orders them.

A variable is a column; with it go columns of its kind, datatype and language where a pattern binds it to an object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import RDF_TYPE
from .knowledge import XSD

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z][\w-]*)|(?P<number>\d+(?:\.\d+)?)"""
    r"""|(?P<op>\^\^|&&|\|\||!=|<=|>=|[=<>!+\-*/(){}.;,|])|(?P<name>[\w-]*:[\w%-]*(?:\.[\w%-]+)*|\w+)"""
)
_NUMERIC = tuple(XSD + x for x in ("integer", "decimal", "double", "float", "int", "long"))


@dataclass
class Value:
    """An expression: its text, and what is known of its term."""

    text: Column
    datatype: Column | None = None
    lang: Column | None = None
    is_bool: bool = False
    is_number: bool = False

    def number(self) -> Column:
        return self.text if self.is_number else self.text.try_cast("double")


@dataclass
class Solution:
    """Rows of bindings: for variable x, columns x, x__k (kind), x__t (datatype) and x__l (language). maybe: variables that may be unbound."""

    df: DataFrame
    vars: list[str]
    maybe: set[str] = field(default_factory=set)


def _columns(name: str) -> list[str]:
    return [name, f"{name}__k", f"{name}__t", f"{name}__l"]


class Query:
    """A parsed query, run on triples by rows()."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise SyntaxError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.fresh = 0

    # -- tokens -----------------------------------------------------------------------------------

    def _peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def _next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def _word(self, *words: str) -> str | None:
        """The next token in upper case if it is one of the words, which it then takes."""
        kind, text = self._peek()
        if kind in ("name", "op") and text.upper() in words:
            self.at += 1
            return text.upper()
        return None

    def _need(self, word: str) -> None:
        if self._word(word) is None:
            raise SyntaxError(f"expected {word}, found {self._peek()[1]!r}")

    # -- terms ------------------------------------------------------------------------------------

    def _iri(self) -> str:
        kind, text = self._next()
        if kind == "iri":
            return text[1:-1]
        if text == "a":
            return RDF_TYPE
        head, mark, tail = text.partition(":")
        if kind != "name" or not mark:
            raise SyntaxError(f"expected an IRI, found {text!r}")
        return self.prefixes[head] + tail

    def _term(self) -> tuple:
        """('var', name) or ('const', text, kind, datatype, lang)."""
        kind, text = self._peek()
        if kind == "var":
            self.at += 1
            return ("var", text[1:])
        if kind == "text":
            self.at += 1
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
            if self._peek()[0] == "lang":
                return ("const", value, "literal", None, self._next()[1][1:])
            if self._word("^^"):
                return ("const", value, "literal", self._iri(), None)
            return ("const", value, "literal", None, None)
        if kind == "number":
            self.at += 1
            return ("const", text, "literal", XSD + ("decimal" if "." in text else "integer"), None)
        if kind == "name" and text in ("true", "false"):
            self.at += 1
            return ("const", text, "literal", XSD + "boolean", None)
        return ("const", self._iri(), "iri", None, None)

    # -- patterns ---------------------------------------------------------------------------------

    def _triples(self) -> list[tuple]:
        """Patterns of one subject; a path of several steps goes by way of fresh variables."""
        out = []
        s = self._term()
        while True:
            path = [self._term() if self._peek()[0] == "var" else ("const", self._iri(), "iri", None, None)]
            while self._word("/"):
                path.append(("const", self._iri(), "iri", None, None))
            while True:
                o, start = self._term(), s
                for i, p in enumerate(path):
                    if i + 1 < len(path):
                        self.fresh += 1
                        end = ("var", f"_step{self.fresh}")
                    else:
                        end = o
                    out.append((start, p, end))
                    start = end
                if not self._word(","):
                    break
            more = False
            while self._word(";"):
                more = True
            if not more or self._peek()[1] in (".", "}"):
                return out

    def _match(self, triples: DataFrame, s: tuple, p: tuple, o: tuple) -> Solution:
        df, names = triples, []
        for column, t in zip("spo", (s, p, o), strict=True):
            if t[0] == "const":
                df = df.where(F.col(column) == t[1])
                if column == "o":
                    df = df.where(F.col("o_kind") == t[2])
                    # Plain strings and those typed as such are one.
                    own = F.coalesce("o_datatype", F.lit(XSD + "string"))
                    if t[4] is not None:
                        df = df.where(F.col("o_lang") == t[4])
                    elif t[2] == "literal":
                        df = df.where(F.col("o_lang").isNull() & (own == (t[3] or XSD + "string")))
        columns: list[Column] = []
        for column, t in zip("spo", (s, p, o), strict=True):
            if t[0] == "var":
                if t[1] in names:
                    first = "spo"[[x[1] if x[0] == "var" else None for x in (s, p, o)].index(t[1])]
                    df = df.where(F.col(column) == F.col(first))
                    continue
                names.append(t[1])
                kinds = ("o_kind", "o_datatype", "o_lang") if column == "o" else (F.lit("iri"), F.lit(None).cast("string"), F.lit(None).cast("string"))
                columns += [F.col(column).alias(t[1]), *((F.col(k) if isinstance(k, str) else k).alias(c) for k, c in zip(kinds, _columns(t[1])[1:], strict=True))]
        return Solution(df.select(*columns) if columns else df.select(F.lit(True).alias("_any")).limit(1), names)

    @staticmethod
    def _equal(a: Solution, renamed: DataFrame, shared: list[str], unbound: set[str]) -> list[Column]:
        """Conditions that the shared variables agree, language tags included; an unbound variable is compatible with any value."""
        out = []
        for x in shared:
            same = a.df[x] == renamed[f"{x}__r"]
            if f"{x}__l" in a.df.columns and f"{x}__l__r" in renamed.columns:
                same = same & a.df[f"{x}__l"].eqNullSafe(renamed[f"{x}__l__r"])
            out.append(same | a.df[x].isNull() | renamed[f"{x}__r"].isNull() if x in unbound else same)
        return out

    def _join(self, a: Solution | None, b: Solution, how: str = "inner", condition=None) -> Solution:
        if a is None:
            return b
        shared = [x for x in a.vars if x in b.vars]
        # Rows that leave a shared variable unbound are joined without it, so that both parts are joins on equal keys.
        split = next((x for x in shared if x in a.maybe), None)
        if split is not None:
            return self._both(*(self._join(part, b, how, condition) for part in self._by_bound(a, split)))
        split = next((x for x in shared if x in b.maybe), None) if how == "inner" else None
        if split is not None:
            return self._both(*(self._join(a, part, how, condition) for part in self._by_bound(b, split)))
        renamed = b.df.select(*(F.col(c).alias(f"{c}__r") for c in b.df.columns))
        both = self._equal(a, renamed, shared, b.maybe)
        if condition is not None:
            joined_vars = Solution(a.df, a.vars + [x for x in b.vars if x not in a.vars])
            both.append(condition(lambda c: a.df[c] if c in a.df.columns else renamed[f"{c}__r"], joined_vars))
        if not both:
            # Without a shared variable every pair is a solution, as the language has it.
            df = a.df.crossJoin(renamed) if how == "inner" else a.df.join(renamed, F.lit(True), how)
        else:
            df = a.df.join(renamed, reduce(lambda x, y: x & y, both), how)
        keep = [F.col(c) for c in a.df.columns] + [F.col(f"{c}__r").alias(c) for c in b.df.columns if c not in a.df.columns]
        new = [x for x in b.vars if x not in a.vars]
        return Solution(df.select(*keep), a.vars + new, a.maybe | {x for x in new if x in b.maybe or how == "left"})

    @staticmethod
    def _by_bound(a: Solution, x: str) -> tuple[Solution, Solution]:
        """The rows that bind a variable, and the others without it."""
        free = Solution(a.df.where(F.col(x).isNull()).drop(*_columns(x)), [v for v in a.vars if v != x], a.maybe - {x})
        return Solution(a.df.where(F.col(x).isNotNull()), a.vars, a.maybe - {x}), free

    @staticmethod
    def _both(a: Solution, b: Solution) -> Solution:
        return Solution(a.df.unionByName(b.df, allowMissingColumns=True), a.vars + [x for x in b.vars if x not in a.vars], a.maybe | b.maybe | (set(a.vars) ^ set(b.vars)))

    def _basic(self, now: Solution | None, patterns: list[tuple], triples: DataFrame) -> Solution | None:
        """Patterns joined to what is there: next comes one that shares a variable, that with the most constants first."""
        if not patterns:
            return now
        named = lambda t: [x[1] for x in t if x[0] == "var"]
        rest = sorted(patterns, key=lambda t: len(named(t)))
        written = [*(now.vars if now else []), *(x for t in patterns for x in named(t))]
        parts = [now] if now is not None else []
        while rest:
            meets = next((t for t in rest if parts and set(named(t)) & set(parts[-1].vars)), None)
            found = self._match(triples, *(meets or rest[0]))
            rest.remove(meets or rest[0])
            if meets:
                parts[-1] = self._join(parts[-1], found)
            else:
                parts.append(found)
        out = reduce(self._join, parts)
        return Solution(out.df, list(dict.fromkeys(written)), out.maybe)

    def _skip_group(self) -> None:
        depth = 0
        while True:
            text = self._next()[1]
            depth += (text == "{") - (text == "}")
            if not depth:
                return

    def _group(self, triples: DataFrame) -> tuple[Solution, list]:
        """A braced group: its solution without its filters, and those."""
        self._need("{")
        now: Solution | None = None
        filters: list[int] = []
        patterns: list[tuple] = []
        while True:
            if self._word("."):
                continue
            # Whatever isn't a pattern or a filter ends a run of patterns.
            if patterns and (self._peek()[1] in ("}", "{") or self._peek()[1].upper() in ("OPTIONAL", "BIND", "VALUES")):
                now, patterns = self._basic(now, patterns, triples), []
            if self._word("}"):
                break
            if self._word("OPTIONAL"):
                inner, own = self._group(triples)
                now = self._optional(now, inner, own, triples)
            elif self._word("FILTER"):
                # Filters hold for the whole group, so they are read again at its end.
                filters.append(self.at)
                self._pass_filter()
            elif self._word("BIND"):
                self._need("(")
                value = self._expression(self._scope(now))
                self._need("AS")
                name = self._next()[1][1:]
                self._need(")")
                now = self._bound(now, name, value)
            elif self._word("VALUES"):
                now = self._join(now, self._values(triples))
            elif self._peek()[1] == "{":
                part = self._filtered(*self._group(triples), triples)
                while self._word("UNION"):
                    other = self._filtered(*self._group(triples), triples)
                    names = part.vars + [x for x in other.vars if x not in part.vars]
                    maybe = part.maybe | other.maybe | (set(part.vars) ^ set(other.vars))
                    part = Solution(part.df.unionByName(other.df, allowMissingColumns=True), names, maybe)
                now = self._join(now, part)
            else:
                patterns += self._triples()
        if now is None:
            now = Solution(triples.sparkSession.range(1).select(F.lit(True).alias("_any")), [])
        return now, filters

    def _optional(self, now: Solution | None, inner: Solution, filters: list[int], triples: DataFrame) -> Solution:
        if now is None:
            now = Solution(triples.sparkSession.range(1).select(F.lit(True).alias("_any")), [])
        if not filters:
            return self._join(now, inner, "left")
        end = self.at

        def condition(column, joined: Solution) -> Column:
            out = F.lit(True)
            for f in filters:
                self.at = f
                out = out & self._expression(lambda name, part: column(_columns(name)[part])).text
            return out

        result = self._join(now, inner, "left", condition)
        self.at = end
        return result

    def _pass_filter(self) -> None:
        if self._word("NOT", "EXISTS"):
            self._word("EXISTS")
            self._skip_group()
            return
        if self._peek()[1] != "(":
            self._next()
        depth = 0
        while True:
            text = self._next()[1]
            depth += (text == "(") - (text == ")")
            if not depth:
                return

    def _filtered(self, now: Solution, filters: list[int], triples: DataFrame) -> Solution:
        end = self.at
        for f in filters:
            self.at = f
            word = self._word("NOT", "EXISTS")
            if word:
                if word == "NOT":
                    self._need("EXISTS")
                inner = self._filtered(*self._group(triples), triples)
                shared = [x for x in now.vars if x in inner.vars]
                if shared:
                    tags = [f"{x}__l" for x in shared if f"{x}__l" in inner.df.columns]
                    right = inner.df.select(*(F.col(c).alias(f"{c}__r") for c in (*shared, *tags))).distinct()
                    on = reduce(lambda x, y: x & y, self._equal(now, right, shared, now.maybe | inner.maybe))
                    df = now.df.join(right, on, "left_anti" if word == "NOT" else "left_semi")
                else:
                    # Without a shared variable the group holds for all rows or none.
                    df = now.df if inner.df.isEmpty() == (word == "NOT") else now.df.where(F.lit(False))
                now = Solution(df, now.vars, now.maybe)
            else:
                now = Solution(now.df.where(self._expression(self._scope(now)).text), now.vars, now.maybe)
        self.at = end
        return now

    def _values(self, triples: DataFrame) -> Solution:
        names = [self._next()[1][1:]] if self._peek()[0] == "var" else []
        single = bool(names)
        if not single:
            self._need("(")
            while not self._word(")"):
                names.append(self._next()[1][1:])
        self._need("{")
        rows = []
        while not self._word("}"):
            if single:
                rows.append([self._term()])
            else:
                self._need("(")
                row = []
                while not self._word(")"):
                    row.append(self._term())
                rows.append(row)
        data = [[x for t in row for x in t[1:]] for row in rows]
        return Solution(triples.sparkSession.createDataFrame(data, ", ".join(f"`{c}` string" for x in names for c in _columns(x))), names)

    def _bound(self, now: Solution, name: str, value: Value) -> Solution:
        none = F.lit(None).cast("string")
        text = F.when(value.text, "true").otherwise("false") if value.is_bool else value.text.cast("string")
        datatype = F.lit(XSD + "boolean") if value.is_bool else F.lit(XSD + "decimal") if value.is_number else value.datatype if value.datatype is not None else none
        new = [text.alias(name), F.lit("literal").alias(f"{name}__k"), datatype.alias(f"{name}__t"), (value.lang if value.lang is not None else none).alias(f"{name}__l")]
        return Solution(now.df.select("*", *new), [*now.vars, name], now.maybe | {name})

    # -- expressions ------------------------------------------------------------------------------

    @staticmethod
    def _scope(now: Solution):
        def column(name: str, part: int) -> Column:
            c = _columns(name)[part]
            return F.col(c) if c in now.df.columns else F.lit(None).cast("string")

        return column

    def _expression(self, scope) -> Value:
        left = self._and(scope)
        while self._word("||"):
            right = self._and(scope)
            left = Value(left.text | right.text, is_bool=True)
        return left

    def _and(self, scope) -> Value:
        left = self._relation(scope)
        while self._word("&&"):
            right = self._relation(scope)
            left = Value(left.text & right.text, is_bool=True)
        return left

    def _relation(self, scope) -> Value:
        left = self._sum(scope)
        word = self._word("=", "!=", "<", ">", "<=", ">=", "IN", "NOT")
        if word in ("IN", "NOT"):
            if word == "NOT":
                self._need("IN")
            self._need("(")
            hits = F.lit(False)
            while not self._word(")"):
                hits = hits | self._compare("=", left, self._sum(scope))
                self._word(",")
            return Value(~hits if word == "NOT" else hits, is_bool=True)
        return Value(self._compare(word, left, self._sum(scope)), is_bool=True) if word else left

    @staticmethod
    def _compare(op: str, a: Value, b: Value) -> Column:
        do = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if a.is_bool or b.is_bool:
            truth = lambda v: v.text if v.is_bool else v.text == "true"
            return do(truth(a), truth(b))
        if a.is_number and b.is_number:
            return do(a.text, b.text)
        numeric = F.lit(True)
        for v in (a, b):
            numeric = numeric & (F.lit(v.is_number) if v.datatype is None else v.datatype.isin(*_NUMERIC))
        return F.when(F.coalesce(numeric, F.lit(False)), do(a.number(), b.number())).otherwise(do(a.text.cast("string"), b.text.cast("string")))

    def _sum(self, scope) -> Value:
        left = self._product(scope)
        while word := self._word("+", "-"):
            right = self._product(scope)
            left = Value(left.number() + right.number() if word == "+" else left.number() - right.number(), is_number=True)
        return left

    def _product(self, scope) -> Value:
        left = self._unary(scope)
        while word := self._word("*", "/"):
            right = self._unary(scope)
            left = Value(left.number() * right.number() if word == "*" else left.number() / right.number(), is_number=True)
        return left

    def _unary(self, scope) -> Value:
        if self._word("!"):
            return Value(~self._unary(scope).text, is_bool=True)
        if self._word("("):
            out = self._expression(scope)
            self._need(")")
            return out
        kind, text = self._peek()
        if kind == "name" and self._peek(1)[1] == "(" and ":" not in text:
            self.at += 2
            return self._call(text.upper(), scope)
        t = self._term()
        if t[0] == "var":
            return Value(scope(t[1], 0), scope(t[1], 2), scope(t[1], 3))
        _, value, _, datatype, lang = t
        if datatype == XSD + "boolean":
            return Value(F.lit(value == "true"), is_bool=True)
        if datatype in _NUMERIC:
            return Value(F.lit(float(value)), is_number=True)
        return Value(F.lit(value), F.lit(datatype).cast("string"), F.lit(lang).cast("string"))

    def _call(self, name: str, scope) -> Value:
        distinct = bool(self._word("DISTINCT"))
        arguments: list[Value] = []
        separator = " "
        star = name == "COUNT" and bool(self._word("*"))
        while not self._word(")"):
            if self._word(";"):
                self._need("SEPARATOR")
                self._need("=")
                separator = self._term()[1]
                continue
            if name == "BOUND":
                arguments.append(Value(scope(self._next()[1][1:], 0)))
                continue
            arguments.append(self._expression(scope))
            self._word(",")
        a = arguments
        text = [x.text.cast("string") if not x.is_bool else F.when(x.text, "true").otherwise("false") for x in a]
        if name == "COUNT":
            return Value(F.count("*") if star else F.count_distinct(text[0]) if distinct else F.count(text[0]), is_number=True)
        if name in ("SUM", "AVG", "MIN", "MAX"):
            return Value({"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](a[0].number()), is_number=True)
        if name == "SAMPLE":
            return Value(F.min(text[0]))
        if name == "GROUP_CONCAT":
            return Value(F.array_join(F.array_sort(F.collect_set(text[0]) if distinct else F.collect_list(text[0])), separator))
        if name == "COALESCE":
            return Value(F.coalesce(*text), reduce(lambda x, y: F.coalesce(x, y), [x.datatype for x in a if x.datatype is not None], F.lit(None).cast("string")))
        if name == "IF":
            return Value(F.when(a[0].text, text[1]).otherwise(text[2]))
        if name == "BOUND":
            return Value(a[0].text.isNotNull(), is_bool=True)
        if name == "STR":
            return Value(text[0])
        if name == "LANG":
            return Value(F.coalesce(a[0].lang, F.lit("")) if a[0].lang is not None else F.lit(""))
        if name == "STRLEN":
            return Value(F.length(text[0]), is_number=True)
        if name == "CONCAT":
            return Value(F.concat(*text))
        if name in ("STRAFTER", "STRBEFORE"):
            at = F.instr(text[0], text[1])
            part = F.substring(text[0], at + F.length(text[1]), F.length(text[0])) if name == "STRAFTER" else F.substring(text[0], F.lit(1), at - 1)
            return Value(F.when(at > 0, part).otherwise(""))
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return Value({"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](text[0], text[1]), is_bool=True)
        if name in ("LCASE", "UCASE"):
            return Value((F.lower if name == "LCASE" else F.upper)(text[0]))
        if name == "REGEX":
            return Value(F.regexp_like(text[0], text[1]), is_bool=True)
        raise SyntaxError(f"unknown function {name}")

    # -- the query --------------------------------------------------------------------------------

    def rows(self, triples: DataFrame) -> DataFrame:
        self.at = 0
        while self._word("PREFIX"):
            name = self._next()[1]
            self.prefixes[name.rstrip(":")] = self._next()[1][1:-1]
        self._need("SELECT")
        distinct = bool(self._word("DISTINCT"))
        head = self.at
        while self._peek()[1] not in ("{",) and self._peek()[1].upper() != "WHERE":
            self._next()
        self._word("WHERE")
        now = self._filtered(*self._group(triples), triples)
        tail = self.at

        keys: list[str] | None = None
        if self._word("GROUP"):
            self._need("BY")
            keys = []
            while self._peek()[0] == "var":
                keys.append(self._next()[1][1:])
        scope = self._scope(now)
        having = None
        if self._word("HAVING"):
            having = self._unary(scope)
        orders: list[tuple[bool, Value | str]] = []
        if self._word("ORDER"):
            self._need("BY")
            while True:
                down = self._word("ASC", "DESC")
                kind, text = self._peek()
                if not down and kind != "var" and text != "(":
                    break
                inside = bool(self._word("(")) if down else False
                if self._peek()[0] == "var" and (not inside or self._peek(1)[1] == ")"):
                    orders.append((down == "DESC", self._next()[1][1:]))
                else:
                    orders.append((down == "DESC", self._expression(scope)))
                if inside:
                    self._need(")")
        limit = offset = None
        while word := self._word("LIMIT", "OFFSET"):
            if word == "LIMIT":
                limit = int(self._next()[1])
            else:
                offset = int(self._next()[1])
        if self._peek()[0] != "end":
            raise SyntaxError(f"unexpected {self._peek()[1]!r}")

        self.at = head
        outputs: list[tuple[str, Value]] = []
        while self.at < tail and self._peek()[1] != "{" and self._peek()[1].upper() != "WHERE":
            if self._word("*"):
                outputs += [(x, Value(F.col(x), scope(x, 2))) for x in now.vars if not x.startswith("_step")]
            elif self._word("("):
                value = self._expression(scope)
                self._need("AS")
                outputs.append((self._next()[1][1:], value))
                self._need(")")
            else:
                name = self._next()[1][1:]
                outputs.append((name, Value(scope(name, 0), scope(name, 2))))
        grouped = keys is not None
        if not grouped and any(self._aggregates(v.text) for _, v in outputs):
            grouped, keys = True, []

        names = [n for n, _ in outputs]
        sort_values = [(down, v) for down, v in orders]
        extra = []
        for i, (_, v) in enumerate(sort_values):
            if isinstance(v, str) and v in names:
                continue
            value = Value(scope(v, 0), scope(v, 2)) if isinstance(v, str) else v
            extra.append((f"_order{i}", value))
        if grouped:
            plain = lambda v, n: v.text if self._aggregates(v.text) else F.first(v.text) if n not in keys else F.col(n)
            aggregated = [(plain(v, n)).alias(f"_out_{n}") for n, v in outputs if n not in keys] + [(v.text if self._aggregates(v.text) else F.first(v.text)).alias(n) for n, v in extra]
            types = [F.first(v.datatype).alias(f"_type_{n}") for n, v in [*outputs, *extra] if v.datatype is not None and n not in keys and not v.is_number]
            if having is not None:
                aggregated.append(having.text.alias("_having"))
            df = now.df.groupBy(*keys).agg(*(aggregated + types)) if aggregated + types else now.df.select(*keys).distinct()
            if having is not None:
                df = df.where("_having")
            df = df.select(*(F.col(n) if n in keys else F.col(f"_out_{n}").alias(n) for n in names), *(n for n, _ in extra))
            typed: dict[str, Column] = {}
        else:
            shown = [(F.when(v.text, "true").otherwise("false") if v.is_bool else v.text).alias(n) for n, v in outputs]
            typed = {n: v.datatype for n, v in [*outputs, *extra] if v.datatype is not None}
            df = now.df.select(*shown, *(v.text.alias(n) for n, v in extra), *(c.alias(f"_type_{n}") for n, c in typed.items()))
        if distinct:
            df = df.select(*names).distinct()
        if sort_values:
            sort = []
            for i, (down, v) in enumerate(sort_values):
                name = v if isinstance(v, str) and v in names else f"_order{i}"
                # Numbers sort by value, before it the kind decides; other terms by their text.
                if f"_type_{name}" in df.columns:
                    numeric = F.when(F.col(f"_type_{name}").isin(*_NUMERIC), F.col(name).try_cast("double"))
                    sort.append(numeric.desc() if down else numeric.asc())
                sort.append(F.col(name).desc() if down else F.col(name).asc())
            df = df.orderBy(*sort, *(n for n in names))
        if offset is not None:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return df.select(*names)

    @staticmethod
    def _aggregates(c: Column) -> bool:
        return re.search(r"(?i)\b(count|sum|avg|min|max|collect_set|collect_list|first)\(", str(c)) is not None


def run_query(text: str, triples: DataFrame) -> DataFrame:
    """The rows of a SPARQL SELECT on a triple table."""
    return Query(text).rows(triples)


def run_queries(texts: dict[str, str], triples: DataFrame) -> dict[str, DataFrame]:
    """Each query's rows as text, unbound values as ''; the triples should be stored or cached, as each query reads them."""
    from ..sources.tables import as_strings

    return {name: as_strings(run_query(text, triples)) for name, text in texts.items()}
