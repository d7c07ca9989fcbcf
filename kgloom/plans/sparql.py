"""A text front-end for the algebra: SPARQL SELECT, ASK, CONSTRUCT and updates compiled to DataFrames.

Text is tokenised, parsed by recursive descent into a small tree, and each node of the tree becomes one operation of
``operators.algebra``; Catalyst plans the result as one query.  Values are compared by lexical form, and as numbers
where both sides of a comparison are numbers.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import algebra as A
from ..session import store
from ..sources import clients

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


class QueryError(ValueError):
    """The query text isn't one that this front-end can compile; the message says where."""


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<tag>@[A-Za-z][\w-]*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!*+/|^?\[\]-])|(?P<name>[A-Za-z_][\w-]*:[\w.-]*[\w-]|:[\w-]+|(?:[A-Za-z_][\w-]*)?:|[A-Za-z_]\w*)""",
    re.X,
)
_PREFIX = re.compile(r"\bPREFIX\s+([A-Za-z][\w-]*)?\s*:\s*<([^>]*)>", re.I)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def query_prefixes(text: str) -> dict[str, str]:
    """The prefixes that a query declares."""
    return {p: n for p, n in _PREFIX.findall(text)}


@dataclass
class Group:
    """A group pattern: its parts in the order they are written."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Update:
    """One operation of a request: quads to delete and to insert for all solutions, or a graph to drop."""

    delete: list[tuple[str, str, str, str]] = field(default_factory=list)
    insert: list[tuple[str, str, str, str]] = field(default_factory=list)
    where: Group | None = None
    graph: str | None = None
    drop: str | None = None


@dataclass
class Query:
    form: str
    where: Group
    select: list[tuple] = field(default_factory=list)
    distinct: bool = False
    group: list[str] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[tuple[str, str, str, str]] = field(default_factory=list)


# ---- parsing --------------------------------------------------------------------------------------------------


class _Parser:
    def __init__(self, text: str, aliases: Mapping[str, str]):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if found.lastgroup:
                self.tokens.append((found.lastgroup, found[0], at))
            at = found.end()
        self.tokens.append(("end", "", at))
        self.i, self.prefixes, self.aliases, self.fresh = 0, {}, aliases, 0

    # tokens
    def peek(self, *words: str) -> bool:
        return self.tokens[self.i][1].upper() in words and self.tokens[self.i][0] in ("op", "name")

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail(f"expected {word}")

    def fail(self, what: str):
        kind, text, at = self.tokens[self.i]
        raise QueryError(f"{what}, found {text or kind!r} at {at}")

    def next(self, *kinds: str) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind not in kinds:
            self.fail(f"expected {' or '.join(kinds)}")
        self.i += 1
        return text

    # terms
    def iri(self) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind == "iri":
            self.i += 1
            return text[1:-1]
        if kind == "name" and ":" in text:
            self.i += 1
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + local
        return self.fail("expected an IRI")

    def term(self) -> str:
        """A variable as ``?name``, else the lexical form of the term."""
        kind, text, _ = self.tokens[self.i]
        if kind == "var":
            self.i += 1
            return "?" + text[1:]
        if kind == "str":
            self.i += 1
            if self.tokens[self.i][0] == "tag":
                self.i += 1
            elif self.take("^^"):
                self.iri()
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1])
        if kind == "num":
            self.i += 1
            return text
        if self.peek("TRUE", "FALSE"):
            return self.next("name").lower()
        return self.iri()

    def variable(self) -> str:
        return self.next("var")[1:]

    # paths
    def path(self) -> tuple:
        out = self.sequence()
        while self.take("|"):
            out = ("alt", out, self.sequence())
        return out

    def sequence(self) -> tuple:
        out = self.step()
        while self.take("/"):
            out = ("seq", out, self.step())
        return out

    def step(self) -> tuple:
        if self.take("^"):
            return ("inv", self.step())
        if self.take("("):
            out = self.path()
            self.need(")")
        elif self.tokens[self.i][0] == "var":
            return ("var", self.term())
        elif self.tokens[self.i][1] == "a" and self.tokens[self.i][0] == "name":
            self.i += 1
            out = ("iri", self.aliases.get("a", RDF_TYPE))
        else:
            out = ("iri", self.iri())
        for mark, kind in (("*", "star"), ("+", "plus"), ("?", "maybe")):
            if self.take(mark):
                return (kind, out)
        return out

    # groups
    def group(self) -> Group:
        self.need("{")
        out = Group()
        while not self.take("}"):
            if self.take("OPTIONAL"):
                out.parts.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.parts.append(("minus", self.group()))
            elif self.take("GRAPH"):
                name = self.term()
                out.parts.append(("graph", name, self.group()))
            elif self.take("SERVICE"):
                silent = self.take("SILENT")
                out.parts.append(("service", self.iri(), self.group(), silent))
            elif self.take("FILTER"):
                if self.peek("NOT", "EXISTS"):
                    negated = self.take("NOT")
                    self.need("EXISTS")
                    out.parts.append(("exists", self.group(), negated))
                else:
                    out.parts.append(("filter", self.primary()))
            elif self.take("BIND"):
                self.need("(")
                value = self.expression()
                self.need("AS")
                out.parts.append(("bind", value, self.variable()))
                self.need(")")
            elif self.take("VALUES"):
                out.parts.append(self.data())
            elif self.peek("{"):
                if self.tokens[self.i + 1][1].upper() == "SELECT":
                    self.i += 1
                    out.parts.append(("sub", self.select()))
                    self.need("}")
                else:
                    branches = [self.group()]
                    while self.take("UNION"):
                        branches.append(self.group())
                    out.parts.append(("union", branches))
            else:
                self.triples(out)
            self.take(".")
        return out

    def triples(self, out: Group) -> None:
        subject = self.term()
        while True:
            path = self.path()
            while True:
                out.parts.append(("triple", subject, path, self.term()))
                if not self.take(","):
                    break
            if not self.take(";") or self.peek(".", "}"):
                return

    def data(self) -> tuple:
        many = self.take("(")
        names = []
        while self.tokens[self.i][0] == "var":
            names.append(self.variable())
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            row = []
            if many:
                self.need("(")
            while not (many and self.take(")")):
                row.append(None if self.take("UNDEF") else self.term())
                if not many:
                    break
            rows.append(row)
        return ("values", names, rows)

    # expressions
    def primary(self) -> tuple:
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        kind, text, _ = self.tokens[self.i]
        if kind == "name" and ":" not in text and self.tokens[self.i + 1][1] == "(":
            self.i += 2
            name, arguments = text.upper(), []
            distinct = self.take("DISTINCT")
            while not self.take(")"):
                arguments.append(("star",) if self.take("*") else self.expression())
                self.take(",")
            return ("call", name, arguments, distinct)
        if kind == "num":
            self.i += 1
            return ("num", float(text) if re.search("[.eE]", text) else int(text))
        term = self.term()
        return ("var", term[1:]) if term.startswith("?") else ("text", term)

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("arith", "-", ("num", 0), self.unary())
        return self.primary()

    def binary(self, level: int = 0) -> tuple:
        levels = [("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/")]
        if level == len(levels):
            return self.unary()
        out = self.binary(level + 1)
        while True:
            if level == 2 and self.peek("NOT", "IN"):
                negated = self.take("NOT")
                self.need("IN")
                self.need("(")
                items = []
                while not self.take(")"):
                    items.append(self.expression())
                    self.take(",")
                out = ("in", out, items, negated)
                continue
            op = next((o for o in levels[level] if self.take(o)), None)
            if op is None:
                return out
            out = (("or", "and", "cmp", "arith", "arith")[level], op, out, self.binary(level + 1))

    expression = binary

    # queries
    def prologue(self) -> None:
        while self.take("PREFIX"):
            name = self.next("name")
            self.prefixes[name.rstrip(":")] = self.next("iri")[1:-1]

    def quads(self, graph: str = "") -> list[tuple[str, str, str, str]]:
        """The quads (g, s, p, o) of a template; without a graph of their own they belong to ``graph``."""
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("GRAPH"):
                out += self.quads(self.term())
            else:
                part = Group()
                self.triples(part)
                for _, s, path, o in part.parts:
                    if path[0] not in ("iri", "var"):
                        self.fail("a template holds no paths")
                    out.append((graph, s, path[1], o))
            self.take(".")
        return out

    def updates(self) -> list[Update]:
        """The operations of a request, parted by semicolons."""
        out = []
        self.prologue()
        while self.tokens[self.i][0] != "end":
            out.append(self.operation())
            if self.tokens[self.i][0] != "end":
                self.need(";")
            self.prologue()
        return out

    def operation(self) -> Update:
        if self.take("DROP") or self.take("CLEAR"):
            self.take("SILENT")
            self.need("GRAPH")
            return Update(drop=self.iri())
        out = Update()
        if self.take("WITH"):
            out.graph = self.iri()
        if self.peek("INSERT", "DELETE") and self.tokens[self.i + 1][1].upper() == "DATA":
            kind = self.next("name").lower()
            self.i += 1
            data = self.quads()
            if any(x.startswith("?") for row in data for x in row):
                self.fail("data has no variables")
            setattr(out, kind, data)
            return out
        if self.take("DELETE"):
            if self.take("WHERE"):
                at = self.i
                out.delete = self.quads()
                self.i = at
                out.where = self.group()
                return out
            out.delete = self.quads()
        if self.take("INSERT"):
            out.insert = self.quads()
        if not out.delete and not out.insert:
            self.fail("expected an update")
        self.need("WHERE")
        out.where = self.group()
        return out

    def query(self) -> Query:
        self.prologue()
        if self.take("ASK"):
            self.take("WHERE")
            out = Query("ask", self.group())
        elif self.take("CONSTRUCT"):
            if self.take("WHERE"):
                at = self.i
                template = self.quads()
                self.i = at
            else:
                template = self.quads()
                self.take("WHERE")
            out = Query("construct", self.group(), template=template)
            if self.take("LIMIT"):
                out.limit = int(self.next("num"))
        else:
            out = self.select()
        if self.tokens[self.i][0] != "end":
            self.fail("expected the end")
        return out

    def select(self) -> Query:
        self.need("SELECT")
        distinct = self.take("DISTINCT") or self.take("REDUCED")
        items: list[tuple] = []
        if not self.take("*"):
            while self.tokens[self.i][0] == "var" or self.peek("("):
                if self.take("("):
                    value = self.expression()
                    self.need("AS")
                    items.append((value, self.variable()))
                    self.need(")")
                else:
                    name = self.variable()
                    items.append((("var", name), name))
            if not items:
                self.fail("expected variables")
        self.take("WHERE")
        out = Query("select", self.group(), items, distinct)
        while True:
            if self.take("GROUP"):
                self.need("BY")
                while self.tokens[self.i][0] == "var":
                    out.group.append(self.variable())
            elif self.take("HAVING"):
                out.having.append(self.primary())
            elif self.take("ORDER"):
                self.need("BY")
                while self.tokens[self.i][0] == "var" or self.peek("ASC", "DESC", "("):
                    down = self.take("DESC")
                    self.take("ASC")
                    out.order.append((self.primary(), down))
            elif self.take("LIMIT"):
                out.limit = int(self.next("num"))
            elif self.take("OFFSET"):
                out.offset = int(self.next("num"))
            else:
                return out


def parse(text: str, aliases: Mapping[str, str] | None = None) -> Query:
    return _Parser(text, aliases or {}).query()


# ---- compiling ------------------------------------------------------------------------------------------------

_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class _Compiler:
    """``triples`` (s, p, o, and g where there are several graphs) are what a group sees; ``graph`` is the term of the
    GRAPH part that it stands in."""

    def __init__(self, triples: DataFrame, graph: str | None = None, services: Mapping[str, Service] | None = None, labels: Sequence[str] = ()):
        self.triples, self.graph, self.fresh, self.services, self.labels = triples, graph, 0, services or {}, labels

    def inside(self, graph: str) -> _Compiler:
        if "g" not in self.triples.columns:
            return self
        out = _Compiler(self.triples, graph, self.services, self.labels)
        out.fresh = self.fresh + 1000
        return out

    def variable(self) -> str:
        self.fresh += 1
        return f"?__{self.fresh}"

    def edge(self, path: tuple, s: str, o: str) -> DataFrame:
        """Solutions of one path between two terms."""
        kind = path[0]
        if kind in ("iri", "var"):
            return A.pattern(self.triples, s, path[1], o, self.graph)
        if kind == "inv":
            return self.edge(path[1], o, s)
        if kind == "seq":
            middle = self.variable()
            return A.natural_join(self.edge(path[1], s, middle), self.edge(path[2], middle, o)).drop(middle[1:])
        if kind == "alt":
            return A.union(self.edge(path[1], s, o), self.edge(path[2], s, o))
        if self.graph is not None and self.graph.startswith("?"):
            raise QueryError("a path of any length needs the name of its graph")
        # Closures: pairs of all nodes that the inner path links, started at the subject's side.
        pairs = self.edge(path[1], "?src", "?dst").select("src", "dst").distinct()
        seeds = pairs.select(F.col("src").alias("start"))
        if kind != "plus":
            seeds = seeds.union(pairs.select("dst"))
        if not s.startswith("?"):
            seeds = self.triples.sparkSession.createDataFrame([(s,)], "start string")
        seeds = seeds.distinct()
        if kind == "maybe":
            closed = seeds.select("start", F.col("start").alias("node")).union(pairs).distinct()
        else:
            closed = (A.path_plus if kind == "plus" else A.path_star)(pairs, seeds, store)
        return A.pattern(closed.select(F.col("start").alias("s"), F.lit("").alias("p"), F.col("node").alias("o")), s, "", o)

    def group(self, group: Group) -> DataFrame:
        out: DataFrame | None = None
        filters: list[tuple] = []
        pending = [(t, self.edge(t[2], t[1], t[3])) for t in group.parts if t[0] == "triple"]

        def join(right: DataFrame) -> None:
            nonlocal out
            out = right if out is None else A.natural_join(out, right)

        # Triples that share variables are joined next to each other.
        while pending:
            i = next((i for i, (_, x) in enumerate(pending) if out is not None and set(x.columns) & set(out.columns)), 0)
            join(pending.pop(i)[1])
        for part in group.parts:
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
            elif kind == "union":
                join(A.union(*[self.group(g) for g in part[1]]))
            elif kind == "sub":
                join(self.select(part[1]))
            elif kind == "graph":
                join(self.inside(part[1]).group(part[2]))
            elif kind == "values":
                if out is None:
                    out = self.triples.sparkSession.createDataFrame([tuple(r) for r in part[2]], ", ".join(f"`{n}` string" for n in part[1]))
                else:
                    out = A.values(out, part[1], part[2])
        if out is None:
            out = self.triples.sparkSession.range(1).select()
        for part in group.parts:
            if part[0] == "optional":
                inner = Group([p for p in part[1].parts if p[0] != "filter"])
                right = self.group(inner)
                condition = None
                if tests := [p[1] for p in part[1].parts if p[0] == "filter"]:
                    # A variable may stand on either side: the optional side's own ones are not renamed.
                    condition = reduce(lambda a, b: a & b, [self.value(t) for t in tests])
                out = A.optional(out, right, condition)
            elif part[0] == "minus":
                out = A.minus(out, self.group(part[1]))
            elif part[0] == "exists":
                out = A.exists(out, self.group(part[1]), part[2])
            elif part[0] == "bind":
                out = out.withColumn(part[2], self.value(part[1]))
        # Services come last, with what the rest of the group has bound.
        for part in group.parts:
            if part[0] == "service":
                out = self.bound(out, part[1], part[2], part[3])
        for test in filters:
            out = out.where(self.value(test))
        return out

    def bound(self, out: DataFrame, name: str, group: Group, silent: bool) -> DataFrame:
        """A bind join: the distinct values of the variables that a service needs go to it, and its answers join back.

        A label service needs every variable ``x`` of which ``xLabel`` is asked for, and leaves out no solution.
        """
        service = self.services.get(name)
        if service is None:
            if silent:
                return out
            raise QueryError(f"no client for the service {name}")
        if isinstance(service, LabelService):
            said = {t[2][1]: t[3] for t in group.parts if t[0] == "triple" and t[2][0] == "iri"}
            languages = next((o.split(",") for p, o in said.items() if p.endswith("language")), ["en"])
            for x in (v for v in self.labels if v in out.columns):
                values = store(out.select(F.col(f"`{x}`").alias("item")).where("item is not null").distinct())
                found = service.answers(values, [c.strip() for c in languages]).select(F.col("item").alias(x), F.coalesce("label", "item").alias(f"{x}Label"))
                out = A.natural_join(out, found, "left")
            return out
        names = list(dict.fromkeys(v for part in group.parts if part[0] == "triple" for v in _variables(part)))
        shared = [v for v in names if v in out.columns]
        if not shared:
            raise QueryError(f"the service {name} shares no variable with the pattern around it")
        return A.natural_join(out, service(store(out.select(*shared).distinct()), group).select(*names))

    def value(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "var":
            return F.col(f"`{e[1]}`")
        if kind in ("text", "num"):
            return F.lit(e[1])
        if kind == "not":
            return ~self.value(e[1])
        if kind == "and":
            return self.value(e[2]) & self.value(e[3])
        if kind == "or":
            return self.value(e[2]) | self.value(e[3])
        if kind == "in":
            found = reduce(lambda a, b: a | b, [self.compare("=", e[1], x) for x in e[2]], F.lit(False))
            return ~found if e[3] else found
        if kind == "cmp":
            return self.compare(e[1], e[2], e[3])
        if kind == "arith":
            a, b = (self.value(x).cast("double") for x in e[2:])
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]]
        return self.call(e[1], e[2], e[3])

    def compare(self, op: str, x: tuple, y: tuple) -> Column:
        a, b = self.value(x), self.value(y)
        if "num" in (x[0], y[0]):
            a, b = a.try_cast("double"), b.try_cast("double")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def call(self, name: str, arguments: list[tuple], distinct: bool = False) -> Column:
        if name in _AGGREGATES:
            return self.aggregate(name, arguments, distinct)
        a = [self.value(x) for x in arguments]
        calls = {
            "BOUND": lambda: a[0].isNotNull(), "STR": lambda: a[0].cast("string"), "IF": lambda: F.when(a[0], a[1]).otherwise(a[2]), "COALESCE": lambda: F.coalesce(*a),
            "STRLEN": lambda: F.length(a[0]), "LCASE": lambda: F.lower(a[0]), "UCASE": lambda: F.upper(a[0]), "CONCAT": lambda: F.concat(*a), "CONTAINS": lambda: F.contains(a[0], a[1]),
            "STRSTARTS": lambda: F.startswith(a[0], a[1]), "STRENDS": lambda: F.endswith(a[0], a[1]), "ABS": lambda: F.abs(a[0].cast("double")),
            "ISIRI": lambda: a[0].rlike(r"^[A-Za-z][\w+.\-]*:"), "REGEX": lambda: F.regexp_like(a[0], F.concat(F.lit("(?i)"), a[1]) if len(a) > 2 else a[1]),
        }
        if name not in calls:
            raise QueryError(f"unknown function {name}")
        return calls[name]()

    def aggregate(self, name: str, arguments: list[tuple], distinct: bool) -> Column:
        if name == "COUNT":
            if arguments[0] == ("star",):
                return F.count(F.lit(1))
            return F.count_distinct(self.value(arguments[0])) if distinct else F.count(self.value(arguments[0]))
        x = self.value(arguments[0])
        if name == "GROUP_CONCAT":
            return F.array_join(F.array_sort(F.collect_set(x) if distinct else F.collect_list(x)), " ")
        if name in ("SUM", "AVG"):
            number = x.try_cast("double")
            return {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[name](number)
        return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[name](x)

    def select(self, q: Query) -> DataFrame:
        out = self.group(q.where)
        aggregated = q.group or any(_has_aggregate(e) for e, _ in q.select)
        if aggregated:
            cells = [self.value(e).alias(n) for e, n in q.select if not (e[0] == "var" and e[1] in q.group)]
            out = out.groupBy(*[F.col(f"`{g}`") for g in q.group]).agg(*cells) if cells else out.select(*q.group).distinct()
            for test in q.having:
                out = out.where(self.value(test))
        else:
            for e, n in q.select:
                if e != ("var", n):
                    out = out.withColumn(n, self.value(e))
        names = [n for _, n in q.select] or sorted(c for c in out.columns if not c.startswith("__"))
        for n in names:
            if n not in out.columns:
                out = out.withColumn(n, F.lit(None).cast("string"))
        if q.order and not q.distinct:
            out = out.orderBy(*[self.value(e).desc() if down else self.value(e).asc() for e, down in q.order])
        out = out.select(*[F.col(f"`{n}`") for n in names])
        if q.distinct:
            out = out.distinct()
            if q.order:
                out = out.orderBy(*[self.value(e).desc() if down else self.value(e).asc() for e, down in q.order])
        if q.offset:
            out = out.offset(q.offset)
        return out.limit(q.limit) if q.limit is not None else out


def _has_aggregate(e: tuple) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("call",) and e[1] in _AGGREGATES or any(_has_aggregate(x) for x in e if isinstance(x, tuple)) or any(_has_aggregate(y) for x in e if isinstance(x, list) for y in x))


#: What answers a SERVICE part: a function from the distinct bindings (a column for each shared variable) and the
#: part's group to solutions of all of the group's variables.
Service = Callable[[DataFrame, Group], DataFrame]


@dataclass(frozen=True)
class LabelService:
    """Names of things: ``answers`` maps (item) and languages, the preferred one first, to (item, label)."""

    answers: Callable[[DataFrame, list[str]], DataFrame]


def service_over(triples: DataFrame) -> Service:
    """A service that answers from a table: the group's solutions there that agree with the bindings."""

    def run(bindings: DataFrame, group: Group) -> DataFrame:
        return A.natural_join(_Compiler(triples.select("s", "p", "o")).group(group), bindings)

    return run


def labels_over(labels: DataFrame) -> LabelService:
    """Labels from a table (item, lang, label): of the preferred language that an item has, the smallest label."""

    def answers(items: DataFrame, languages: list[str]) -> DataFrame:
        place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
        best = items.join(labels, "item").where(place > 0).groupBy("item").agg(F.min(F.struct(place.alias("place"), "label")).getField("label").alias("label"))
        return items.join(best, "item", "left")

    return LabelService(answers)


def labels_from(call: Callable[[list[str]], list], folder: str, **limits) -> LabelService:
    """Labels from a client that gets lines of an item and the languages, parted by tabs, and answers with a label or None.

    Answers are kept in ``folder`` (``clients.ask_stored``), so nothing is asked twice, and what stays unanswered has no
    label.
    """

    def answers(items: DataFrame, languages: list[str]) -> DataFrame:
        asked = items.withColumn("input", F.concat_ws("\t", "item", F.lit(",".join(languages))))
        return asked.join(clients.ask_stored(asked, "input", call, "string", folder, **limits), "input", "left").select("item", F.col("answer").alias("label"))

    return LabelService(answers)


def _variables(part: tuple) -> list[str]:
    """The variables of a triple part."""
    terms = [part[1], part[3], *([part[2][1]] if part[2][0] == "var" else [])]
    return [t[1:] for t in terms if isinstance(t, str) and t.startswith("?")]


def run(text: str, triples: DataFrame, aliases: Mapping[str, str] | None = None, graph: str | None = None, services: Mapping[str, Service | LabelService] | None = None) -> DataFrame:
    """The solutions of a SELECT query, one row ``answer`` for ASK, or the triples of a CONSTRUCT, over ``triples``.

    These are (s, p, o), or (g, s, p, o) with ``graph`` as the one graph that the query is pinned to: other graphs that
    it names have no triples.  ``aliases`` may say which predicate ``a`` stands for.  ``services`` answer SERVICE parts by
    their IRI; one without a client is an error, or with SILENT adds nothing.  Raises ``QueryError`` for a text
    that can't be compiled.
    """
    query = parse(text, aliases)
    if graph is not None:
        triples = A.pinned(triples, graph)
    labels = list(dict.fromkeys(re.findall(r"[?$](\w+)Label\b", text)))
    compiler = _Compiler(triples.select("s", "p", "o", *(["g"] if "g" in triples.columns else [])), services=services, labels=labels)
    if query.form == "ask":
        return A.ask(compiler.group(query.where))
    if query.form == "construct":
        made = A.construct(compiler.group(query.where), [row[1:] for row in query.template])
        return made.limit(query.limit) if query.limit is not None else made
    return compiler.select(query)


def update(text: str, quads: DataFrame, keep: Callable[[DataFrame], DataFrame], aliases: Mapping[str, str] | None = None, graph: str = "") -> DataFrame:
    """``quads`` (g, s, p, o) after all operations of a request, in turn; ``graph`` is the default graph.

    ``keep`` cuts the lineage after each operation.  The result is returned as a whole, so nothing is written if an
    operation can't be compiled.
    """
    operations = _Parser(text, aliases or {}).updates()
    out = quads.select("g", "s", "p", "o").distinct()
    for operation in operations:
        if operation.drop is not None:
            out = keep(A.drop_graph(out, operation.drop))
            continue
        default = operation.graph or graph
        named = lambda rows, g=default: [(r[0] or g, *r[1:]) for r in rows]
        if operation.where is None:
            solutions = quads.sparkSession.range(1)
        else:
            solutions = keep(_Compiler(out, default).group(operation.where))
        if operation.delete:
            out = A.delete_data(out, A.construct_quads(solutions, named(operation.delete)))
        if operation.insert:
            out = A.insert_data(out, A.construct_quads(solutions, named(operation.insert)))
        out = keep(out)
    return out


class QueryTimeout(TimeoutError):
    """A query took longer than it may."""


def within(df: DataFrame, seconds: float, action: Callable[[DataFrame], object] = DataFrame.collect) -> object:
    """The result of ``action`` on ``df``; ``QueryTimeout`` and cancelled jobs after ``seconds``."""
    context = df.sparkSession.sparkContext
    group, late = f"query-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return action(df)
    except Exception as error:
        if late.is_set():
            raise QueryTimeout(f"no answer in {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
