"""Canonical structure of SQL SELECT statements, compared without a catalog and without running them.

A statement is lexed by one pattern, read by an operator-precedence parser and rewritten into nested lists whose JSON is the signature.
Equal signatures mean equal structure: the order of select items, conjuncts, inner-joined tables, group keys and IN lists, the
direction of a comparison, a RIGHT join's sides, table aliases that need no catalog, ordinals and select aliases behind GROUP BY, HAVING and
ORDER BY do not count. What the grammar cannot read, null included, has no signature and matches nothing, not even itself.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 40
# Words that are never names unless quoted.
RESERVED = frozenset("all and as asc between by case cast cross desc distinct else end escape except exists false from full group having ilike in inner intersect into is join left like limit natural not null nulls offset on or order outer recursive right select then true union using when where with".split())
# Units of an interval.
UNITS = frozenset("microsecond millisecond second minute hour day week month quarter year".split())

_LEX = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])
      |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<word>[^\W\d]\w*)
      |(?P<sign>->>|<=|>=|<>|!=|\|\||::|->|[-=<>+*/%(),.;])""",
    re.X | re.S,
)
_FENCE = re.compile(r"\A\s*```[ \t]*(?:(?!select\b|with\b)[\w+-]*)\s*(.*?)\s*```\s*\Z", re.S | re.I)


class Unreadable(Exception):
    pass


def tokens(sql: str) -> list[tuple[str, str]]:
    fenced = _FENCE.match(sql)
    text = fenced[1] if fenced else sql
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise Unreadable(text[at : at + 10])
        at, kind, value = m.end(), m.lastgroup, m[0]
        if kind == "word":
            out.append(("key" if value.lower() in RESERVED else "name", value.lower()))
        elif kind == "quoted":
            inner = value[1:-1] if value[0] == "[" else value[1:-1].replace(value[0] * 2, value[0])
            if not inner:
                raise Unreadable("empty name")
            out.append(("name!", inner.lower()))
        elif kind == "string":
            out.append(("string", value[1:-1].replace("''", "'")))
        elif kind == "number":
            if at < len(text) and re.match(r"\w", text[at]):
                raise Unreadable("number")
            out.append(("number", value.lower()))
        elif kind == "sign":
            out.append(("sign", "<>" if value == "!=" else value))
    while out and out[-1] == ("sign", ";"):
        out.pop()
    return out


class Parser:
    """Operator precedence over a token list. Nodes are tuples led by their kind."""

    POWER = {"or": 10, "and": 20, "||": 50, "+": 50, "-": 50, "*": 60, "/": 60, "%": 60, "::": 80}
    COMPARE = ("=", "<>", "<", "<=", ">", ">=")

    def __init__(self, toks: list[tuple[str, str]]):
        self.toks, self.at, self.depth = [*toks, ("end", "")], 0, 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[min(self.at + k, len(self.toks) - 1)]

    def take(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def has(self, *values: str) -> bool:
        """Take the keywords or signs if all of them come next."""
        if all(self.peek(i)[1] == v and self.peek(i)[0] in ("key", "sign", "name") for i, v in enumerate(values)):
            self.at += len(values)
            return True
        return False

    def need(self, value: str) -> None:
        if not self.has(value):
            raise Unreadable(value)

    def name(self) -> str:
        kind, value = self.take()
        if kind not in ("name", "name!"):
            raise Unreadable(value)
        return value

    def listed(self, item) -> list:
        out = [item()]
        while self.has(","):
            out.append(item())
        return out

    def nested(self, f):
        self.depth += 1
        if self.depth > DEPTH:
            raise Unreadable("too deep")
        got = f()
        self.depth -= 1
        return got

    def statement(self):
        q = self.query()
        if self.peek()[0] != "end":
            raise Unreadable(self.peek()[1])
        return q

    def query(self):
        return self.nested(self._query)

    def _query(self):
        entries, recursive = [], False
        if self.has("with"):
            recursive = self.has("recursive")
            entries = self.listed(self._entry)
        body = self._term()
        while (op := self.peek()) in (("key", "union"), ("key", "intersect"), ("key", "except")):
            self.take()
            every = self.has("all")
            if not every:
                self.has("distinct")
            body = ("set", op[1], every, body, self._term())
        order = self.listed(self._order) if self.has("order", "by") else []
        limit = offset = None
        if self.has("limit"):
            limit = self.expr(50)
            if self.has(","):
                offset, limit = limit, self.expr(50)
        if self.has("offset"):
            if offset is not None:
                raise Unreadable("offset")
            offset = self.expr(50)
        return ("query", recursive, entries, body, order, limit, offset)

    def _entry(self):
        name, columns = self.name(), []
        if self.has("("):
            columns = self.listed(self.name)
            self.need(")")
        self.need("as")
        self.need("(")
        q = self.query()
        self.need(")")
        return name, columns, q

    def _term(self):
        if self.has("("):
            q = self.query()
            self.need(")")
            return q
        self.need("select")
        distinct = self.has("distinct")
        if not distinct:
            self.has("all")
        items = self.listed(self._item)
        source = where = having = None
        keys = []
        if self.has("from"):
            source = self._sources()
        if self.has("where"):
            where = self.expr()
        if self.has("group", "by"):
            keys = self.listed(self.expr)
        if self.has("having"):
            having = self.expr()
        return ("select", distinct, items, source, where, keys, having)

    def _item(self):
        e = self.expr()
        return e, self._alias()

    def _alias(self):
        if self.has("as") or self.peek()[0] in ("name", "name!"):
            return self.name()
        return None

    def _order(self):
        e, direction, nulls = self.expr(), "asc", None
        if self.has("desc"):
            direction = "desc"
        else:
            self.has("asc")
        if self.has("nulls"):
            nulls = self.name()
            if nulls not in ("first", "last"):
                raise Unreadable("nulls")
        return e, direction, nulls

    def _sources(self):
        left = self._joined()
        while self.has(","):
            left = ("join", "inner", False, left, self._joined(), None)
        return left

    def _joined(self):
        left = self._leaf()
        while True:
            natural = self.has("natural")
            kind = None
            if self.has("cross", "join"):
                left = ("join", "inner", natural, left, self._leaf(), None)
                continue
            for k in ("inner", "left", "right", "full"):
                if self.has(k):
                    kind = k
                    if k != "inner":
                        self.has("outer")
                    break
            if self.has("join"):
                right, condition = self._leaf(), None
                if not natural:
                    if self.has("on"):
                        condition = ("on", self.expr())
                    elif self.has("using"):
                        self.need("(")
                        condition = ("using", self.listed(self.name))
                        self.need(")")
                left = ("join", kind or "inner", natural, left, right, condition)
            elif kind or natural:
                raise Unreadable("join")
            else:
                return left

    def _leaf(self):
        if self.has("("):
            if self.peek() in (("key", "select"), ("key", "with")) or self.peek() == ("sign", "(") and self._opens_query():
                q = self.query()
                self.need(")")
                return ("derived", q, self._alias())
            inner = self.nested(self._sources)
            self.need(")")
            return inner
        parts = [self.name()]
        while self.has("."):
            parts.append(self.name())
        return ("table", tuple(parts), self._alias())

    def _opens_query(self) -> bool:
        k = 0
        while self.peek(k) == ("sign", "("):
            k += 1
        return self.peek(k) in (("key", "select"), ("key", "with"))

    def expr(self, floor: int = 0):
        return self.nested(lambda: self._expr(floor))

    def _expr(self, floor: int):
        left = self._prefix()
        while True:
            kind, value = self.peek()
            if kind in ("key", "sign") and value in self.POWER and self.POWER[value] > floor:
                self.take()
                if value == "::":
                    left = ("cast", left, self._type())
                else:
                    left = ("op", value, left, self.expr(self.POWER[value]))
            elif floor < 40 and kind in ("key", "sign") and (value in self.COMPARE or value in ("is", "in", "like", "ilike", "between", "not")):
                got = self._predicate(left)
                if got is None:
                    return left
                left = got
            else:
                return left

    def _predicate(self, left):
        for sign in self.COMPARE:
            if self.has(sign):
                return ("compare", sign, left, self.expr(40))
        if self.has("is"):
            no = self.has("not")
            return ("is", no, left, self.expr(40))
        no = self.has("not")
        if self.has("in"):
            self.need("(")
            if self.peek() in (("key", "select"), ("key", "with")) or self._opens_query() and self.peek() == ("sign", "("):
                got = ("in", no, left, self.query())
            else:
                got = ("in", no, left, self.listed(self.expr))
            self.need(")")
            return got
        for word in ("like", "ilike"):
            if self.has(word):
                pattern = self.expr(40)
                return ("like", word, no, left, pattern, self.expr(40) if self.has("escape") else None)
        if self.has("between"):
            low = self.expr(40)
            self.need("and")
            return ("between", no, left, low, self.expr(40))
        if no:
            raise Unreadable("not")
        return None

    def _type(self) -> str:
        words = [self.name()]
        while self.peek()[0] == "name" and self.peek()[1] in ("precision", "varying", "zone", "time"):
            words.append(self.take()[1])
        if self.has("("):
            words.append("(" + ",".join(v for _, v in self.listed(self.take)) + ")")
            self.need(")")
        return " ".join(words)

    def _prefix(self):
        kind, value = self.take()
        if kind == "number":
            return ("number", value)
        if kind == "string":
            return ("string", value)
        if kind == "key":
            if value in ("null", "true", "false"):
                return ("literal", value)
            if value == "not":
                return ("not", self.expr(30))
            if value == "exists":
                self.need("(")
                q = self.query()
                self.need(")")
                return ("exists", q)
            if value == "case":
                return self._case()
            if value == "cast":
                self.need("(")
                e = self.expr()
                self.need("as")
                t = self._type()
                self.need(")")
                return ("cast", e, t)
            if value in ("left", "right") and self.peek() == ("sign", "("):
                return self._call((value,))
            raise Unreadable(value)
        if kind == "sign":
            if value in "+-":
                return ("unary", value, self.expr(70))
            if value == "*":
                return ("star", ())
            if value == "(":
                if self.peek() in (("key", "select"), ("key", "with")):
                    q = self.query()
                    self.need(")")
                    return ("subquery", q)
                items = self.listed(self.expr)
                self.need(")")
                return items[0] if len(items) == 1 else ("row", items)
            raise Unreadable(value)
        if kind not in ("name", "name!"):
            raise Unreadable(value)
        if kind == "name" and value in ("date", "time", "timestamp") and self.peek()[0] == "string":
            return ("typed", value, self.take()[1])
        if kind == "name" and value == "interval" and self.peek()[0] in ("string", "number"):
            amount, unit = self.take(), None
            if self.peek()[0] == "name" and self.peek()[1].rstrip("s") in UNITS:
                unit = self.take()[1].rstrip("s")
            return ("interval", *amount, unit)
        parts = [value]
        while self.has("."):
            if self.has("*"):
                return ("star", tuple(parts))
            parts.append(self.name())
        return self._call(tuple(parts)) if self.peek() == ("sign", "(") else ("column", tuple(parts))

    def _call(self, name: tuple[str, ...]):
        self.need("(")
        distinct, args = self.has("distinct"), []
        if not self.has(")"):
            args = self.listed(self.expr)
            self.need(")")
        call = ("call", name, distinct, args)
        if self.peek() == ("name", "over") and self.peek(1) == ("sign", "("):
            self.at += 2
            keys = self.listed(self.expr) if self.has("partition", "by") else []
            order = self.listed(self._order) if self.has("order", "by") else []
            frame = None
            if self.peek()[0] == "name" and self.peek()[1] in ("rows", "range", "groups"):
                unit = self.take()[1]
                if self.has("between"):
                    low = self._bound()
                    self.need("and")
                    frame = (unit, low, self._bound())
                else:
                    frame = (unit, self._bound(), ("current", None))
            self.need(")")
            return ("window", call, keys, order, frame)
        return call

    def _bound(self):
        if self.has("current", "row"):
            return ("current", None)
        amount = None if self.has("unbounded") else self.expr(50)
        side = self.name()
        if side not in ("preceding", "following"):
            raise Unreadable(side)
        return (side, amount)

    def _case(self):
        subject = None if self.peek() == ("key", "when") else self.expr()
        arms = []
        while self.has("when"):
            condition = self.expr()
            self.need("then")
            arms.append((condition, self.expr()))
        if not arms:
            raise Unreadable("case")
        default = self.expr() if self.has("else") else None
        self.need("end")
        return ("case", subject, arms, default)


def _key(node) -> str:
    return json.dumps(node, ensure_ascii=False)


def _bag(nodes) -> list:
    return sorted(nodes, key=_key)


def _once(nodes) -> list:
    return [json.loads(k) for k in sorted({_key(n) for n in nodes})]


class Canon:
    """Rewrites nodes into lists. ``scope`` resolves qualifiers, ``aliases`` select aliases."""

    MIRROR = {"<": ">", "<=": ">="}

    def query(self, q, scope: dict) -> list:
        if q[0] == "select":
            return self.block(q, scope)[0]
        if q[0] == "set":
            return self.setop(q, scope)
        _, recursive, entries, body, order, limit, offset = q
        if body[0] == "select":
            main, inner, aliases, items = self.block(body, scope)
        else:
            main, inner, aliases, items = self.query(body, scope), scope, {}, None
        if not (entries or order or limit or offset):
            return main
        named = _bag([n, c, self.query(s, scope)] for n, c, s in entries)
        terms = [[self.positional(e, inner, aliases, items), d, n] for e, d, n in order]
        ends = [None if x is None else self.expr(x, scope, {}) for x in (limit, offset)]
        return ["query", recursive, named, main, terms, *ends]

    def setop(self, node, scope: dict) -> list:
        _, op, every, left, right = node
        if op == "except":
            return ["set", op, every, self.query(left, scope), self.query(right, scope)]
        parts = []

        def gather(x):
            if x[0] == "query" and not any(x[i] for i in (2, 4)) and x[5] is None and x[6] is None:
                x = x[3]
            if x[0] == "set" and x[1] == op and x[2] == every:
                gather(x[3])
                gather(x[4])
            else:
                parts.append(self.query(x, scope))

        gather(node)
        return ["set", op, every, _bag(parts)]

    def block(self, node, outer: dict):
        _, distinct, items, source, where, keys, having = node
        scope = self.scope(source, outer)
        aliases = {a: e for e, a in items if a}
        conditions = self.conjuncts(where, scope, {})
        tables = None
        if source is not None:
            run = self.inner_run(source, scope)
            if run is not None:
                tables, conditions = ["tables", _bag(run[0])], conditions + run[1]
            else:
                tables = self.joined(source, scope)
        out = [
            "select", distinct, _bag(self.expr(e, scope, {}) for e, _ in items), tables, _once(conditions),
            _once(self.positional(k, scope, aliases, items) for k in keys), _once(self.conjuncts(having, scope, aliases)),
        ]
        return out, scope, aliases, items

    def positional(self, term, scope: dict, aliases: dict, items) -> list:
        if term[0] == "number" and term[1].isdigit() and items is not None and not any(e[0] == "star" for e, _ in items):
            if not 1 <= int(term[1][:9]) <= len(items):
                raise Unreadable("position")
            return self.expr(items[int(term[1]) - 1][0], scope, {})
        return self.expr(term, scope, aliases)

    def leaves(self, node) -> list:
        return [*self.leaves(node[3]), *self.leaves(node[4])] if node[0] == "join" else [node]

    def scope(self, source, outer: dict) -> dict:
        out = dict(outer)
        if source is None:
            return out
        leaves = self.leaves(source)
        qualifiers = [leaf[2] or leaf[1][-1] for leaf in leaves if leaf[2] or leaf[0] == "table"]
        bases = [leaf[1] for leaf in leaves if leaf[0] == "table"]
        for q in qualifiers:
            out.pop(q, None)
        if len(set(qualifiers)) == len(qualifiers) and len(set(bases)) == len(bases):
            out |= {leaf[2]: leaf[1] for leaf in leaves if leaf[0] == "table" and leaf[2]}
        return out

    def leaf(self, node, scope: dict) -> list:
        if node[0] == "table":
            return ["table", list(node[1]), None if scope.get(node[2]) == node[1] else node[2]]
        return ["derived", self.query(node[1], scope), node[2]]

    def inner_run(self, node, scope: dict):
        """Tables and conditions of a run of plain inner joins, or None."""
        if node[0] != "join":
            return [self.leaf(node, scope)], []
        _, kind, natural, left, right, condition = node
        if natural or kind != "inner" or condition is not None and condition[0] == "using":
            return None
        a, b = self.inner_run(left, scope), self.inner_run(right, scope)
        if a is None or b is None:
            return None
        return a[0] + b[0], a[1] + b[1] + self.conjuncts(condition and condition[1], scope, {})

    def joined(self, node, scope: dict) -> list:
        run = self.inner_run(node, scope)
        if run is not None:
            return self.leaf(node, scope) if node[0] != "join" else ["tables", _bag(run[0]), _once(run[1])]
        _, kind, natural, left, right, condition = node
        if kind == "right":
            kind, left, right = "left", right, left
        how = None
        if condition is not None:
            how = ["using", sorted(set(condition[1]))] if condition[0] == "using" else ["on", _once(self.conjuncts(condition[1], scope, {}))]
        return ["join", kind, natural, self.joined(left, scope), self.joined(right, scope), how]

    def conjuncts(self, node, scope: dict, aliases: dict) -> list:
        if node is None:
            return []
        got = self.expr(node, scope, aliases)
        return got[1] if got[0] == "and" else [got]

    def chain(self, node, op: str, scope: dict, aliases: dict) -> list:
        if node[0] == "op" and node[1] == op:
            return self.chain(node[2], op, scope, aliases) + self.chain(node[3], op, scope, aliases)
        got = self.expr(node, scope, aliases)
        return got[1] if got[0] == op else [got]

    def expr(self, node, scope: dict, aliases: dict) -> list:
        go = lambda x: None if x is None else self.expr(x, scope, aliases)
        kind = node[0]
        if kind in ("number", "string", "literal", "typed", "interval"):
            return list(node)
        if kind == "column":
            parts = node[1]
            if len(parts) == 1 and parts[0] in aliases:
                return self.expr(aliases[parts[0]], scope, {})
            return ["column", [*scope[parts[0]], *parts[1:]] if len(parts) > 1 and parts[0] in scope else list(parts)]
        if kind == "star":
            return ["star", list(scope[node[1][0]]) if len(node[1]) == 1 and node[1][0] in scope else list(node[1])]
        if kind == "op":
            op = node[1]
            if op in ("and", "or"):
                parts = _once(self.chain(node, op, scope, aliases))
                return parts[0] if len(parts) == 1 else [op, parts]
            sides = [go(node[2]), go(node[3])]
            return [op, *(_bag(sides) if op in "+*" else sides)]
        if kind == "compare":
            sign, a, b = node[1], go(node[2]), go(node[3])
            if sign in self.MIRROR:
                return [self.MIRROR[sign], b, a]
            return [sign, *(_bag([a, b]) if sign in ("=", "<>") else [a, b])]
        if kind == "is":
            return ["is", node[1], *_bag([go(node[2]), go(node[3])])]
        if kind == "in":
            return ["in", node[1], go(node[2]), self.query(node[3], scope) if isinstance(node[3], tuple) else _once(map(go, node[3]))]
        if kind == "like":
            return ["like", node[1], node[2], go(node[3]), go(node[4]), go(node[5])]
        if kind == "between":
            return ["between", node[1], go(node[2]), go(node[3]), go(node[4])]
        if kind in ("subquery", "exists"):
            return [kind, self.query(node[1], scope)]
        if kind == "row":
            return ["row", [go(x) for x in node[1]]]
        if kind == "cast":
            return ["cast", go(node[1]), node[2]]
        if kind in ("not", "unary"):
            return [*node[:-1], go(node[-1])]
        if kind == "case":
            return ["case", go(node[1]), [[go(a), go(b)] for a, b in node[2]], go(node[3])]
        if kind == "call":
            return ["call", list(node[1]), node[2], [go(x) for x in node[3]]]
        _, call, keys, order, frame = node
        bounds = frame and [frame[0], *([side, go(amount)] for side, amount in frame[1:])]
        return ["window", go(call), _once(map(go, keys)), [[go(e), d, n] for e, d, n in order], bounds]


def structural_signature(sql: object) -> str | None:
    """The canonical structure of a statement as JSON, or None if it cannot be read."""
    if sql is None:
        return None
    try:
        return json.dumps(Canon().query(Parser(tokens(str(sql))).statement(), {}), ensure_ascii=False)
    except (Unreadable, RecursionError):
        return None


def structural_match(a: object, b: object) -> float:
    left = structural_signature(a)
    return 1.0 if left is not None and left == structural_signature(b) else 0.0


@F.pandas_udf(T.StringType())
def _signature(sql: pd.Series) -> pd.Series:
    return sql.map(structural_signature)


@F.pandas_udf(T.DoubleType())
def _match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([structural_match(x, y) for x, y in zip(a, b)], dtype="float64")


def signature(sql: Column) -> Column:
    return _signature(sql)


def match(a: Column, b: Column) -> Column:
    return _match(a, b)
