"""MySQL scalar expressions -> Spark columns.

The grammar is that of generated columns, defaults and partition bounds: no
subqueries, no aggregates. A lexer and a precedence parser make a tree; ``column``
turns the tree into a Spark column with MySQL's null rules (GREATEST with a null is
null, comparison by ``<=>``, unsigned results of bit operators).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 128


class ExpressionError(ValueError):
    """Text that is no expression of the grammar, or one without a Spark counterpart."""


@dataclass(frozen=True)
class Node:
    """kind: literal, name, unary, binary, call, case, between, in, is, like, interval, cast, collate or tuple."""

    kind: str
    value: Any = None
    args: tuple[Any, ...] = ()


#: How strongly each binary operator binds; a higher number binds first. Fixed values of the language.
PRECEDENCE = {
    "OR": 1, "||": 1, "XOR": 2, "AND": 3, "&&": 3, "=": 6, "<=>": 6, ">=": 6, ">": 6, "<=": 6, "<": 6, "<>": 6, "!=": 6, "IS": 6, "LIKE": 6, "REGEXP": 6, "RLIKE": 6, "IN": 6,
    "|": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "DIV": 11, "%": 11, "MOD": 11, "^": 12, "COLLATE": 15, "->": 16, "->>": 16,
}
_NOT, _BETWEEN, _UNARY = 4, 5, 13

UNITS = ("MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
#: Compound units and the parts that their text holds.
COMPOUND = {
    "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"), "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"), "MINUTE_SECOND": ("MINUTE", "SECOND"),
    "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"), "HOUR_MINUTE": ("HOUR", "MINUTE"),
    "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"),
    "DAY_HOUR": ("DAY", "HOUR"), "YEAR_MONTH": ("YEAR", "MONTH"),
}

_TOKEN = re.compile(
    r"""\s*(?:(?P<hex>0[xX][0-9a-fA-F]+|[xX]'[0-9a-fA-F]*')|(?P<bit>0b[01]+|[bB]'[01]*')|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$])
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<quoted>`(?:[^`]|``)+`)|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)
    |(?P<op>->>|<=>|->|<<|>>|<=|>=|<>|!=|\|\||&&|[-+*/%^|&~!=<>(),.@:;?{}\[\]])|(?P<end>$))""",
    re.X | re.S,
)
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def executable_comments(text: str, version: int = 80400) -> str:
    """Opens ``/*!NNNNN ... */`` up to the version and drops other comments; quoted text stays as it is."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c in "'\"`":
            end = at + 1
            while end < len(text) and text[end] != c:
                end += 2 if text[end] == "\\" and c != "`" else 1
            out.append(text[at : end + 1])
            at = end + 1
        elif text.startswith("/*", at):
            end = text.find("*/", at)
            if end < 0:
                raise ExpressionError("open comment")
            gate = re.match(r"/\*!(\d{5,6})?", text[at:end])
            inner = executable_comments(text[at + gate.end() : end], version) if gate and int(gate[1] or 0) <= version else ""
            out.append(f" {inner} ")
            at = end + 2
        elif text.startswith(("-- ", "#"), at) or text[at:] == "--":
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        else:
            out.append(c)
            at += 1
    return "".join(out)


def tokens(text: str, ansi_quotes: bool = False) -> list[tuple[str, str]]:
    out, at = [], 0
    while True:
        found = _TOKEN.match(text, at)
        if not found:
            raise ExpressionError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        kind = found.lastgroup
        value = found[kind]
        at = found.end()
        if kind == "end":
            return [*out, ("end", "")]
        if kind == "str":
            body = value[1:-1].replace(value[0] * 2, value[0])
            body = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], "\\" + m[1] if m[1] in "%_" else m[1]), body, flags=re.S)
            kind, value = ("name", body) if ansi_quotes and value[0] == '"' else ("str", body)
        elif kind == "quoted":
            kind, value = "name", value[1:-1].replace("``", "`")
        out.append((kind, value))


class Parser:
    """Precedence parser. pipes_concat: || joins text instead of OR; high_not: NOT binds like a sign."""

    def __init__(self, text: str, ansi_quotes: bool = False, pipes_concat: bool = False, high_not: bool = False, version: int = 80400) -> None:
        self.list = tokens(executable_comments(text, version), ansi_quotes)
        self.at, self.depth, self.pipes_concat, self.high_not = 0, 0, pipes_concat, high_not

    def peek(self, ahead: int = 0) -> str:
        kind, value = self.list[min(self.at + ahead, len(self.list) - 1)]
        return value.upper() if kind == "word" else value if kind == "op" else ""

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.list[self.at - 1]

    def accept(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise ExpressionError(f"expected {' '.join(words)}, found {self.list[self.at][1]!r}")

    def parse(self) -> Node:
        node = self.expression()
        if self.list[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.list[self.at][1]!r}")
        return node

    def expression(self, least: int = 0) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ExpressionError("too deep")
        left = self.prefix()
        while True:
            word = self.peek()
            negated = word == "NOT" and self.peek(1) in ("BETWEEN", "IN", "LIKE", "REGEXP", "RLIKE")
            word = self.peek(1) if negated else word
            binds = _BETWEEN if word == "BETWEEN" else 14 if word == "||" and self.pipes_concat else PRECEDENCE.get(word)
            if binds is None or binds < least or (negated and binds < least):
                break
            self.at += 1 + negated
            left = self.infix(left, word, binds, negated)
        self.depth -= 1
        return left

    def infix(self, left: Node, word: str, binds: int, negated: bool) -> Node:
        if word == "BETWEEN":
            low = self.expression(7)
            self.expect("AND")
            node = Node("between", None, (left, low, self.expression(_BETWEEN)))
        elif word == "IN":
            self.expect("(")
            items = [self.expression()]
            while self.accept(","):
                items.append(self.expression())
            self.expect(")")
            node = Node("in", None, (left, *items))
        elif word == "IS":
            negated = self.accept("NOT")
            _, what = self.next()
            if what.upper() not in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                raise ExpressionError(f"IS {what}")
            node = Node("is", "NULL" if what.upper() == "UNKNOWN" else what.upper(), (left,))
        elif word == "LIKE":
            pattern = self.expression(binds + 1)
            escape = self.expression(binds + 1) if self.accept("ESCAPE") else Node("literal", "\\")
            node = Node("like", None, (left, pattern, escape))
        elif word == "COLLATE":
            node = Node("collate", self.next()[1], (left,))
        elif word in ("+", "-") and self.peek() == "INTERVAL" and self.duration_ahead():
            self.at += 1
            amount = self.expression()
            node = Node("interval", (word, self.unit()), (left, amount))
        else:
            word = {"&&": "AND", "!=": "<>", "MOD": "%", "RLIKE": "REGEXP"}.get(word, word)
            if word == "||":
                word = "CONCAT" if self.pipes_concat else "OR"
            node = Node("binary", word, (left, self.expression(binds + 1)))
        return Node("unary", "NOT", (node,)) if negated else node

    def duration_ahead(self) -> bool:
        """INTERVAL n unit, not the function INTERVAL(n, a, ...): a comma at the first level of its parentheses tells them apart."""
        if self.peek(1) != "(":
            return True
        level, i = 0, 1
        while self.at + i < len(self.list):
            word = self.peek(i)
            level += (word == "(") - (word == ")")
            if level == 1 and word == ",":
                return False
            if level == 0:
                return self.peek(i + 1) in UNITS or self.peek(i + 1) in COMPOUND
            i += 1
        return False

    def unit(self) -> str:
        word = self.next()[1].upper().removeprefix("SQL_TSI_")
        if word not in UNITS and word not in COMPOUND:
            raise ExpressionError(f"unit {word}")
        return word

    def prefix(self) -> Node:
        kind, value = self.next()
        word = value.upper() if kind == "word" else value
        if kind == "op":
            if word == "(":
                items = [self.expression()]
                while self.accept(","):
                    items.append(self.expression())
                self.expect(")")
                return items[0] if len(items) == 1 else Node("tuple", None, tuple(items))
            if word in ("-", "+", "~"):
                return Node("unary", word, (self.expression(_UNARY),))
            if word == "!":
                return Node("unary", "NOT", (self.expression(_UNARY),))
        elif kind == "num":
            return Node("literal", int(value) if value.isdigit() else ("decimal", value) if not re.search("[eE]", value) else float(value))
        elif kind == "hex":
            digits = value[2:].rstrip("'")
            return Node("literal", bytes.fromhex(digits if len(digits) % 2 == 0 else "0" + digits))
        elif kind == "bit":
            return Node("literal", int(value[2:].rstrip("'") or "0", 2))
        elif kind == "str":
            return Node("literal", value)
        elif kind == "name":
            return self.named(value)
        elif kind == "word":
            return self.word(word, value)
        raise ExpressionError(f"unexpected {value!r}")

    def named(self, value: str) -> Node:
        while self.accept("."):
            value = self.next()[1]
        return Node("name", value)

    def word(self, word: str, value: str) -> Node:
        if word == "NOT":
            return Node("unary", "NOT", (self.expression(_UNARY if self.high_not else _NOT),))
        if word in ("NULL", "TRUE", "FALSE"):
            return Node("literal", {"NULL": None, "TRUE": True, "FALSE": False}[word])
        if word in ("DATE", "TIME", "TIMESTAMP") and self.list[self.at][0] == "str":
            return Node("cast", {"DATE": "DATE", "TIME": "CHAR", "TIMESTAMP": "DATETIME"}[word], (Node("literal", self.next()[1]),))
        if word.startswith("_") and self.list[self.at][0] in ("str", "hex"):
            return self.prefix()
        if word == "CASE":
            return self.case()
        if self.peek() != "(":
            return Node("call", word, ()) if word in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "LOCALTIME") else self.named(value)
        self.expect("(")
        return self.call(word)

    def case(self) -> Node:
        subject = None if self.peek() == "WHEN" else self.expression()
        pairs = []
        while self.accept("WHEN"):
            condition = self.expression()
            self.expect("THEN")
            pairs += [condition, self.expression()]
        if not pairs:
            raise ExpressionError("CASE without WHEN")
        other = self.expression() if self.accept("ELSE") else Node("literal", None)
        self.expect("END")
        return Node("case", subject, (*pairs, other))

    def call(self, word: str) -> Node:
        if word in ("CAST", "CONVERT"):
            inner = self.expression()
            if word == "CONVERT" and self.accept("USING"):
                node = Node("call", "CONVERT_USING", (inner, Node("literal", self.next()[1].lower())))
                self.expect(")")
                return node
            self.expect(*(["AS"] if word == "CAST" else [","]))
            return Node("cast", self.cast_type(), (inner,))
        if word == "EXTRACT":
            unit = self.unit()
            self.expect("FROM")
            node = Node("call", "EXTRACT", (Node("literal", unit), self.expression()))
            self.expect(")")
            return node
        if word in ("TIMESTAMPADD", "TIMESTAMPDIFF"):
            args = [Node("literal", self.unit())]
            while self.accept(","):
                args.append(self.expression())
            self.expect(")")
            return Node("call", word, tuple(args))
        if word == "TRIM":
            side = next((s for s in ("BOTH", "LEADING", "TRAILING") if self.accept(s)), "BOTH")
            first = Node("literal", " ") if self.peek() == "FROM" else self.expression()
            node = Node("call", "TRIM", (Node("literal", side), first, self.expression()) if self.accept("FROM") else (Node("literal", side), Node("literal", " "), first))
            self.expect(")")
            return node
        if word == "POSITION":
            part = self.expression(7)
            self.expect("IN")
            node = Node("call", "LOCATE", (part, self.expression()))
            self.expect(")")
            return node
        args: list[Node] = []
        if self.accept(")"):
            return Node("call", CANONICAL.get(word, word), ())
        while True:
            if self.peek() == "INTERVAL" and word in ("DATE_ADD", "DATE_SUB", "ADDDATE", "SUBDATE") and self.duration_ahead():
                self.at += 1
                amount = self.expression()
                unit = self.unit()
                self.expect(")")
                return Node("interval", ("-" if word in ("DATE_SUB", "SUBDATE") else "+", unit), (args[0], amount))
            args.append(self.expression())
            if word in ("SUBSTRING", "SUBSTR", "MID") and self.accept("FROM"):
                args.append(self.expression())
                if self.accept("FOR"):
                    args.append(self.expression())
            if self.accept(")"):
                return Node("call", CANONICAL.get(word, word), tuple(args))
            self.expect(",")

    def cast_type(self) -> str:
        name = self.next()[1].upper()
        size = ""
        if self.accept("("):
            parts = [self.next()[1]]
            while self.accept(","):
                parts.append(self.next()[1])
            self.expect(")")
            size = "(" + ",".join(parts) + ")"
        self.accept("INTEGER")
        if self.accept("CHARACTER", "SET") or self.accept("CHARSET"):
            self.next()
        self.expect(")")
        return name + size


#: Names under which a function is kept.
CANONICAL = {"POWER": "POW", "LCASE": "LOWER", "UCASE": "UPPER", "CHARACTER_LENGTH": "CHAR_LENGTH", "CEIL": "CEILING", "SUBSTRING": "SUBSTR", "MID": "SUBSTR", "POSITION": "LOCATE", "DAY": "DAYOFMONTH"}


def parse(text: str, **modes: Any) -> Node:
    return Parser(text, **modes).parse()


def names(node: Node) -> set[str]:
    """Columns that an expression reads."""
    found = {node.value} if node.kind == "name" else set()
    for part in (*node.args, node.value):
        if isinstance(part, Node):
            found |= names(part)
    return found


_INVERSE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def push_not(node: Node, negated: bool = False) -> Node:
    """The tree with NOT moved into comparisons, AND and OR, and onto IS, BETWEEN and IN, as canonical text has it."""
    if node.kind == "unary" and node.value == "NOT":
        return push_not(node.args[0], not negated)
    if node.kind == "binary" and node.value in ("AND", "OR"):
        word = {"AND": "OR", "OR": "AND"}[node.value] if negated else node.value
        return Node("binary", word, tuple(push_not(a, negated) for a in node.args))
    if negated and node.kind == "binary" and node.value in _INVERSE:
        return Node("binary", _INVERSE[node.value], node.args)
    return Node("unary", "NOT", (node,)) if negated else node


def render(node: Node) -> str:
    """Canonical text: lower-case words, every operation in parentheses, canonical function names."""
    a = [render(x) if isinstance(x, Node) else str(x) for x in node.args]
    if node.kind == "literal":
        v = node.value
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "''") + "'"
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else v[1] if isinstance(v, tuple) else f"0x{v.hex()}" if isinstance(v, bytes) else repr(v)
    if node.kind == "name":
        return "`" + node.value.replace("`", "``") + "`"
    if node.kind == "unary" and node.value == "NOT" and node.args[0].kind in ("between", "in", "is"):
        inner = node.args[0]
        b = [render(x) for x in inner.args]
        if inner.kind == "is":
            return f"({b[0]} is not {inner.value.lower()})"
        return f"({b[0]} not between {b[1]} and {b[2]})" if inner.kind == "between" else f"({b[0]} not in ({','.join(b[1:])}))"
    if node.kind == "unary":
        return f"({node.value.lower()} {a[0]})" if node.value == "NOT" else f"{node.value}{a[0]}"
    if node.kind == "binary":
        return f"({a[0]} {node.value.lower()} {a[1]})"
    if node.kind == "call":
        return f"{node.value.lower()}({','.join(a)})"
    if node.kind == "case":
        pairs = "".join(f" when {x} then {y}" for x, y in zip(a[:-1:2], a[1::2], strict=False))
        return f"(case{' ' + render(node.value) if node.value else ''}{pairs} else {a[-1]} end)"
    if node.kind == "between":
        return f"({a[0]} between {a[1]} and {a[2]})"
    if node.kind == "in":
        return f"({a[0]} in ({','.join(a[1:])}))"
    if node.kind == "is":
        return f"({a[0]} is {node.value.lower()})"
    if node.kind == "like":
        return f"({a[0]} like {a[1]})"
    if node.kind == "interval":
        return f"({a[0]} {node.value[0]} interval {a[1]} {node.value[1].lower()})"
    if node.kind == "cast":
        return f"cast({a[0]} as {node.value.lower()})"
    return f"({a[0]} collate {node.value})" if node.kind == "collate" else f"({','.join(a)})"


def column(text: str | Node, **modes: Any) -> Column:
    """The Spark column of an expression over columns of the same names."""
    return _column(parse(text, **modes) if isinstance(text, str) else text)


def _bool(c: Column, node: Node) -> Column:
    """Truth of an operand: numbers by being nonzero."""
    logical = node.kind in ("is", "in", "between", "like") or (node.kind == "unary" and node.value == "NOT") or (node.kind == "binary" and node.value in ("AND", "OR", "XOR", "=", "<>", "<", ">", "<=", ">=", "<=>", "REGEXP")) or isinstance(node.value, bool) or (node.kind == "call" and node.value == "ISNULL")
    return c if logical else c.cast("double") != 0


def _unsigned(c: Column) -> Column:
    """A 64-bit pattern as the unsigned number that bit operators give."""
    c = c.cast("long")
    return F.when(c < 0, c.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)")).cast("decimal(20,0)")


def _column(node: Node) -> Column:
    if node.kind == "literal":
        v = node.value
        if isinstance(v, tuple):
            whole, _, part = v[1].partition(".")
            return F.lit(v[1]).cast(f"decimal({max(len(whole) + len(part), 1)},{len(part)})")
        return F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v)
    if node.kind == "name":
        return F.col(f"`{node.value}`")
    if node.kind == "case":
        return _case(node)
    if node.kind == "interval":
        return _interval(_column(node.args[0]), node.value[0], node.args[1], node.value[1])
    if node.kind == "cast":
        return _cast(_column(node.args[0]), node.value)
    if node.kind == "call":
        return _call(node)
    a = [_column(x) for x in node.args]
    if node.kind == "unary":
        return {"NOT": lambda: ~_bool(a[0], node.args[0]), "-": lambda: -a[0], "+": lambda: a[0], "~": lambda: _unsigned(F.bitwise_not(a[0].cast("long")))}[node.value]()
    if node.kind == "between":
        a = _collated(node.args, a)
        return a[0].between(a[1], a[2])
    if node.kind == "in":
        a = _collated(node.args, a)
        out = a[0] == a[1]
        for x in a[2:]:
            out = out | (a[0] == x)
        return out
    if node.kind == "is":
        if node.value == "NULL":
            return a[0].isNull()
        truth = F.coalesce(_bool(a[0], node.args[0]), F.lit(None).cast("boolean"))
        return F.coalesce(truth if node.value == "TRUE" else ~truth, F.lit(False))
    if node.kind == "like":
        folded = "_CI" in (_collation(node.args[:2]) or "")
        return F.like(F.lower(a[0].cast("string")), F.lower(a[1]), a[2]) if folded else F.like(a[0].cast("string"), a[1], a[2])
    if node.kind == "collate":
        _rule(node.value)
        return a[0]  # comparisons ask for it
    if node.kind == "tuple":
        return F.struct(*a)
    return _binary(node, a)


def _rule(name: str) -> str | None:
    """A collation's name -> Spark's: by letters (ci) or exactly, with or without accents; null compares bytes. Only the newest ones count spaces at the end."""
    name = name.lower()
    if name == "binary" or name.endswith("_bin"):
        return None
    if not re.fullmatch(r"[a-z0-9]+(_[a-z0-9]+)*_(ci|cs)", name):
        raise ExpressionError(f"collation {name}")
    accents = "_as_" in name or name.endswith("_cs")
    return ("UNICODE" if name.endswith("_cs") else "UNICODE_CI") + ("" if accents else "_AI") + ("" if "_0900_" in name else "_RTRIM")


def _explicit(node: Node) -> str | None:
    """The collation that an expression names, for itself or for a part of its text."""
    if node.kind == "collate":
        return node.value
    if node.kind == "call" or (node.kind == "binary" and node.value == "CONCAT"):
        return next((c for c in map(_explicit, (x for x in node.args if isinstance(x, Node))) if c), None)
    return None


def _collation(nodes: Any) -> str | None:
    name = next((c for c in map(_explicit, nodes) if c), None)
    return _rule(name) if name else None


def _collated(nodes: Any, columns: list[Column]) -> list[Column]:
    """The sides of a comparison under the collation that one of them names."""
    rule = _collation(nodes)
    return [F.collate(c.cast("string"), rule) for c in columns] if rule else columns


#: Characters that a character set lacks, as a pattern; a conversion puts ? in their place.
_LACKS = {"ascii": r"[^\x00-\x7f]", "latin1": r"[^\x00-\xff\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]", "utf8": r"[^\x{0}-\x{ffff}]", "utf8mb3": r"[^\x{0}-\x{ffff}]", "utf8mb4": None, "utf16": None, "utf32": None, "ucs2": r"[^\x{0}-\x{ffff}]"}


def _convert(c: Column, charset: str) -> Column:
    charset = str(charset).lower()
    if charset == "binary":
        return c.cast("string").cast("binary")
    if charset not in _LACKS:
        raise ExpressionError(f"character set {charset}")
    pattern = _LACKS[charset]
    return F.regexp_replace(c.cast("string"), pattern, "?") if pattern else c.cast("string")


def _json_path(node: Node) -> str:
    if node.kind != "literal" or not isinstance(node.value, str) or not node.value.startswith("$") or re.search(r"\*|\[last", node.value):
        raise ExpressionError("a JSON path of keys and places")
    return re.sub(r'\."((?:[^"\\]|\\.)*)"', lambda m: '["' + m[1] + '"]', node.value)


def _json_extract(document: Column, paths: Any) -> Column:
    """The JSON text of the value at a path; of several paths the found values as an array. Null where nothing is found or the text is no JSON."""
    parsed = F.call_function("try_parse_json", document.cast("string"))
    found = [F.to_json(F.call_function("try_variant_get", parsed, F.lit(_json_path(p)), F.lit("variant"))) for p in paths]
    if len(found) == 1:
        return found[0]
    return F.when(F.coalesce(*found).isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *found), F.lit("]")))


def _json_unquote(text: Column) -> Column:
    """The text of a JSON string; any other text as it is."""
    return F.when(text.rlike('(?s)^".*"$'), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")).otherwise(text)


def _is_json(node: Node) -> bool:
    return (node.kind == "call" and node.value in ("JSON_EXTRACT", "JSON_ARRAY", "JSON_OBJECT")) or (node.kind == "binary" and node.value == "->") or (node.kind == "cast" and node.value == "JSON")


def _json_element(node: Node) -> Column:
    """A value inside a JSON document: JSON goes in as it is, text is quoted, null is null."""
    value = _column(node)
    if node.kind == "literal" and node.value is None:
        return F.lit("null")
    if not _is_json(node):
        whole = F.to_json(F.struct(value.alias("v")))
        value = F.when(F.length(whole) > 2, F.substr(whole, F.lit(6), F.length(whole) - 6))
    return F.coalesce(value, F.lit("null"))


def _between(mark: str, parts: list[Column]) -> list[Column]:
    out: list[Column] = []
    for i, part in enumerate(parts):
        out += [part] if i == 0 else [F.lit(mark), part]
    return out


def _json_object(args: Any) -> Column:
    """Keys in the order of documents, short ones first; of a literal key given twice the last value counts."""
    if len(args) % 2:
        raise ExpressionError("arguments of JSON_OBJECT")
    pairs = list(zip(args[::2], args[1::2], strict=True))
    if all(k.kind == "literal" and isinstance(k.value, str) for k, _ in pairs):
        pairs = sorted({k.value: (k, v) for k, v in pairs}.values(), key=lambda p: (len(p[0].value.encode()), p[0].value.encode()))
    parts = [F.concat(_json_element(k), F.lit(":"), _json_element(v)) for k, v in pairs]
    return F.concat(F.lit("{"), *_between(",", parts), F.lit("}"))


def _case(node: Node) -> Column:
    *pairs, other = node.args
    subject = _column(node.value) if node.value is not None else None
    named = _collation([node.value, *pairs[::2]]) if node.value is not None else None
    out = None
    for condition, result in zip(pairs[::2], pairs[1::2], strict=True):
        test = _column(condition)
        if subject is not None:
            test = F.collate(subject.cast("string"), named) == F.collate(test.cast("string"), named) if named else subject == test
        else:
            test = _bool(test, condition)
        out = F.when(test, _column(result)) if out is None else out.when(test, _column(result))
    return out.otherwise(_column(other))


def _binary(node: Node, a: list[Column]) -> Column:
    word, (x, y) = node.value, a
    if word in ("AND", "OR", "XOR"):
        p, q = _bool(x, node.args[0]), _bool(y, node.args[1])
        return p & q if word == "AND" else p | q if word == "OR" else p != q
    if word in ("&", "|", "^"):
        x, y = x.cast("long"), y.cast("long")
        return _unsigned({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[word](y))
    if word in ("<<", ">>"):
        n = y.cast("int")
        shifted = F.call_function("shiftleft" if word == "<<" else "shiftrightunsigned", x.cast("long"), n)
        return F.when((n >= 64) | (n < 0), F.lit(0).cast("decimal(20,0)")).otherwise(_unsigned(shifted))
    if word == "/":
        return F.when(y != 0, x / y)
    if word == "DIV":
        x, y = x.try_cast("decimal(38,10)"), y.try_cast("decimal(38,10)")  # whole numbers of 28 digits stay exact
        return F.when(y != 0, F.call_function("div", x, y))
    if word == "%":
        return F.when(y != 0, x % y)
    if word == "REGEXP":
        return F.rlike(x.cast("string"), y)
    if word == "CONCAT":
        return F.concat(x.cast("string"), y.cast("string"))
    if word in ("->", "->>"):
        found = _json_extract(x, [node.args[1]])
        return found if word == "->" else _json_unquote(found)
    if word in ("=", "<=>", "<>", "<", ">", "<=", ">="):
        x, y = _collated(node.args, [x, y])
    return {"=": lambda: x == y, "<=>": lambda: x.eqNullSafe(y), "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[word]()


def _cast(c: Column, kind: str) -> Column:
    name, _, size = kind.partition("(")
    if name in ("CHAR", "NCHAR"):
        return F.substring(c.cast("string"), 1, int(size[:-1])) if size else c.cast("string")
    target = {"SIGNED": "long", "UNSIGNED": "decimal(20,0)", "DATE": "date", "DATETIME": "timestamp_ntz", "BINARY": "binary", "FLOAT": "float", "DOUBLE": "double", "REAL": "double", "YEAR": "int", "TIME": "string", "JSON": "string"}.get(name)
    if name == "DECIMAL":
        target = f"decimal({size[:-1] or '10,0'})"
    if target is None:
        raise ExpressionError(f"cast to {kind}")
    if name == "SIGNED":
        return F.round(c.cast("decimal(38,6)"), 0).cast("long")
    return c.try_cast(target)


def _interval(c: Column, sign: str, amount: Node, unit: str) -> Column:
    sign_ = -1 if sign == "-" else 1
    if unit in COMPOUND:
        if amount.kind != "literal" or not isinstance(amount.value, str):
            raise ExpressionError("compound interval needs text")
        numbers = [int(n) for n in re.findall(r"\d+", amount.value)]
        parts = COMPOUND[unit][-len(numbers) :]
        factor = -sign_ if amount.value.strip().startswith("-") else sign_
        if unit == "YEAR_MONTH":  # months are added at once: a leap day survives whole years
            return _add(c, F.lit(factor * sum(n * (12 if part == "YEAR" else 1) for n, part in zip(numbers, parts, strict=True))), "MONTH")
        for n, part in zip(numbers, parts, strict=True):
            c = _add(c, F.lit(n * factor), part)
        return c
    return _add(c, _column(amount) * sign_, unit)


def _add(c: Column, amount: Column, unit: str) -> Column:
    n = amount.cast("int")
    if unit in ("YEAR", "QUARTER", "MONTH"):
        return c + F.make_ym_interval(F.lit(0), n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit])
    if unit == "MICROSECOND":
        return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (amount / 1_000_000).cast("decimal(18,6)"))
    if unit in ("DAY", "WEEK"):
        return c + F.make_dt_interval(n * (7 if unit == "WEEK" else 1))
    zero = F.lit(0)
    return c + F.make_dt_interval(zero, n if unit == "HOUR" else zero, n if unit == "MINUTE" else zero, (n if unit == "SECOND" else zero).cast("decimal(18,6)"))


def to_days(c: Column) -> Column:
    """Days since year 0: 366 at 0001-01-01."""
    return F.datediff(c.cast("date"), F.lit("0001-01-01").cast("date")) + 366


def _part(unit: str, c: Column) -> Column:
    one = {"YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "WEEK": F.weekofyear}
    if unit in one:
        return one[unit](c)
    if unit == "SECOND":
        return F.second(c)
    if unit == "MICROSECOND":
        return (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long") % 1_000_000
    out = F.lit(0).cast("long")
    for part in COMPOUND[unit]:
        out = out * (1_000_000 if part == "MICROSECOND" else 100) + _part(part, c).cast("long")
    return out


def _strict(function: Any, args: list[Column]) -> Column:
    """GREATEST and LEAST: null if any argument is."""
    known = F.lit(True)
    for x in args:
        known = known & x.isNotNull()
    return F.when(known, function(*args))


def _trim(side: str, part: Column, text: Column, literal: Any) -> Column:
    """TRIM removes whole repeats of a string, not any of its characters."""
    quoted = re.escape(literal)
    if side in ("BOTH", "LEADING"):
        text = F.regexp_replace(text, f"^(?:{quoted})+", "")
    return F.regexp_replace(text, f"(?:{quoted})+$", "") if side in ("BOTH", "TRAILING") else text


def _interval_function(args: list[Column]) -> Column:
    """INTERVAL(n, a, b, ...): how many of the ascending bounds are at most n; -1 for a null n."""
    out = F.lit(len(args) - 1)
    for i in range(len(args) - 1, 0, -1):
        out = F.when(args[0] < args[i], i - 1).otherwise(out)
    return F.when(args[0].isNull(), -1).otherwise(out)


def _call(node: Node) -> Column:
    name = node.value
    if name == "EXTRACT":
        return _part(node.args[0].value, _column(node.args[1]))
    if name == "TIMESTAMPADD":
        return _add(_column(node.args[2]), _column(node.args[1]), node.args[0].value)
    if name == "TIMESTAMPDIFF":
        return F.timestamp_diff(node.args[0].value, _column(node.args[1]).cast("timestamp_ntz"), _column(node.args[2]).cast("timestamp_ntz"))
    if name == "TRIM":
        side, part, text = node.args
        if part.kind != "literal":
            raise ExpressionError("TRIM of a computed string")
        return _trim(side.value, _column(part), _column(text).cast("string"), part.value)
    if name == "CONVERT_USING":
        return _convert(_column(node.args[0]), node.args[1].value)
    if name == "JSON_EXTRACT":
        return _json_extract(_column(node.args[0]), node.args[1:])
    if name == "JSON_ARRAY":
        return F.concat(F.lit("["), *_between(",", [_json_element(x) for x in node.args]), F.lit("]"))
    if name == "JSON_OBJECT":
        return _json_object(node.args)
    a = [_column(x) for x in node.args]
    text = [x.cast("string") for x in a]
    try:
        return _FUNCTIONS[name](a, text)
    except KeyError:
        raise ExpressionError(f"function {name}") from None
    except IndexError:
        raise ExpressionError(f"arguments of {name}") from None


_FUNCTIONS: dict[str, Any] = {
    "ABS": lambda a, t: F.abs(a[0]), "CEILING": lambda a, t: F.ceil(a[0]), "FLOOR": lambda a, t: F.floor(a[0]), "POW": lambda a, t: F.pow(a[0], a[1]), "SQRT": lambda a, t: F.when(a[0] >= 0, F.sqrt(a[0])),
    "MOD": lambda a, t: F.when(a[1] != 0, a[0] % a[1]), "ROUND": lambda a, t: F.round(a[0], a[1] if len(a) > 1 else 0), "SIGN": lambda a, t: F.signum(a[0]).cast("int"),
    "GREATEST": lambda a, t: _strict(F.greatest, a), "LEAST": lambda a, t: _strict(F.least, a), "COALESCE": lambda a, t: F.coalesce(*a), "IFNULL": lambda a, t: F.coalesce(*a),
    "NULLIF": lambda a, t: F.nullif(a[0], a[1]), "IF": lambda a, t: F.when(a[0].cast("boolean"), a[1]).otherwise(a[2]), "ISNULL": lambda a, t: a[0].isNull(),
    "INTERVAL": lambda a, t: _interval_function(a), "CONCAT": lambda a, t: F.concat(*t), "CONCAT_WS": lambda a, t: F.when(t[0].isNotNull(), F.call_function("concat_ws", *t)),
    "LOWER": lambda a, t: F.lower(t[0]), "UPPER": lambda a, t: F.upper(t[0]), "CHAR_LENGTH": lambda a, t: F.char_length(t[0]), "LENGTH": lambda a, t: F.octet_length(t[0]),
    "LEFT": lambda a, t: F.left(t[0], a[1]), "RIGHT": lambda a, t: F.right(t[0], a[1]), "REVERSE": lambda a, t: F.reverse(t[0]), "REPLACE": lambda a, t: F.replace(*t), "REPEAT": lambda a, t: F.call_function("repeat", t[0], a[1]),
    "LPAD": lambda a, t: F.call_function("lpad", t[0], a[1], t[2]), "RPAD": lambda a, t: F.call_function("rpad", t[0], a[1], t[2]), "LTRIM": lambda a, t: F.ltrim(t[0]), "RTRIM": lambda a, t: F.rtrim(t[0]),
    "SUBSTR": lambda a, t: F.when(a[1] != 0, F.substr(t[0], a[1], a[2]) if len(a) > 2 else F.substr(t[0], a[1])).otherwise(""), "LOCATE": lambda a, t: F.call_function("locate", t[0], t[1], *a[2:]), "INSTR": lambda a, t: F.instr(t[0], t[1]),
    "HEX": lambda a, t: F.hex(a[0]), "UNHEX": lambda a, t: F.unhex(t[0]), "MD5": lambda a, t: F.md5(t[0]), "CRC32": lambda a, t: F.crc32(t[0]), "ASCII": lambda a, t: F.ascii(t[0]),
    "YEAR": lambda a, t: F.year(a[0]), "QUARTER": lambda a, t: F.quarter(a[0]), "MONTH": lambda a, t: F.month(a[0]), "DAYOFMONTH": lambda a, t: F.dayofmonth(a[0]), "DAYOFWEEK": lambda a, t: F.dayofweek(a[0]), "DAYOFYEAR": lambda a, t: F.dayofyear(a[0]),
    "WEEKDAY": lambda a, t: F.weekday(a[0]), "HOUR": lambda a, t: F.hour(a[0]), "MINUTE": lambda a, t: F.minute(a[0]), "SECOND": lambda a, t: F.second(a[0]), "MICROSECOND": lambda a, t: _part("MICROSECOND", a[0]),
    "TO_DAYS": lambda a, t: to_days(a[0]), "FROM_DAYS": lambda a, t: F.date_add(F.lit("0001-01-01").cast("date"), (a[0] - 366).cast("int")),
    "TO_SECONDS": lambda a, t: to_days(a[0]).cast("long") * 86400 + F.hour(a[0]) * 3600 + F.minute(a[0]) * 60 + F.second(a[0]), "TIME_TO_SEC": lambda a, t: F.hour(a[0]) * 3600 + F.minute(a[0]) * 60 + F.second(a[0]),
    "UNIX_TIMESTAMP": lambda a, t: F.unix_seconds(a[0].cast("timestamp")), "DATE": lambda a, t: a[0].cast("date"), "DATEDIFF": lambda a, t: F.datediff(a[0], a[1]), "LAST_DAY": lambda a, t: F.last_day(a[0]),
    "YEARWEEK": lambda a, t: _yearweek(a[0]), "JSON_UNQUOTE": lambda a, t: _json_unquote(t[0]), "BIT_COUNT": lambda a, t: F.bit_count(a[0].cast("long")),
    "CURRENT_TIMESTAMP": lambda a, t: F.localtimestamp(), "CURRENT_DATE": lambda a, t: F.current_date(),
}


def _yearweek(c: Column) -> Column:
    """Mode 0: weeks start on Sunday; week 1 is the first with a Sunday in this year, days before it count to the year before."""
    c = c.cast("date")
    sunday = F.date_sub(c, F.dayofweek(c) - 1)
    return F.year(sunday) * 100 + F.floor((F.dayofyear(sunday) - 1) / 7) + 1
