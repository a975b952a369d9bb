"""A selection language compiled to columns.

``|| && ! < <= > >= == != + - * /``, unary minus, parentheses, strings, backtick column names, ``true`` and ``false``, ``bonferroni([alpha[, m]])``, ``abs``,
``is_missing``, ``is_finite``. Logic is three-valued: Catalyst's own. ``==`` compares numbers if either side is a number, otherwise text.
Every column is text until it is compared; missing tokens are null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that mean missing, in upper case.
MISSING = ("", "NA", "NAN", "NULL", ".")

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_][A-Za-z0-9_.]*)|`([^`]+)`|\"([^\"]*)\"|'([^']*)'|(\|\||&&|<=|>=|==|!=|[<>!+\-*/(),]))")


@dataclass
class Node:
    kind: str  # number, text, boolean, column
    col: Column


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        kind = ("number", "name", "column", "text", "text", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class Compiler:
    def __init__(self, text: str, columns: list[str], count: Column | int):
        self.items, self.at, self.columns, self.count = tokens(text), 0, columns, count

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] in ("op", "name") else None

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] == "op" and self.items[self.at][1] in ops:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def compile(self) -> Column:
        node = self.either()
        if self.at < len(self.items):
            raise ValueError(f"unexpected {self.items[self.at][1]!r}")
        if node.kind != "boolean":
            raise ValueError("the expression is not a condition")
        return node.col

    def logic(self, node: Node) -> Column:
        if node.kind != "boolean":
            raise ValueError("a condition is expected")
        return node.col

    def either(self) -> Node:
        left = self.both()
        while self.take("||"):
            left = Node("boolean", self.logic(left) | self.logic(self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("&&"):
            left = Node("boolean", self.logic(left) & self.logic(self.negated()))
        return left

    def negated(self) -> Node:
        if self.take("!"):
            return Node("boolean", ~self.logic(self.negated()))
        return self.compared()

    def compared(self) -> Node:
        left = self.sum()
        op = self.take("<", "<=", ">", ">=", "==", "!=")
        if not op:
            return left
        right = self.sum()
        if op in ("==", "!=") and "number" not in (left.kind, right.kind):
            a, b = (present(x.col) if x.kind == "column" else x.col for x in (left, right))
        else:
            a, b = self.number(left), self.number(right)
        return Node("boolean", {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op])

    def number(self, node: Node) -> Column:
        if node.kind == "number":
            return node.col
        if node.kind == "column":
            return as_number(node.col)
        raise ValueError("a number is expected")

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            a, b = self.number(left), self.number(self.product())
            left = Node("number", a + b if op == "+" else a - b)
        return left

    def product(self) -> Node:
        left = self.unary()
        while op := self.take("*", "/"):
            a, b = self.number(left), self.number(self.unary())
            left = Node("number", a * b if op == "*" else F.try_divide(a, b))
        return left

    def unary(self) -> Node:
        if self.take("-"):
            return Node("number", -self.number(self.unary()))
        return self.atom()

    def arguments(self) -> list[Node]:
        out: list[Node] = []
        if not self.take("("):
            raise ValueError("( is expected")
        if self.take(")"):
            return out
        while True:
            out.append(self.either())
            if self.take(")"):
                return out
            if not self.take(","):
                raise ValueError(", or ) is expected")

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise ValueError(") is expected")
            return node
        if self.at >= len(self.items):
            raise ValueError("the expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "number":
            return Node("number", F.lit(float(value)))
        if kind == "text":
            return Node("text", F.lit(value))
        if kind == "name" and value in ("true", "false"):
            return Node("boolean", F.lit(value == "true"))
        if kind == "name" and self.at < len(self.items) and self.items[self.at] == ("op", "("):
            args = self.arguments()
            if value == "bonferroni":
                alpha = self.number(args[0]) if args else F.lit(0.05)
                m = self.number(args[1]) if len(args) > 1 else (F.lit(float(self.count)) if isinstance(self.count, int) else self.count)
                return Node("number", alpha / m)
            if value == "abs" and len(args) == 1:
                return Node("number", F.abs(self.number(args[0])))
            if value == "is_missing" and len(args) == 1:
                return Node("boolean", present(args[0].col.cast("string")).isNull())
            if value == "is_finite" and len(args) == 1:
                return Node("boolean", F.coalesce(F.abs(self.number(args[0])) < F.lit(float("inf")), F.lit(False)))
            raise ValueError(f"no function {value!r} of {len(args)}")
        if kind in ("name", "column"):
            if value not in self.columns:
                raise ValueError(f"no column {value!r}")
            return Node("column", F.col(f"`{value}`"))
        raise ValueError(f"unexpected {value!r}")


def present(c: Column) -> Column:
    """Trimmed text, null for the tokens that mean missing."""
    text = F.trim(c.cast("string"))
    return F.when(~F.upper(text).isin(*MISSING), text)


def as_number(c: Column) -> Column:
    n = present(c).try_cast("double")
    return F.when(~F.isnan(n), n)


def condition(text: str, columns: list[str], count: Column | int = 1) -> Column:
    return Compiler(text, columns, count).compile()


def select(df: DataFrame, selection: str, universe: str | None = None, missing: str = "error") -> DataFrame:
    """``df`` with ``selected``: the universe is filtered first, then the selection is evaluated with the universe's size for
    bonferroni(). With ``missing='exclude'`` rows of unknown condition leave the universe and the size is counted again."""
    if universe:
        df = df.filter(F.coalesce(condition(universe, df.columns, df.count()), F.lit(False)))
    n = df.count()
    unknown = df.filter(condition(selection, df.columns, max(n, 1)).isNull())
    if missing == "error":
        if unknown.limit(1).count():
            raise ValueError("the selection is unknown for some rows")
    else:
        df = df.filter(condition(selection, df.columns, max(n, 1)).isNotNull())
        n = df.count()
    return df.withColumn("selected", condition(selection, df.columns, max(n, 1)))
