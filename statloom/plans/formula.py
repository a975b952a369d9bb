"""R-style formulas compiled to columns.

``response ~ terms``: ``+`` separates; ``1``, ``0`` and ``-1`` set the intercept; ``a:b`` is an interaction, ``a*b`` is a + b + a:b; ``offset(z)``; ``(expr|g)``
and ``(expr||g)`` are random terms, ``a/b`` in a group nests; ``s(x)``, ``te(x,y)`` are smooths; ``Surv(time,event)`` or ``Surv(start,stop,event)`` on the left;
``<omics>`` stands for the scanned feature, once and as a main effect. Categorical levels come in the order first seen, so compiling one
needs a column that orders the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERCEPT = "(Intercept)"
OMICS = "<omics>"


@dataclass
class Random:
    terms: list[str]
    group: list[str]
    correlated: bool


@dataclass
class Formula:
    response: list[str]
    survival: bool
    intercept: bool
    terms: list[tuple[str, ...]]
    offset: str | None = None
    random: list[Random] = field(default_factory=list)
    smooths: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    omics: bool = False

    def variables(self) -> list[str]:
        names = [*self.response, *(v for t in self.terms for v in t), *([self.offset] if self.offset else []), *(v for _, s in self.smooths for v in s)]
        names += [v for r in self.random for v in [*r.terms, *r.group] if v not in ("0", "1")]
        return list(dict.fromkeys(names))


def _split(text: str, mark: str) -> list[str]:
    """Split at top-level ``mark`` only."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == mark and not depth:
            out.append(text[last:i])
            last = i + 1
    if depth:
        raise ValueError(f"unbalanced parentheses in {text!r}")
    return [*out, text[last:]]


_NAME = re.compile(r"^[A-Za-z_.][A-Za-z0-9_.]*$")


def _name(text: str) -> str:
    if not _NAME.match(text):
        raise ValueError(f"not a variable name: {text!r}")
    return text


def parse(text: str) -> Formula:
    text = re.sub(r"\s+", "", text)
    left, mark, right = text.partition("~")
    if not mark or not left or not right:
        raise ValueError("a formula is response ~ terms")
    surv = re.fullmatch(r"Surv\((.+)\)", left)
    response = [_name(v) for v in (surv[1].split(",") if surv else [left])]
    if surv and len(response) not in (2, 3):
        raise ValueError("Surv takes (time, event) or (start, stop, event)")
    f = Formula(response, bool(surv), not surv, [])
    for raw in _split(right.replace("-1", "+-1"), "+"):
        if not raw:
            continue
        if raw in ("0", "-1"):
            f.intercept = False
        elif raw == "1":
            f.intercept = True
        elif raw == OMICS:
            if f.omics:
                raise ValueError(f"{OMICS} stands once")
            f.omics = True
        elif raw.startswith("offset("):
            if f.offset:
                raise ValueError("one offset at most")
            f.offset = _name(raw[7:-1])
        elif m := re.fullmatch(r"\((.+?)(\|\|?)([^|]+)\)", raw):
            terms = [t for t in _split(m[1], "+")]
            groups = [[_name(x) for x in m[3].split("/")[: k + 1]] for k in range(m[3].count("/") + 1)]
            f.random += [Random(terms, [v for part in g for v in part.split(":")], m[2] == "|") for g in groups]
        elif m := re.fullmatch(r"(s|te|ti)\((.+)\)", raw):
            f.smooths.append((m[1], tuple(_name(v) for v in m[2].split(",") if "=" not in v)))
        else:
            if OMICS in raw:
                raise ValueError(f"{OMICS} is a main effect only")
            parts = raw.split("*")
            if len(parts) == 2:
                a, b = _name(parts[0]), _name(parts[1])
                new = [(a,), (b,), (a, b)]
            elif len(parts) == 1:
                new = [tuple(_name(v) for v in raw.split(":"))]
            else:
                raise ValueError("a*b takes exactly two factors")
            f.terms += [t for t in new if t not in f.terms]
    return f


def levels(df: DataFrame, column: str, order: str) -> list[str]:
    """Levels by the smallest ``order`` at which they stand; their number is bounded by what a design can hold."""
    rows = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_o")).orderBy("_o").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{column} has more than 10,000 levels")
    return [r[0] for r in rows]


def design(df: DataFrame, formula: Formula | str, order: str | None = None, coding: str = "treatment") -> list[tuple[str, Column]]:
    """(name, column) of the fixed part: treatment coding against the first level, or sum coding with the last level at -1."""
    f = parse(formula) if isinstance(formula, str) else formula
    kinds = {x.name: x.dataType for x in df.schema.fields}
    cache: dict[str, list[tuple[str, Column]]] = {}

    def columns(name: str) -> list[tuple[str, Column]]:
        if name not in kinds:
            raise ValueError(f"no column {name!r}")
        if name not in cache:
            if isinstance(kinds[name], T.StringType):
                if order is None:
                    raise ValueError(f"{name} is categorical: levels need a column that orders the rows")
                found = levels(df, name, order)
                if len(found) < 2:
                    raise ValueError(f"{name} has fewer than two levels")
                is_ = lambda v: (F.col(name) == F.lit(v)).cast("double")
                if coding == "sum":
                    cache[name] = [(f"{name}{v}", is_(v) - is_(found[-1])) for v in found[:-1]]
                else:
                    cache[name] = [(f"{name}{v}", is_(v)) for v in found[1:]]
            else:
                cache[name] = [(name, F.col(name).cast("double"))]
        return cache[name]

    out: list[tuple[str, Column]] = [(INTERCEPT, F.lit(1.0))] if f.intercept else []
    for term in f.terms:
        now = columns(term[0])
        for v in term[1:]:  # row-wise Kronecker product, the left factor slowest
            now = [(f"{a}:{b}", x * y) for a, x in now for b, y in columns(v)]
        out += now
    return out


def with_design(df: DataFrame, formula: Formula | str, order: str | None = None, coding: str = "treatment") -> tuple[DataFrame, list[str]]:
    """``df`` with the design's columns added under their names, and the names."""
    cols = design(df, formula, order, coding)
    for name, c in cols:
        if name != INTERCEPT and name not in df.columns:
            df = df.withColumn(name, c)
    return df, [n for n, _ in cols]
