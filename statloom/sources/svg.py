"""Plots as SVG text: Spark reduces the table to what is drawn, the drawing is a bounded string."""

from __future__ import annotations

from html import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W, H, PAD = 640, 420, 48


def _frame(body: list[str], title: str, xlab: str, ylab: str, xr, yr) -> str:
    ticks = []
    for k in range(5):
        x, y = PAD + k * (W - 2 * PAD) / 4, H - PAD - k * (H - 2 * PAD) / 4
        ticks.append(f'<text x="{x:.1f}" y="{H - PAD + 16}" font-size="10" text-anchor="middle">{xr[0] + k * (xr[1] - xr[0]) / 4:.4g}</text>')
        ticks.append(f'<text x="{PAD - 6}" y="{y + 3:.1f}" font-size="10" text-anchor="end">{yr[0] + k * (yr[1] - yr[0]) / 4:.4g}</text>')
    axes = f'<path d="M{PAD} {PAD}V{H - PAD}H{W - PAD}" fill="none" stroke="#444"/>'
    labels = f'<text x="{W / 2}" y="20" font-size="14" text-anchor="middle">{escape(title)}</text><text x="{W / 2}" y="{H - 8}" font-size="11" text-anchor="middle">{escape(xlab)}</text><text x="14" y="{H / 2}" font-size="11" text-anchor="middle" transform="rotate(-90 14 {H / 2})">{escape(ylab)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{W}" height="{H}" font-family="sans-serif"><rect width="{W}" height="{H}" fill="white"/>{axes}{"".join(ticks)}{labels}{"".join(body)}</svg>'


def _scale(lo, hi, a, b):
    span = (hi - lo) or 1.0
    return lambda v: a + (v - lo) / span * (b - a)


def scatter(df: DataFrame, x: str, y: str, title: str = "", cells: int = 120) -> str:
    """Points binned to a grid of cells, so that any number of rows draws at most ``cells`` squared marks."""
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).collect()[0]
    if r["a"] is None:
        return _frame([], title, x, y, (0, 1), (0, 1))
    cut = lambda c, lo, hi: F.least(F.lit(cells - 1), F.floor((F.col(c) - lo) / F.lit(float((hi - lo) or 1)) * cells))
    marks = df.dropna(subset=[x, y]).groupBy(cut(x, r["a"], r["b"]).alias("i"), cut(y, r["c"], r["d"]).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y")).collect()
    sx, sy = _scale(r["a"], r["b"], PAD, W - PAD), _scale(r["c"], r["d"], H - PAD, PAD)
    body = [f'<circle cx="{sx(m["x"]):.1f}" cy="{sy(m["y"]):.1f}" r="{min(6, 1.5 + np.log2(m["n"])):.1f}" fill="#3366aa" fill-opacity="0.6"/>' for m in marks]
    return _frame(body, title, x, y, (r["a"], r["b"]), (r["c"], r["d"]))


def histogram(df: DataFrame, x: str, title: str = "", bins: int = 40) -> str:
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).collect()[0]
    if r["a"] is None:
        return _frame([], title, x, "rows", (0, 1), (0, 1))
    width = float((r["b"] - r["a"]) or 1) / bins
    n = {int(m["i"]): m["n"] for m in df.dropna(subset=[x]).groupBy(F.least(F.lit(bins - 1), F.floor((F.col(x) - r["a"]) / width)).alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(n.values(), default=1)
    sx, sy = _scale(0, bins, PAD, W - PAD), _scale(0, top, H - PAD, PAD)
    body = [f'<rect x="{sx(i):.1f}" y="{sy(c):.1f}" width="{sx(1) - sx(0) - 1:.1f}" height="{H - PAD - sy(c):.1f}" fill="#3366aa"/>' for i, c in sorted(n.items())]
    return _frame(body, title, x, "rows", (r["a"], r["b"]), (0, top))


def bars(df: DataFrame, label: str, value: str, title: str = "", most: int = 40) -> str:
    rows = df.orderBy(F.desc(value), label).limit(most).collect()
    top = max([abs(r[value]) for r in rows], default=1) or 1
    sx = _scale(0, max(1, len(rows)), PAD, W - PAD)
    body = [f'<rect x="{sx(i):.1f}" y="{H - PAD - abs(r[value]) / top * (H - 2 * PAD):.1f}" width="{sx(1) - sx(0) - 2:.1f}" height="{abs(r[value]) / top * (H - 2 * PAD):.1f}" fill="#3366aa"><title>{escape(str(r[label]))}</title></rect>' for i, r in enumerate(rows)]
    return _frame(body, title, label, value, (0, len(rows)), (0, top))


def boxes(df: DataFrame, group: str, value: str, title: str = "", most: int = 30) -> str:
    rows = df.groupBy(group).agg(F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")).orderBy(group).limit(most).collect()
    lo, hi = min((r["q"][0] for r in rows), default=0), max((r["q"][4] for r in rows), default=1)
    sx, sy = _scale(0, max(1, len(rows)), PAD, W - PAD), _scale(lo, hi, H - PAD, PAD)
    body = []
    for i, r in enumerate(rows):
        a, b, c, d, e = (sy(v) for v in r["q"])
        m, w = sx(i + 0.5), (sx(1) - sx(0)) * 0.3
        body.append(f'<path d="M{m:.1f} {a:.1f}V{b:.1f}M{m:.1f} {d:.1f}V{e:.1f}M{m - w:.1f} {c:.1f}H{m + w:.1f}" stroke="#222" fill="none"/><rect x="{m - w:.1f}" y="{d:.1f}" width="{2 * w:.1f}" height="{b - d:.1f}" fill="#3366aa" fill-opacity="0.5"><title>{escape(str(r[group]))}</title></rect>')
    return _frame(body, title, group, value, (0, len(rows)), (lo, hi))


def quantile_quantile(df: DataFrame, p: str, title: str = "", points: int = 1000) -> str:
    """-log10 of observed p against uniform expectation, at log-spaced ranks."""
    from statloom.operators.ordered import running_sum

    d = df.filter(F.col(p) > 0).select(F.col(p).alias("p"), F.monotonically_increasing_id().alias("k"), F.lit(1).alias("one"))
    n = d.count()
    ranks = sorted({int(v) for v in np.geomspace(1, max(n, 1), points)})
    r = running_sum(d, "one", ["p", "k"], "r").filter(F.col("r").isin(ranks)).select("p", "r").collect()
    pts = [(-np.log10(x["r"] / (n + 1)), -np.log10(x["p"])) for x in r]
    hi = max([max(a, b) for a, b in pts], default=1)
    sx, sy = _scale(0, hi, PAD, W - PAD), _scale(0, hi, H - PAD, PAD)
    body = [f'<path d="M{sx(0):.1f} {sy(0):.1f}L{sx(hi):.1f} {sy(hi):.1f}" stroke="#999"/>'] + [f'<circle cx="{sx(a):.1f}" cy="{sy(b):.1f}" r="2" fill="#3366aa"/>' for a, b in pts]
    return _frame(body, title, "expected -log10 p", "observed -log10 p", (0, hi), (0, hi))


def heatmap(df: DataFrame, row: str, col: str, value: str, title: str = "", most: int = 100) -> str:
    rows = [r[0] for r in df.select(row).distinct().orderBy(row).limit(most).collect()]
    cols = [r[0] for r in df.select(col).distinct().orderBy(col).limit(most).collect()]
    cells = df.filter(F.col(row).isin(rows) & F.col(col).isin(cols)).groupBy(row, col).agg(F.avg(value).alias("v")).collect()
    lo, hi = min((c["v"] for c in cells), default=0), max((c["v"] for c in cells), default=1)
    sx, sy = _scale(0, max(1, len(cols)), PAD, W - PAD), _scale(0, max(1, len(rows)), PAD, H - PAD)
    shade = _scale(lo, hi, 240, 40)
    body = [f'<rect x="{sx(cols.index(c[col])):.1f}" y="{sy(rows.index(c[row])):.1f}" width="{sx(1) - sx(0):.1f}" height="{sy(1) - sy(0):.1f}" fill="rgb({shade(c["v"]):.0f},{shade(c["v"]):.0f},255)"/>' for c in cells]
    return _frame(body, title, col, row, (0, len(cols)), (0, len(rows)))


def forest(pooled: DataFrame, label: str = "feature", estimate: str = "estimate", se: str = "se", title: str = "", most: int = 40) -> str:
    rows = pooled.orderBy(label).limit(most).collect()
    lo, hi = min((r[estimate] - 1.96 * r[se] for r in rows), default=-1), max((r[estimate] + 1.96 * r[se] for r in rows), default=1)
    sx, sy = _scale(lo, hi, PAD, W - PAD), _scale(0, max(1, len(rows)), PAD, H - PAD)
    body = [f'<path d="M{sx(r[estimate] - 1.96 * r[se]):.1f} {sy(i + 0.5):.1f}H{sx(r[estimate] + 1.96 * r[se]):.1f}" stroke="#222"/><circle cx="{sx(r[estimate]):.1f}" cy="{sy(i + 0.5):.1f}" r="3" fill="#3366aa"><title>{escape(str(r[label]))}</title></circle>' for i, r in enumerate(rows)]
    return _frame(body, title, estimate, label, (lo, hi), (0, len(rows)))
