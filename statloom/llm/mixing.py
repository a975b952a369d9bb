"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

Source weights are token shares raised to an exponent between 0 (uniform) and 1 (as they are). The exponent is bisected: the largest
whose entropy reaches the target, raised where needed until no source repeats more often than the limit. Weights times the token
budget give each source's tokens: whole passes over it, then a prefix of its documents in a seeded permutation, dealt in hash blocks.

Defined results: a null source is the source ``(none)``; null or empty texts have no tokens, and no copies beyond the whole passes. A budget
over ``max_repeats`` times all tokens is cut to that. Without any token every document has 0 copies. Rows that repeat an id
count as one document (see ``frames.keyed``), rows with a null id are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.llm.frames import keyed, materialize

#: Hash blocks of a source; a block is what one window partition orders.
BLOCK_DIGITS = 3
#: Up to so many sources the plan (a row each) is broadcast to the documents, otherwise joined by source and block.
BROADCAST_SOURCES = 10_000
STEPS, STEPS_AT_ONCE = 40, 4
NO_SOURCE = "(none)"
#: A budget this little (in tokens) under a whole number is that number, whatever the order of the sums.
SLACK = 1e-5


@dataclass(frozen=True)
class Target:
    """``entropy`` as a share of the largest possible, ``budget`` in multiples of all tokens, ``max_repeats`` of any source."""

    entropy: float = 0.95
    max_repeats: float = 4.0
    budget: float = 1.0
    seed: int = 17


def n_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _inner(low: float, high: float) -> list[float]:
    n = 1 << STEPS_AT_ONCE
    return [low + (high - low) * k / n for k in range(1, n)]


def exponent(totals: DataFrame, target: Target) -> tuple[float, float, float]:
    """(exponent, sum of the powered shares, budget in tokens) for rows (source, tokens > 0).

    Four bisection steps are one pass over the totals: all points they could visit are evaluated together, so nothing is collected but sums.
    """
    head = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k")).collect()[0]
    total, k = int(head["t"] or 0), int(head["k"])
    if not total:
        return 1.0, 1.0, 0.0
    budget = float(math.floor(min(target.budget, target.max_repeats) * total))
    p = F.col("tokens") / F.lit(float(total))

    def at(points: list[float]) -> list[tuple[float, float, float]]:
        """(sum of powers, entropy, most repeats) at each point."""
        cols = []
        for j, a in enumerate(points):
            cols += [F.sum(F.pow(p, F.lit(a))).alias(f"z{j}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{j}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{j}")]
        r = totals.agg(*cols).collect()[0]
        return [(r[f"z{j}"], math.log(r[f"z{j}"]) - a * r[f"l{j}"] / r[f"z{j}"], budget / total * r[f"m{j}"] / r[f"z{j}"]) for j, a in enumerate(points)]

    goal = target.entropy * math.log(k)
    (_, flat, most), (_, steep, least) = at([0.0, 1.0])
    # invariants: entropy(h_low) >= goal > entropy(h_high); repeats(r_low) > limit >= repeats(r_high)
    h_low, h_high = (1.0, 1.0) if steep >= goal else (0.0, 1.0) if flat >= goal else (0.0, 0.0)
    limit = target.max_repeats * (1 + 1e-12)
    r_low, r_high = (0.0, 0.0) if most <= limit else (0.0, 1.0)
    for _ in range(STEPS // STEPS_AT_ONCE):
        points = sorted({*(_inner(h_low, h_high) if h_low < h_high else []), *(_inner(r_low, r_high) if r_low < r_high else [])})
        if not points:
            break
        found = dict(zip(points, at(points)))
        for _ in range(STEPS_AT_ONCE):
            if h_low < h_high:
                mid = (h_low + h_high) / 2
                if mid in found:
                    h_low, h_high = (mid, h_high) if found[mid][1] >= goal else (h_low, mid)
            if r_low < r_high:
                mid = (r_low + r_high) / 2
                if mid in found:
                    r_low, r_high = (r_low, mid) if found[mid][2] <= limit else (mid, r_high)
    a = round(max(h_low, r_high), 9)
    return a, at([a])[0][0], budget


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each document: id, source, n_tokens, weight (of the source), copies (0 or more passes in which it is drawn), block.

    Windows run over the blocks of a source (a bounded number) and over the one block in which its budget ends, never over a whole source.
    """
    rows = keyed(docs, id_col, source_col, text_col)
    rows = rows.select(
        id_col,
        F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        n_tokens(text_col).alias("n_tokens"),
        F.md5(F.concat_ws(":", F.lit(str(target.seed)), F.col(id_col).cast("string")).cast("binary")).alias("h"),
    )
    rows = materialize(rows.withColumn("block", F.conv(F.substring("h", 1, BLOCK_DIGITS), 16, 10).cast("int")))
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    blocks = materialize(blocks)
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    real = materialize(totals.filter("tokens > 0"))
    a, z, budget = exponent(real, target)
    total = F.lit(float(real.agg(F.sum("tokens")).collect()[0][0] or 1))
    weight = F.pow(F.col("tokens") / total, F.lit(a)) / F.lit(z)
    plan = real.select("source", "tokens", weight.alias("weight")).withColumn("budget", F.floor(F.col("weight") * F.lit(budget) + F.lit(SLACK)))
    plan = plan.select("source", "weight", F.floor(F.col("budget") / F.col("tokens")).alias("passes"), (F.col("budget") % F.col("tokens")).alias("left"))
    before = F.sum("tokens").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")
    dealt = blocks.withColumn("before", before).join(plan, "source", "left")
    dealt = materialize(dealt.select("source", "block", "weight", F.coalesce("passes", F.lit(0)).alias("passes"), (F.coalesce("left", F.lit(-1)) - F.col("before")).alias("room"), "tokens"))
    if real.count() <= BROADCAST_SOURCES:
        # a block is whole, cut or empty by its number alone, so a row for each source says it all
        cut = dealt.groupBy("source").agg(
            F.first("weight").alias("weight"), F.first("passes").alias("passes"), F.coalesce(F.max(F.when(F.col("room") >= F.col("tokens"), F.col("block"))), F.lit(-1)).alias("whole"), F.min(F.when(F.col("room") < F.col("tokens"), F.struct("block", "room"))).alias("cut")
        )
        whole = F.when(F.col("cut").isNull() | (F.col("block") < F.col("cut.block")), F.lit(1)).when(F.col("block") == F.col("cut.block"), F.lit(None)).otherwise(F.lit(0))
        placed = rows.join(F.broadcast(cut), "source").withColumn("extra", whole).withColumn("room", F.col("cut.room")).drop("cut", "whole")
    else:
        whole = F.when(F.col("room") >= F.col("tokens"), F.lit(1)).when(F.col("room") > 0, F.lit(None)).otherwise(F.lit(0))
        placed = rows.join(dealt, ["source", "block"]).withColumn("extra", whole).drop("tokens")
    full = placed.filter("extra is not null")
    upto = F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy("h", id_col).rowsBetween(W.unboundedPreceding, W.currentRow))
    cut_rows = placed.filter("extra is null").withColumn("extra", F.when(upto <= F.col("room"), F.lit(1)).otherwise(F.lit(0)))
    drawn = full.unionByName(cut_rows)
    return drawn.select(id_col, "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("passes") + F.col("extra")).cast("long").alias("copies"), F.col("block").cast("long").alias("block"))


def draws(mixed: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row for each copy of a mixed document: id, source, pass and a key in whose order the mixture is read."""
    copies = mixed.filter("copies > 0").select(id_col, "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("pass"))
    return copies.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.col(id_col).cast("string")).cast("binary")))


def oracle(target: Target = Target(), source: str = "documents") -> str:
    """The same mix in DuckDB SQL, bisected by a recursive query."""
    return f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '{NO_SOURCE}') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5('{target.seed}:' || doc_id) AS h FROM {source} WHERE doc_id IS NOT NULL),
s AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(t) AS t, count(*) AS k, floor({min(target.budget, target.max_repeats)!r} * sum(t)) AS b FROM s),
p AS (SELECT source, s.t AS t, s.t / tot.t AS p, b, tot.t AS total, {target.entropy!r} * ln(k) AS goal FROM s, tot),
ends AS (SELECT (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) FROM p) AS steep, (SELECT ln(count(*)) FROM p) AS flat, (SELECT max(b / total / p) / count(*) FROM p) AS most, (SELECT max(goal) FROM p) AS goal),
bi AS (
  SELECT 0 AS i, CASE WHEN steep >= goal THEN 1.0 ELSE 0.0 END::DOUBLE AS hl, CASE WHEN steep >= goal OR flat >= goal THEN 1.0 ELSE 0.0 END::DOUBLE AS hh,
         0.0::DOUBLE AS rl, CASE WHEN most <= {target.max_repeats!r} * (1 + 1e-12) THEN 0.0 ELSE 1.0 END::DOUBLE AS rh FROM ends
  UNION ALL
  SELECT i + 1, CASE WHEN hok THEN (hl + hh) / 2 ELSE hl END, CASE WHEN hok THEN hh ELSE (hl + hh) / 2 END,
         CASE WHEN rok THEN rl ELSE (rl + rh) / 2 END, CASE WHEN rok THEN (rl + rh) / 2 ELSE rh END
  FROM (SELECT bi.i, hl, hh, rl, rh,
               ln(sum(pow(p, (hl + hh) / 2))) - (hl + hh) / 2 * sum(pow(p, (hl + hh) / 2) * ln(p)) / sum(pow(p, (hl + hh) / 2)) >= max(goal) AS hok,
               max(b) / max(total) * max(pow(p, (rl + rh) / 2 - 1)) / sum(pow(p, (rl + rh) / 2)) <= {target.max_repeats!r} * (1 + 1e-12) AS rok
        FROM bi, p WHERE bi.i < {STEPS} GROUP BY bi.i, hl, hh, rl, rh)),
ex AS (SELECT round(greatest(hl, rh), 9) AS a FROM bi WHERE i = (SELECT max(i) FROM bi)),
z AS (SELECT a, sum(pow(p, a)) AS z FROM p, ex GROUP BY a),
pl AS (SELECT source, t, pow(p, a) / z AS weight, floor(pow(p, a) / z * b + {SLACK!r}) AS budget FROM p, z),
c AS (SELECT d.*, coalesce(weight, 0) AS weight, coalesce(floor(budget / t), 0) AS passes, coalesce(budget - t * floor(budget / t), 0) AS left_over,
             sum(n_tokens) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto, pl.t AS t
      FROM d LEFT JOIN pl ON d.source = pl.source)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(weight AS DOUBLE) AS weight,
       CAST(passes + CASE WHEN upto <= left_over AND t IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS copies, CAST(('0x' || substr(h, 1, {BLOCK_DIGITS})) AS BIGINT) AS block
FROM c"""
