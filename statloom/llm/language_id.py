"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts are summed by Spark into one matrix of ``2 ** bits`` hashed n-grams by language; its size depends on those two
parameters alone. The log-probabilities are sent to the tasks, which score whole texts in numpy.

Defined results: a null text, an empty text or one without a letter is ``und`` with score 0. Rows with a null label are not learned from.
Rows are scored one by one, so repeated or null ids and columns of the same names as the results do no harm. Without any
learned label every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.frames import fresh, ship
from statloom.llm.text import pieces, utf8

ORDERS = (1, 2, 3)
#: The model learns from about this many labelled rows at most: an equal share for each label, those with the smallest hashes of their ids, one at least.
MAX_TRAINING_ROWS = 20_000
#: Hashed n-grams, as a power of two: so many, or as many as keep the matrix (n-grams by languages) at ``MATRIX`` cells, ``LEAST_BITS`` at least.
BITS, LEAST_BITS, MATRIX = 18, 10, 1 << 26
UNDETERMINED = "und"

_U32 = np.uint32


def _code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of documents, A-Z folded, two zeros after each document, and each one's start."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(_U32)
    size = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
    cp = np.where(size == 1, first, np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        cp[more] = (cp[more] << _U32(6)) | (data[at[more] + k] & 0x3F)
    cp += ((cp >= 65) & (cp <= 90)).astype(_U32) * _U32(32)
    starts = np.searchsorted(at, offs)
    lens = np.diff(starts)
    out = np.zeros(len(cp) + 2 * len(lens), _U32)
    out[np.arange(len(cp)) + 2 * np.repeat(np.arange(len(lens)), lens)] = cp
    return out, starts[:-1] + 2 * np.arange(len(lens))


def _grams(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hashed n-grams that begin at each position; zeros part documents."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, _U32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * _U32(0x85EBCA6B)
        h ^= h >> _U32(15)
    h *= _U32(0xC2B2AE35)
    return (h >> _U32(32 - bits)).astype(np.int64)


def learned_from(id_col: str, mod: int = 4, held_out: int = 2):
    """Whether a row may be learned from: crc32 of the id as text, modulo ``mod``, is not ``held_out``."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)) != F.lit(held_out)


class Model:
    def __init__(self, languages: list[str], log_probability: np.ndarray, log_prior: np.ndarray, bits: int):
        self.languages, self.log_probability, self.log_prior, self.bits = languages, log_probability, log_prior, bits

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Posterior probability of each language for each document, from the mean evidence of up to 256 n-grams."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        for i, j in pieces(offs):
            points, starts = _code_points(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            total = np.zeros((j - i, len(self.languages)))
            for order in ORDERS:
                grams = _grams(points, order, self.bits)
                at = np.minimum(starts, max(0, len(grams) - 1))
                for k in range(len(self.languages)):
                    total[:, k] += np.add.reduceat(self.log_probability[k][grams], at) if len(grams) else 0
            n = np.diff(np.append(starts, len(points))) * len(ORDERS)
            evidence = total * np.minimum(1.0, 256.0 / np.maximum(n, 1))[:, None] + self.log_prior
            evidence -= evidence.max(axis=1, keepdims=True)
            p = np.exp(evidence)
            out[i:j] = p / p.sum(axis=1, keepdims=True)
        return out


def matrix_bits(languages: int, bits: int = BITS) -> int:
    """Fewer hashed n-grams for very many languages, so that the matrix stays bounded and no language is left out."""
    return max(min(bits, LEAST_BITS), min(bits, (MATRIX // max(languages, 1)).bit_length() - 1))


def _sampled(rows: DataFrame, labels: list, max_rows: int) -> DataFrame:
    """An equal share of ``max_rows`` for each label by the smallest hashes; ``labels`` has label, count and least hash."""
    share = max(1, max_rows // len(labels))
    cut = [r for r in labels if r["count"] > share]
    if not cut:
        return rows
    # of n even hashes, those below share / n of their range are about the `share` smallest; the least one always counts
    bound = [(r["label"], max(r["least"], -(1 << 63) + (share * (1 << 64)) // r["count"])) for r in cut]
    bounds = rows.sparkSession.createDataFrame(bound, "label string, bound long")
    return rows.join(F.broadcast(bounds) if len(bound) <= 100_000 else bounds, "label", "left").filter("bound is null or hash <= bound").drop("bound")


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, max_rows: int = MAX_TRAINING_ROWS, held_out: tuple[int, int] | None = (4, 2)) -> Model:
    """Learn from the labelled rows that ``held_out`` = (modulus, remainder) leaves, about ``max_rows`` of them, stratified by label.

    Every label is learned, from one row at least; the priors are the labels' shares of all these rows, not of the sample.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("id is not null and label is not null and text is not null")
    if held_out:
        rows = rows.filter(learned_from("id", *held_out))
    rows = rows.withColumn("hash", F.xxhash64("id"))
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min("hash").alias("least")).orderBy("label").collect()
    languages = [r["label"] for r in labels]
    bits = matrix_bits(len(languages), bits)
    if not languages:
        return Model([], np.zeros((0, 1 << bits), np.float32), np.zeros(0), bits)
    rows = _sampled(rows, labels, max_rows)
    place = {x: k for k, x in enumerate(languages)}
    slices, width = 16, (1 << bits) // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 1 << bits), np.int64)
        seen = False
        for batch in batches:
            label = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for k in np.unique(label):
                seen = True
                data, offs = utf8(batch.column(1).filter(pa.array(label == k)))
                for i, j in pieces(offs):
                    points, _ = _code_points(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    for order in ORDERS:
                        sums[k] += np.bincount(_grams(points, order, bits), minlength=1 << bits)
        if seen:
            part = sums.reshape(len(languages), slices, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([np.ascontiguousarray(part[:, s]).tobytes() for s in range(slices)], pa.binary())], names=["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in group.column("counts"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([sums.tobytes()], pa.binary())})

    schema = "slice int, counts binary"
    got = rows.select("label", "text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()
    counts = np.zeros((len(languages), slices, width))
    for r in got:
        counts[:, r["slice"]] = np.frombuffer(r["counts"], np.int64).reshape(len(languages), width)
    counts = counts.reshape(len(languages), 1 << bits)
    log_probability = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * (1 << bits)))
    prior = np.array([r["count"] for r in labels], np.float64) + 1
    return Model(languages, log_probability.astype(np.float32), np.log(prior / prior.sum()), bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``id_col``, the columns ``keep`` and two more for every row, the language and its score; one narrow pass. Columns kept must not have those ``names``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    has_letter = fresh(docs, "letter")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c) for c in keep if c not in (id_col, text_col)], F.col(text_col).cast("string").alias(text_col), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(has_letter))
    fields = [f for f in rows.schema.fields if f.name != has_letter and (f.name != text_col or text_col in keep)]
    kept = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{names[0]}` string", f"`{names[1]}` double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            letter = np.array(batch.column(has_letter))
            if own.languages:
                p = own.score(*utf8(batch.column(text_col)))
                best = p.argmax(axis=1)
                languages = np.where(letter, np.array(own.languages, object)[best], UNDETERMINED)
                scores = np.where(letter, p[np.arange(len(best)), best], 0.0)
            else:
                languages, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    return rows.mapInArrow(score, schema)
