"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of the vectors, span a grid of cells. Every vector is filed under the cell of its nearest codewords, every
vector visits the cells nearest to it in multi-sequence order (by the sum of both halves' distances), and what it meets there is verified
by cosine in double precision. How many cells are visited is the smallest number whose recall on a stated query set, compared with all rows,
reaches the target. A pair is found if either vector visits the other's cell, and counts once for each. Where ``MOST_VISITS`` cells miss the
target (a large group of near copies draws codewords and spreads over many cells), all vectors of a label are compared exactly in blocks.

Equal vectors of a label are one class with a multiplicity. Cells that hold or attract many vectors are dealt to several tasks as blocks of
members times visitors.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, and a row with a null label link with
nothing. Vectors of different lengths are never compared. Rows that repeat an id count as one (see ``frames.keyed``), rows with a null
id are left out. Other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.frames import components, keyed, materialize, ship

THRESHOLD = 0.93
TARGET_RECALL = 0.995
#: Codebooks are fitted on at most so many vectors, those with the smallest hash of their id; every vector is indexed.
SAMPLE = 8192
#: Recall is measured on vectors whose id is divisible by this, which the codebooks are not fitted on, each compared with all rows.
QUERY_IDS = 50
#: So many of them at a time, by the smallest hash of their id.
QUERIES = 1024
#: So many queries must have a link; otherwise more rows are queries.
LINKED = 100
#: From so many visits on, exact blocks cost less than tours; the index is not used if its recall is still below the target.
MOST_VISITS = 64
#: Vectors a cell should hold, and the most that one side of a block holds.
PER_CELL, BLOCK = 32, 256
#: Vectors that one side of an exact block holds.
EXACT_BLOCK = 2048
MOST_CODES = 512


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]) if len(column) else np.zeros((0, size))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label and the vector scaled to length 1 as doubles (null if it links with nothing)."""
    for batch in batches:
        out = []
        for x, label in zip(batch.column(1), batch.column(2)):
            unit = None
            if x.is_valid and label.is_valid and len(x.values) and not x.values.null_count:
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                # first by the largest component, so that squares neither overflow nor vanish
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    unit = (v / np.sqrt((v * v).sum()) + 0.0).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["id", "label", "vec"])


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means from evenly spaced rows; a codeword that loses all rows stays where it is."""
    code = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, code).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(code)
        np.add.at(total, near, x)
        live = count > 0
        code[live] = total[live] / count[live, None]
    return code


def _distances(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (code * code).sum(1)[None, :] - 2 * x @ code.T, 0)


class Index:
    """Codebooks of both halves; cell = first code * number of second codes + second code."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.first, self.second = (_means(sample[:, : self.half], min(k, len(sample))), _means(sample[:, self.half :], min(k, len(sample))))

    def sequence(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each row, nearest first (fewer if the grid is smaller).

        The n nearest sums use only ranks (i, j) with (i + 1) * (j + 1) <= n, so both halves' n nearest codes hold them.
        """
        a, b = _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)
        visits = min(visits, a.shape[1] * b.shape[1])
        m, n = min(visits, a.shape[1]), min(visits, b.shape[1])
        i, j = np.argsort(a, axis=1, kind="stable")[:, :m], np.argsort(b, axis=1, kind="stable")[:, :n]
        p, q = np.nonzero((np.arange(m)[:, None] + 1) * (np.arange(n)[None, :] + 1) <= visits)
        rows = np.arange(len(x))[:, None]
        total = a[rows, i][:, p] + b[rows, j][:, q]
        order = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return i[rows, p[order]].astype(np.int64) * len(self.second) + j[rows, q[order]]


def _batched(x: np.ndarray, index: Index, visits: int, rows: int = 1024) -> np.ndarray:
    return np.concatenate([index.sequence(x[a : a + rows], visits) for a in range(0, len(x), rows)]) if len(x) else np.zeros((0, 1), np.int64)


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, digest) of all rows, and classes (id = smallest, label, vec, size, h) of those that can link."""
    rows = keyed(vectors, id_col, vec_col, label_col).select(F.col(id_col).alias("id"), F.col(vec_col), F.col(label_col).cast("string").alias("label"))
    unit = rows.mapInArrow(_unit, "id long, label string, vec binary")
    unit = materialize(unit.withColumn("digest", F.md5("vec")))
    classes = unit.filter("vec is not null").groupBy("label", "digest").agg(F.min(F.struct("id", "vec")).alias("r"), F.count(F.lit(1)).alias("size"))
    return unit.select("id", "label", "digest"), materialize(classes.select("r.id", "label", "digest", "r.vec", "size", F.xxhash64("r.id").alias("h")))


def _sample(classes: DataFrame, n: int, total: int, queries: bool) -> list:
    """About ``n`` classes by the smallest hashes, of the ids that are queries or of all others; the hash bound leaves no more than the driver can hold."""
    own = F.col("id") % F.lit(QUERY_IDS) == F.lit(0)
    share = min(1.0, 1.2 * n * (QUERY_IDS if queries else 1) / max(total, 1))
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    return classes.filter(own if queries else ~own).filter(F.col("h") <= F.lit(limit)).orderBy("h", "id").limit(n).select("id", "label", "vec").collect()


def _ranks(classes: DataFrame, index: Index, queries: list, threshold: float, size: int) -> np.ndarray:
    """Of each query, compared with all rows of its label, how many links each further visit meets; the last column are those never met."""
    vecs = np.stack([np.frombuffer(r["vec"], np.float64) for r in queries])
    width = MOST_VISITS + 1
    shared = classes.sparkSession.sparkContext.broadcast((index, [r["id"] for r in queries], [r["label"] for r in queries], vecs, _batched(vecs, index, MOST_VISITS)))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, labels, q, seq = shared.value
        found = np.zeros(len(ids) * width, np.int64)
        labels, ids = np.array(labels), np.array(ids)
        step = max(1, (1 << 21) // len(ids))
        for batch in batches:
            x, label, key = _matrix(batch.column("vec"), size), np.array(batch.column("label").to_pylist()), np.array(batch.column("id"))
            cells = _batched(x, own, 1)[:, 0]
            for a in range(0, len(x), step):
                s = slice(a, a + step)
                hit = (q @ x[s].T >= threshold) & (labels[:, None] == label[s][None, :]) & (ids[:, None] != key[s][None, :])
                i, j = np.nonzero(hit)
                at = seq[i] == cells[s][j][:, None]
                found += np.bincount(i * width + np.where(at.any(1), at.argmax(1), width - 1), minlength=len(found))
        live = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(found[live])], names=["at", "n"])

    n = np.zeros(len(queries) * width, np.int64)
    for r in classes.mapInArrow(ranks, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        n[r["at"]] = r["n"]
    return n.reshape(-1, width)


def _need(n: np.ndarray, target: float) -> tuple[int, float]:
    """(visits, recall): the fewest visits for which both the recall over all links and the mean recall of the queries reach the target.

    A hot group's links grow with its square, so that they alone would decide the first.
    """
    n = n[n.sum(1) > 0]
    if not len(n):
        return 2, 1.0
    met = np.cumsum(n[:, :-1], axis=1)
    reach = np.minimum(met.sum(0) / n.sum(), (met / n.sum(1)[:, None]).mean(0))
    enough = np.flatnonzero(reach >= target)
    visits = max(2, int(enough[0]) + 1 if len(enough) else reach.size)
    return visits, float(reach[min(visits, reach.size) - 1])


def _recall_visits(classes: DataFrame, index: Index, queries: list, threshold: float, target: float, size: int, total: int) -> tuple[int, float]:
    """(visits, recall) by ``_need``, each query compared with all rows of its label.

    If fewer than ``LINKED`` queries have a link, further rows are queries until so many have one or all rows were compared.
    A recall below the target says that ``MOST_VISITS`` cells are not enough.
    """
    n = _ranks(classes, index, queries, threshold, size) if queries else np.zeros((0, MOST_VISITS + 1), np.int64)
    if (n.sum(1) > 0).sum() < LINKED and len(queries) < total:
        n, pieces = n[:0], -(-total // SAMPLE)
        bound = [-(2**63) + (2**64 * k) // pieces for k in range(pieces + 1)]
        for low, high in zip(bound, bound[1:]):
            more = classes.filter((F.col("h") >= F.lit(low)) & (F.col("h") <= F.lit(high - 1))).select("id", "label", "vec").collect()
            if more:
                got = _ranks(classes, index, more, threshold, size)
                n = np.concatenate([n, got[got.sum(1) > 0]])
            if len(n) >= LINKED:
                break
    return _need(n, target)


def _file(shared, visits: int, size: int):
    """Each class as a member of its cell and as a visitor of the nearest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = _matrix(batch.column("vec"), size)
            seq = _batched(x, index, visits)
            tour = [s.tobytes() for s in seq]
            for k in range(-1, seq.shape[1]):
                cell, visitor = (seq[:, 0], False) if k < 0 else (seq[:, k], True)
                columns = [batch.column("id"), batch.column("label"), pa.array(cell), pa.array(np.full(len(x), visitor)), batch.column("size"), pa.array(tour, pa.binary()), batch.column("vec")]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "cell", "visitor", "size", "tour", "vec"])

    return run


def _meet(threshold: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Links of one block: how many rows each class gains, and edges that connect the linked."""
        visitor = np.array(group.column("visitor"))
        ids, size = np.array(group.column("id")), np.array(group.column("size"))
        tour = [np.frombuffer(t.as_buffer(), np.int64) for t in group.column("tour")]
        v, m = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        gain, a, b = np.zeros(len(ids), np.int64), [], []
        if len(v) and len(m):
            vec = _matrix(group.column("vec"), 0)
            i, j = np.nonzero(vec[v] @ vec[m].T >= threshold)
            i, j = v[i], m[j]
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            home = np.array([t[0] for t in tour])
            tours = np.stack(tour)
            both = (tours[j] == home[i][:, None]).any(1)  # then the member finds this visitor itself
            np.add.at(gain, i, size[j])
            np.add.at(gain, j[~both], size[i[~both]])
            order = np.lexsort((ids[j], ids[i]))
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(ids[i[order]].tolist(), ids[j[order]].tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            pairs = [(x, find(x)) for x in root if find(x) != x]
            a, b = [p for p, _ in pairs], [q for _, q in pairs]
        live = np.flatnonzero(gain)
        return pa.table({"a": pa.array([*ids[live].tolist(), *a], pa.int64()), "b": pa.array([None] * len(live) + b, pa.int64()), "gain": pa.array([*gain[live].tolist(), *[0] * len(a)], pa.int64())})

    return run


def _deal(blocks: dict[str, int]):
    """Each class as a row of the blocks (i, j), i <= j, of its label in which its own part is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([blocks[x] for x in batch.column("label").to_pylist()], np.int64)
            part = np.array(batch.column("h")) % n
            for k in range(int(n.max(initial=0))):
                live = np.flatnonzero(n > k)
                own = batch.select(["id", "label", "size", "vec"]).take(pa.array(live))
                i, j = np.minimum(part[live], k), np.maximum(part[live], k)
                columns = [*own.columns, pa.array(part[live]), pa.array(i), pa.array(j)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "size", "vec", "part", "i", "j"])

    return run


def _compare(threshold: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Links of one exact block: how many rows each class gains, and edges that connect the linked."""
        ids, size, part = (np.array(group.column(c)) for c in ("id", "size", "part"))
        i, j = key[1].as_py(), key[2].as_py()
        x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
        gain, root = np.zeros(len(ids), np.int64), ids.copy()
        if len(x) and len(y):
            vec = _matrix(group.column("vec"), 0)
            hit = vec[x] @ vec[y].T >= threshold
            if i == j:
                np.fill_diagonal(hit, False)
            gain[x] += hit @ size[y]
            if i != j:
                gain[y] += hit.T @ size[x]
            far = np.iinfo(np.int64).max
            while True:  # the smallest id spreads along links until nothing changes
                before = root.copy()
                for a in range(0, len(x), 256):
                    s = x[a : a + 256]
                    h = hit[a : a + 256]
                    root[s] = np.minimum(root[s], np.where(h, root[y][None, :], far).min(1))
                    root[y] = np.minimum(root[y], np.where(h, root[s][:, None], far).min(0))
                if (root == before).all():
                    break
        live, tied = np.flatnonzero(gain), np.flatnonzero(root != ids)
        a, b = [*ids[live].tolist(), *ids[tied].tolist()], [None] * len(live) + root[tied].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "gain": pa.array([*gain[live].tolist(), *[0] * len(tied)], pa.int64())})

    return run


def _exact(classes: DataFrame, threshold: float) -> DataFrame:
    """As ``_links``, every class compared with all others of its label."""
    blocks = {r["label"]: -(-r["n"] // EXACT_BLOCK) for r in classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = classes.select("id", "label", "size", "vec", "h").mapInArrow(_deal(blocks), "id long, label string, size long, vec binary, part long, i long, j long")
    return dealt.groupBy("label", "i", "j").applyInArrow(_compare(threshold), "a long, b long, gain long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    rows, classes = _classes(vectors, id_col, vec_col, label_col)
    lengths = [r[0] for r in classes.select(F.octet_length("vec")).distinct().orderBy(F.octet_length("vec")).collect()]
    found = [_links(classes.filter(F.octet_length("vec") == n), n // 8, threshold, target) for n in lengths]
    if not found:
        alone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return alone
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    links = materialize(links)
    gains = links.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("gain").alias("gain"))
    roots = components(links.filter("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    own = classes.select("label", "digest", F.col("id").alias("rep"), "size").join(gains, "rep", "left").join(roots, "rep", "left")
    own = own.select("label", "digest", (F.coalesce("gain", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = rows.join(own, ["label", "digest"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"), (F.coalesce("root", "id") == F.col("id")).alias("kept"))


def _links(classes: DataFrame, size: int, threshold: float, target: float) -> DataFrame:
    """(a, null, gain) and edges (a, b, 0) among classes of vectors of one length."""
    spark = classes.sparkSession
    total = classes.count()
    sample = _sample(classes, SAMPLE, total, queries=False)
    if not sample:
        sample = classes.limit(SAMPLE).select("id", "label", "vec").collect()
    k = int(np.clip(np.ceil(np.sqrt(total / PER_CELL)), 1, MOST_CODES))
    index = Index(np.stack([np.frombuffer(r["vec"], np.float64) for r in sample]), k)
    visits, reached = _recall_visits(classes, index, _sample(classes, QUERIES, total, queries=True), threshold, target, size, total)
    logging.getLogger(__name__).info("recall %.5f of the links of the query set with %d visits", reached, visits)
    if reached < target:
        return _exact(classes, threshold)
    shared = spark.sparkContext.broadcast(index)
    filed = classes.select("id", "label", "vec", "size").mapInArrow(_file(shared, visits, size), "id long, label string, cell long, visitor boolean, size long, tour binary, vec binary")
    filed = materialize(filed)
    crowd = filed.groupBy("label", "cell").agg(F.count_if("visitor").alias("v"), F.count_if(~F.col("visitor")).alias("m")).filter("v > 0 and m > 0")
    pieces = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("long")
    crowd = crowd.select("label", "cell", pieces("v").alias("vs"), pieces("m").alias("ms")).filter("vs * ms > 1")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(n, F.lit(1)).cast("long"))
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1)
    dealt = filed.join(crowd, ["label", "cell"], "left")
    dealt = dealt.withColumn("i", F.when(F.col("visitor"), all_of(F.col("ms"))).otherwise(F.array(slot(F.col("ms")))))
    dealt = dealt.withColumn("j", F.when(F.col("visitor"), F.array(slot(F.col("vs")))).otherwise(all_of(F.col("vs"))))
    dealt = dealt.drop("ms", "vs").withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    return dealt.groupBy("label", "cell", "i", "j").applyInArrow(_meet(threshold), "a long, b long, gain long")


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> float:
    """Share of the true links of ids divisible by 50 that ``found`` counts, against brute force over all rows."""
    rows, classes = _classes(vectors, id_col, vec_col, label_col)
    q = [r for r in rows.filter("id % 50 = 0").join(classes.select("label", "digest", "vec"), ["label", "digest"]).select("id", "label", "vec").collect()]
    if not q:
        return 1.0
    ids, labels, x = [r["id"] for r in q], np.array([r["label"] for r in q]), np.stack([np.frombuffer(r["vec"], np.float64) for r in q])

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            y, label, size = _matrix(batch.column("vec"), 0), np.array(batch.column("label").to_pylist()), np.array(batch.column("size"))
            for a in range(0, batch.num_rows, 2048):
                s = slice(a, a + 2048)
                total += ((x @ y[s].T >= threshold) & (labels[:, None] == label[s][None, :])) @ size[s]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    ship(vectors.sparkSession)
    true = classes.select("label", "vec", "size").mapInArrow(count, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    r = true.join(found.withColumnRenamed(id_col, "id"), "id").agg(F.sum("n").alias("all"), F.sum(F.least("n", "n_links")).alias("got")).collect()[0]
    return 1.0 if not r["all"] else r["got"] / r["all"]
