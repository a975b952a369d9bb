"""N-gram Jaccard join by signature trees.

Documents are sets of hashed word shingles. Equal sets are one class. Classes that can have a partner at all are found by a prefix
filter: the smallest hashes of two linked sets share at least some of their members, so a class whose prefix shares too few with any other is
done. The others fall into blocks (connected through the rarest of the shared hashes), which deal the work and decide no link. In every block,
leaves of documents and the nodes above them hold OR- and AND-combined bitmaps and size ranges; a dual traversal drops node pairs whose largest
possible overlap is too small, and the remaining pairs of leaves are compared exactly. In large blocks, documents linked with one pivot are
known to be connected, and nodes that hold only such documents are not compared with each other.

Nothing is capped, every bound is a bound, and links are decided on whole sets. Shingles and sets are compared by hash: 64 bits for a
shingle within a pair, 128 bits for equal sets.

Defined results: a null or empty text, or one without words, has the empty set and is linked with nothing. With fewer words than a
shingle the whole sequence is the one shingle. Rows that repeat an id count as one document (see ``frames.keyed``), rows with a null id
are left out. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import text as tx
from statloom.llm.frames import components, keyed, materialize, parts, ship, slices

SHINGLE = 5
#: Two sets link when NUM * intersection >= DEN * union: a similarity of 0.8.
NUM, DEN = 100, 80
#: Sets in a leaf that one task compares, and in a leaf of the tree within that task.
LEAF, SMALL_LEAF = 128, 8
FANOUT = 8
#: Rounds in which blocks above ``LEAF`` sets are thinned by a pivot; what is left unattached goes through the tree all the same.
PIVOTS = 4
#: Members that the prefixes of two linked sets share at least, where that many are sure to be shared.
SHORT = 64
BITS = 2048
_U = np.uint64
_WORDS = tx.word_table(tx.SPACE_BYTES)


def _at_least(n: np.ndarray) -> np.ndarray:
    """The smallest intersection that a set of ``n`` can have with a linked set, and the size the linked set must have."""
    return (n * DEN + NUM - 1) // NUM


def _shared_least(n: np.ndarray) -> np.ndarray:
    """How many members the prefixes of two linked sets share, the smaller of them of size ``n``.

    Short sets send (nearly) all members: a few common phrases in a short prefix would make candidates of them, and one block of all such.
    """
    return np.maximum(np.minimum(_at_least(n), SHORT), n // 10)


def _size_code(n: np.ndarray) -> np.ndarray:
    """A size as one byte, rounded down; ``_code_size`` gives the smallest size of a code."""
    return np.searchsorted(_SIZES, n, "right") - 1


_SIZES = np.unique(np.concatenate([np.arange(0, 128), np.floor(128 * 1.09 ** np.arange(0, 128))]).astype(np.int64))[:256]
#: The largest size of each code.
_LARGEST = np.append(_SIZES[1:] - 1, np.iinfo(np.int64).max // (2 * NUM))


def _runs(token: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (hash, class), each once: hash, class and number of classes, for the classes that meet another of a size they can link with.

    Classes of one hash are parted where the next larger one is too large for the one before; no link crosses such a gap, and each run has a hash of its own.
    """
    code = (own & _U(0xFF)).astype(np.int64)
    order = np.lexsort((own, code, token))
    token, own, code = token[order], own[order], code[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
    token, own, code = token[new], own[new], code[new]
    head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (_LARGEST[code[:-1]] < _at_least(_SIZES[code[1:]]))]))
    count = np.diff(np.append(head, len(token)))
    token = tx.mix(token ^ (np.repeat(code[head], count).astype(_U) << _U(56)))
    count = np.repeat(count, count)
    keep = count >= 2
    return token[keep], own[keep], count[keep].astype(np.uint32)


def document_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and offsets, for consecutive documents."""
    sets, ends, base = [], [np.zeros(1, np.int64)], 0
    for i, j in tx.pieces(offs):
        words, first = tx.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], _WORDS, tx.byte_codes())
        own, at = tx.shingle_sets(words, first, SHINGLE)
        sets.append(own)
        ends.append(at[1:] + base)
        base += len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate(ends)


def _class_keys(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; the last byte of the first is the size code."""
    n = np.diff(offs)
    out = []
    for salt in (0x9AE16A3B2F90404F, 0xD1B54A32D192ED03):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(tx.mix(sets ^ _U(salt)))])
        out.append(tx.mix((total[offs[1:]] - total[offs[:-1]]) + n.astype(_U)))
    first = (out[0] & ~_U(0xFF)) | _size_code(n).astype(_U)
    return first, out[1]


_SCHEMA = "key long, kind int, a binary, b binary, c binary"


def _rows(key, kind, a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["key", "kind", "a", "b", "c"])


def _prefixes(n_parts: int):
    """Map: each batch of documents gives one blob of (prefix hash, class) for each part, and one of (id, class, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3000):
            ids = np.array(batch.column(0), np.int64)
            if not len(ids):
                continue
            sets, offs = document_sets(*tx.utf8(batch.column(1)))
            n = np.diff(offs)
            k1, k2 = _class_keys(sets, offs)
            meta = np.stack([ids, k1.view(np.int64), k2.view(np.int64), n], 1).tobytes()
            yield _rows([int(ids[0])], [1], [meta], [None], [None])
            _, rep = np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)  # equal sets of the batch speak once
            rep = np.sort(rep[n[rep] > 0])
            size = n[rep] - _at_least(n[rep]) + _shared_least(n[rep])
            start = offs[rep]
            at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            token, own = sets[at], np.repeat(k1[rep], size)
            # the smallest hashes are the prefix, so parts are dealt by bits that have no part in the order
            part = (tx.mix(token) % _U(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            token, own, part = tx.mix(token)[order] // _U(n_parts), own[order], part[order]
            cut = np.searchsorted(part, np.arange(n_parts + 1))
            short = token & _U(0xFFFFFFFFFF)  # 40 bits: two hashes taken for one only cost work
            hi, lo = (short >> _U(8)).astype(np.uint32), (short & _U(0xFF)).astype(np.uint8)
            live = np.flatnonzero(np.diff(cut))
            yield _rows(live, np.zeros(len(live), int), [hi[cut[p] : cut[p + 1]].tobytes() for p in live], [lo[cut[p] : cut[p + 1]].tobytes() for p in live], [own[cut[p] : cut[p + 1]].tobytes() for p in live])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], kind: int):
    """Of a partition sorted by key: (key, [(a, b, c), ...]) of the rows of ``kind``, one key at a time, and other rows as batches.

    Memory follows one key, not the partition.
    """
    key, found = None, []
    for batch in batches:
        kinds = np.array(batch.column("kind"))
        other = np.flatnonzero(kinds != kind)
        if len(other):
            yield None, batch.take(pa.array(other))
        keys = np.array(batch.column("key"), np.int64)
        for r in np.flatnonzero(kinds == kind).tolist():
            if keys[r] != key and found:
                yield key, found
                found = []
            key = int(keys[r])
            found.append(tuple(batch.column(c)[r].as_buffer().to_pybytes() if batch.column(c)[r].is_valid else b"" for c in "abc"))
    if found:
        yield key, found


#: Entries that a task packs before it sends them on.
PACK = 1 << 19


def _shared(n_parts: int):
    """Reduce by hash: hashes in the prefixes of two classes or more (of sizes that can link) go on to their classes, with the number of classes.

    Entries (class, hash, count) are packed into a blob for each part of the classes, so the rows follow tasks times parts, not classes times hashes.
    """

    def pack(entries: list) -> pa.RecordBatch:
        token, own, count = (np.concatenate(x) for x in zip(*entries))
        part = (tx.mix(own) % _U(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        token, own, count = token[order], own[order], count[order]
        cut = np.searchsorted(part[order], np.arange(n_parts + 1))
        live = np.flatnonzero(np.diff(cut))
        return _rows(live, np.full(len(live), 2), *[[x[cut[p] : cut[p + 1]].tobytes() for p in live] for x in (token, own, count)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, held = [], 0
        for part, blobs in _by_key(batches, 0):
            if part is None:
                yield blobs
                continue
            token = np.concatenate([(np.frombuffer(a, np.uint32).astype(_U) << _U(8)) | np.frombuffer(b, np.uint8) for a, b, _ in blobs])
            own = np.concatenate([np.frombuffer(c, _U) for *_, c in blobs])
            del blobs
            token |= _U(part & 0x7FFFFF) << _U(40)
            token, own, count = _runs(token, own)
            if len(token):
                entries.append((token, own, count))
                held += len(token)
            if held >= PACK:
                yield pack(entries)
                entries, held = [], 0
        if entries:
            yield pack(entries)

    return run


_ANSWER = "kind int, doc_id long, k1 long, k2 long, n long, tid long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce by class: classes that share enough give their rarest shared hashes; ids, classes and sizes are unpacked."""
    names = ["kind", "doc_id", "k1", "k2", "n", "tid"]

    def out(kind, *columns):
        n = len(next(c for c in columns if c is not None))
        arrays = [pa.array(np.zeros(n, np.int64) if c is None else c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *arrays], names=names)

    for part, found in _by_key(batches, 2):
        if part is None:
            for r in range(found.num_rows):
                m = np.frombuffer(found.column("a")[r].as_buffer(), np.int64).reshape(-1, 4)
                yield out(1, m[:, 0], m[:, 1], m[:, 2], m[:, 3], None)
            continue
        token, key, count = (np.concatenate([np.frombuffer(x[k], t) for x in found]) for k, t in enumerate((_U, np.int64, np.uint32)))
        del found
        order = np.lexsort((token, count, key))
        key, token = key[order], token[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        have = np.diff(np.append(head, len(key)))
        n = _SIZES[(key[head].view(_U) & _U(0xFF)).astype(np.int64)]
        least = _shared_least(_at_least(n))
        rank = np.arange(len(key)) - np.repeat(head, have)
        # two linked classes share `least` of their shared hashes, so the have - least + 1 rarest of each share one
        keep = rank <= np.repeat(have - least, have)
        if keep.any():
            yield out(2, None, key[keep], None, None, token[keep].view(np.int64))


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(tx.mix(tokens) % _U(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(_U)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Node:
    """Sizes low..high, bitmaps all (OR) and both (AND), slack: the most members of a set that share a bit with another.

    root: the component that all sets below are known to be in, if any.
    """

    __slots__ = ("low", "high", "all", "both", "slack", "leaf", "children", "root")

    def __init__(self, low, high, every, both, slack, leaf=None, children=(), root=None):
        self.low, self.high, self.all, self.both, self.slack, self.leaf, self.children, self.root = low, high, every, both, slack, leaf, children, root

    @staticmethod
    def over(children: list[Node]) -> Node:
        every, both = np.bitwise_or.reduce([c.all for c in children]), np.bitwise_and.reduce([c.both for c in children])
        roots = {c.root for c in children}
        return Node(min(c.low for c in children), max(c.high for c in children), every, both, max(c.slack for c in children), children=tuple(children), root=roots.pop() if len(roots) == 1 else None)

    @staticmethod
    def of(size: np.ndarray, maps: np.ndarray, leaf) -> Node:
        return Node(int(size.min()), int(size.max()), np.bitwise_or.reduce(maps), np.bitwise_and.reduce(maps), int((size - _ones(maps)).max()), leaf=leaf)


def possible(x: Node, y: Node) -> bool:
    """Whether a set under ``x`` and one under ``y`` can link, by the largest overlap that sizes and bitmaps allow."""
    if x.high < _at_least(y.low) or y.high < _at_least(x.low):
        return False
    most = min(x.high, y.high, int(_ones(x.all & y.all)) + min(x.slack, y.slack), x.high - int(_ones(x.both & ~y.all)), y.high - int(_ones(y.both & ~x.all)))
    low = max(x.low, _at_least(y.low), 1), max(y.low, _at_least(x.low), 1)
    return NUM * most >= DEN * (max(low[0], most) + max(low[1], most) - most)


def traverse(leaves: list[Node]) -> list[tuple]:
    """Pairs of leaves (each with itself too) that can hold a link: a tree over the leaves, walked against itself."""
    level = sorted(leaves, key=lambda x: (x.root is None, x.root, x.low, x.high))
    while len(level) > 1:
        level = [Node.over(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    found, todo = [], [(level[0], level[0])]
    while todo:
        x, y = todo.pop()
        if x.root is not None and x.root == y.root or x is not y and not possible(x, y):
            continue
        if x.leaf is not None and y.leaf is not None:
            found.append((x.leaf, y.leaf))
        elif x is y:
            todo += [(a, b) for i, a in enumerate(x.children) for b in x.children[i:]]
        elif y.leaf is not None:
            todo += [(a, y) for a in x.children]
        else:
            todo += [(x, b) for b in y.children] if x.leaf is not None else [(a, b) for a in x.children for b in y.children]
    return found


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, id, whole set and bitmap of each member, and how many members its block has."""
    for batch in slices(batches, 1000):
        sets, offs = document_sets(*tx.utf8(batch.column("text")))
        own = [sets[offs[i] : offs[i + 1]] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("whole"), batch.column("id"), pa.array([s.tobytes() for s in own], pa.binary()), pa.array([_bitmap(s).tobytes() for s in own], pa.binary())], names=["block", "whole", "id", "tokens", "bitmap"])


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _U) for x in column]


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large blocks with the pivot they are linked with, if they are."""
    for batch in batches:
        root = []
        for x, y, pivot in zip(_sets(batch.column("tokens")), _sets(batch.column("pivot_tokens")), batch.column("pivot").to_pylist()):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            root.append(pivot if NUM * shared >= DEN * (len(x) + len(y) - shared) else None)
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("id"), pa.array(root, pa.int64())], names=["block", "id", "root"])


def _leaf(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    size = np.array([len(x.as_buffer()) // 8 for x in group.column("tokens")])
    node = Node.of(size, np.stack(_sets(group.column("bitmap"))), None)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "leaf": pa.array([key[1].as_py()], pa.int64()), "root": pa.array([group.column("root")[0].as_py()], pa.int64()), "low": [node.low], "high": [node.high], "slack": [node.slack], "every": [node.all.tobytes()], "both": [node.both.tobytes()]})


def _walk(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    nodes = [Node(r["low"], r["high"], np.frombuffer(r["every"], _U), np.frombuffer(r["both"], _U), r["slack"], leaf=r["leaf"], root=r["root"]) for r in group.to_pylist()]
    found = traverse(nodes)
    return pa.table({"block": pa.array([key[0].as_py()] * len(found), pa.int64()), "x": pa.array([a for a, _ in found], pa.int64()), "y": pa.array([b for _, b in found], pa.int64())})


def tree_links(sets: list[np.ndarray], maps: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets (with ``side``, of those between side False and side True): a signature tree over them, then ``linked`` on what it leaves."""
    size = np.array([len(s) for s in sets])
    order = np.lexsort((size, side)) if side is not None else np.argsort(size, kind="stable")
    groups = [order[i : i + SMALL_LEAF] for i in range(0, len(order), SMALL_LEAF)]
    found = traverse([Node.of(size[g], maps[g], k) for k, g in enumerate(groups)])
    if side is not None:
        found = [(x, y) for x, y in found if not side[groups[x]].all() or not side[groups[y]].all()]
        found = [(x, y) for x, y in found if side[groups[x]].any() or side[groups[y]].any()]
    live = np.unique(np.concatenate([groups[k] for pair in found for k in pair])) if found else np.zeros(0, np.int64)
    if len(live) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = linked([sets[k] for k in live], None if side is None else side[live])
    return live[a], live[b]


def linked(sets: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets: of all pairs, or with ``side`` of those between side False and side True."""
    size = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    renamed = np.cumsum(count > 1) - 1
    column, owner = renamed[column[keep]], owner[keep]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int((count > 1).sum()), 8192):  # blocks of columns bound the memory
        own = (column >= a) & (column < a + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[own], column[own] - a] = 1
        shared += m @ m.T
    shared = np.rint(shared).astype(np.int64)
    ok = (NUM * shared >= DEN * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    ok = np.triu(ok, 1) if side is None else ok & ~side[:, None] & side[None, :]
    return np.nonzero(ok)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """For each linked index the smallest index of its local component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in sorted({*a.tolist(), *b.tolist()}) if find(x) != x]


def _compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Exact comparison of one leaf with itself or with another; a spanning set of its links."""
    ids = np.array(group.column("id"), np.int64)
    order = np.argsort(ids)
    ids = ids[order]
    sets = [np.frombuffer(group.column("tokens")[int(r)].as_buffer(), _U) for r in order]
    maps = np.stack([np.frombuffer(group.column("bitmap")[int(r)].as_buffer(), _U) for r in order])
    side = None if key[1] == key[2] else np.array(group.column("leaf"), np.int64)[order] == key[2].as_py()
    a, b = tree_links(sets, maps, side)
    pairs = _spanning(a, b, len(ids))
    return pa.table({"a": pa.array([int(ids[x]) for x, _ in pairs], pa.int64()), "b": pa.array([int(ids[y]) for _, y in pairs], pa.int64())})


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with one row an id; (doc_id, k1, k2, n) for all and (k1, block) for classes that may have a partner."""
    spark = docs.sparkSession
    ship(spark)
    n_parts = parts(spark)
    shared = docs.mapInArrow(_prefixes(n_parts), _SCHEMA).repartition("key").sortWithinPartitions("key").mapInArrow(_shared(n_parts), _SCHEMA)
    found = materialize(shared.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates, _ANSWER))
    meta = found.filter("kind = 1").select("doc_id", "k1", "k2", "n")
    hashes = found.filter("kind = 2").select("tid", "k1")
    # all classes that hold a hash hang on the smallest of them: as many edges as rows, with the hash's least class by map-side combine
    hubs = hashes.groupBy("tid").agg(F.min("k1").alias("hub"), F.max("k1").alias("far")).filter("hub <> far").select("tid", "hub")
    edges = hashes.join(hubs, "tid").filter("k1 <> hub").select(F.col("k1").alias("a"), F.col("hub").alias("b")).distinct()
    return meta, components(edges).select(F.col("node").alias("k1"), F.col("root").alias("block"))


def _pivoted(large: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(block, id, root) of the members of large blocks and their links (a, b) with the pivots.

    A round links the unattached members of a block that has more than ``LEAF`` of them with one of these, its pivot. Members of one pivot are
    connected, so the tree need not compare them: a group of near copies costs one comparison each instead of one for each pair.
    """
    left = large.select("block", "id")
    attached = None
    for _ in range(PIVOTS):
        crowd = left.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).filter(F.col("n") > LEAF).select("block", "pivot")
        crowd = materialize(crowd)
        if not crowd.limit(1).count():
            break
        pivots = materialize(large.select("id", F.col("tokens").alias("pivot_tokens")).join(crowd, F.col("id") == F.col("pivot")).select("block", "pivot", "pivot_tokens"))
        own = large.join(left, ["block", "id"]).select("block", "id", "tokens").join(pivots, "block")
        met = materialize(own.select("block", "id", "tokens", "pivot", "pivot_tokens").mapInArrow(_attach, "block long, id long, root long"))
        new = met.filter("root is not null")
        attached = new if attached is None else attached.unionByName(new)
        left = left.join(new, ["block", "id"], "left_anti")
    if attached is None:
        return left.withColumn("root", F.lit(None).cast("long")), None
    return left.withColumn("root", F.lit(None).cast("long")).unionByName(attached), attached.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) among ``members`` (id, block, n) that connect all that are linked; ``docs`` has (id, text).

    Every block goes through a signature tree. A block of up to ``LEAF`` sets is one leaf, whose tree is built by the task that compares it; the
    leaves of larger blocks are the lowest level of a tree that is walked first, and each pair of leaves that it leaves is again a tree of its own.
    """
    whole = members.groupBy("block").agg(F.count(F.lit(1)).alias("whole"))
    placed = members.join(whole, "block").select("block", "whole", "id")
    signed = materialize(docs.join(placed, "id").select("block", "whole", "id", "text").mapInArrow(_signatures, "block long, whole long, id long, tokens binary, bitmap binary"))
    alone = signed.filter(F.col("whole") <= LEAF).select("block", F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y"), "id", F.lit(-1).cast("long").alias("leaf"), "tokens", "bitmap")
    found = "a long, b long"
    if not whole.filter(F.col("whole") > LEAF).limit(1).count():
        return alone.groupBy("block", "x", "y").applyInArrow(_compare, found)
    large = signed.filter(F.col("whole") > LEAF)
    rooted, known = _pivoted(large)
    rooted = materialize(rooted)
    band = F.floor(F.log((F.octet_length("tokens") / F.lit(8)).cast("double")) / F.lit(float(np.log(1.12)))).cast("long")
    sized = materialize(large.join(rooted, ["block", "id"]).withColumn("band", band))
    width = sized.groupBy("block", "band", "root").agg(F.count(F.lit(1)).alias("members"))
    width = materialize(width.withColumn("slots", F.ceil(F.col("members") / F.lit(LEAF)).cast("long")).withColumn("first", F.xxhash64("band", F.coalesce("root", F.lit(-1)))))
    same = sized.alias("s").join(width.alias("w"), (F.col("s.block") == F.col("w.block")) & (F.col("s.band") == F.col("w.band")) & F.col("s.root").eqNullSafe(F.col("w.root")))
    leaf = F.xxhash64("w.first", F.pmod(F.xxhash64("s.id"), F.col("w.slots")), F.lit("leaf"))
    leaves = materialize(same.select("s.block", leaf.alias("leaf"), "s.root", "s.id", "s.tokens", "s.bitmap"))
    nodes = leaves.select("block", "leaf", "root", "tokens", "bitmap").groupBy("block", "leaf").applyInArrow(_leaf, "block long, leaf long, root long, low long, high long, slack long, every binary, both binary")
    pairs = materialize(nodes.groupBy("block").applyInArrow(_walk, "block long, x long, y long"))
    ends = pairs.select("block", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("leaf"))
    dealt = leaves.select("block", "leaf", "id", "tokens", "bitmap").join(ends, ["block", "leaf"]).select("block", "x", "y", "id", "leaf", "tokens", "bitmap")
    compared = alone.unionByName(dealt).groupBy("block", "x", "y").applyInArrow(_compare, found)
    return compared if known is None else compared.unionByName(known)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, class_id (smallest id with an equal set) and component_id."""
    rows = keyed(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    meta, blocks = classes(rows, "id", "text")
    reps = materialize(meta.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")))
    members = reps.join(blocks, "k1").select("id", "block", "n")
    roots = components(links(rows, members)).select(F.col("node").alias("class_id"), "root")
    of = meta.join(reps.select("k1", "k2", F.col("id").alias("class_id")), ["k1", "k2"], "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    return of.join(roots, "class_id", "left").select(id_col, "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id."""
    gone = join(docs, id_col, text_col).filter(f"`{id_col}` <> component_id").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def oracle() -> str:
    """The join in DuckDB SQL, over shingles as text."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE {NUM} * c >= {DEN} * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""
