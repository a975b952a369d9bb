"""Suffix-array dedup: a depth-limited radix sort of suffixes finds every byte string of the threshold length that repeats.

Suffixes are ordered most significant digit first, only through ``DEPTH`` bytes, and only as far as equal groups still hold more than one:

1. The bucket pass. Every window of ``DEPTH`` bytes (a suffix cut off there) is filed under its anchor, the 32-byte string of smallest hash in
   it, so that equal windows lie in one bucket; a bucket is dealt to one task. Consecutive windows with one anchor travel as one segment.
   Of equal segments only the earliest stays. Equal segments of one batch are settled where they are read, so a passage that many
   documents share sends one row for each batch. Buckets with one segment are done.
2. The digit passes (``repeated_windows``). The windows of every other bucket are ordered by their bytes, ``DIGIT`` at a time from the first;
   what is alone after a digit is dropped, and what is left after the last are exactly the repeated windows.

A row for each suffix would be 16 bytes for each byte of text, so anchors only say which suffixes are sorted together. Segments are compared by
a hash of 112 bits, windows by their bytes. One task holds a bucket: 26 bytes for each different segment, then the bytes of those that are open.

Defined results: a null or empty text has no bytes and the digest of none. Bytes are those of UTF-8, so kept bytes need not be valid text.
Rows that repeat an id count as one document (see ``frames.keyed``), rows with a null id are left out. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import text as tx
from statloom.llm.frames import keyed, materialize, parts, ship, slices

DEPTH = 100
ANCHOR = 32
#: Longer documents are cut into overlapping stretches of so many windows; a cut only moves work from step 2 to step 3.
STRETCH = 1 << 22
#: Bytes of a digit of the radix sort (1, 2, 4 or 8), and windows that are sorted together.
DIGIT = 8
LOT = 1 << 20
_U = np.uint64
_SPOT = _U((1 << 24) - 1)
_SEGMENT = np.dtype([("seg", "<u8"), ("hi", "<u4"), ("lo", "u1"), ("id", "<i8"), ("at", "<u4"), ("n", "u1")])
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])


def _codes(second: bool = False) -> np.ndarray:
    codes = tx.byte_codes(fold=False)
    return tx.mix(codes ^ _U(0x9FB21C651E98DF25)) if second else codes


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by least-so-far runs from both ends of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offs: np.ndarray, codes: np.ndarray):
    """Of consecutive documents: document, start in it, windows, anchor hash, segment hash and the anchor's distance, for every segment."""
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, _U)] * 2 + [np.zeros(0, np.int64)]
    if len(data) < DEPTH:
        return none
    prefix = tx.prefix_hash(data, codes)
    _, down = tx.powers(len(prefix))
    grams = tx.mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    spot = np.arange(len(grams), dtype=_U)
    least = _sliding_least((grams & ~_SPOT) | spot, DEPTH - ANCHOR + 1)
    whole = np.zeros(len(least), np.bool_)
    for a, b in zip(offs[:-1], offs[1:]):
        if b - a >= DEPTH:
            whole[a : b - DEPTH + 1] = True
    at = np.flatnonzero(whole)
    if not len(at):
        return none
    anchor = (least[at] & _SPOT).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(head, len(at)))
    start, anchor = at[head], anchor[head]
    doc = np.searchsorted(offs, start, "right") - 1
    seg = tx.span_hash(prefix, start, start + count - 1 + DEPTH)
    return doc, start - offs[doc], count, grams[anchor], seg, anchor - start


def _stretches(data: np.ndarray, offs: np.ndarray):
    """(first document, data, offsets, offset of the first in its document) in pieces of bounded size."""
    for i, j in tx.pieces(offs):
        if offs[j] - offs[i] <= STRETCH + DEPTH:
            yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], 0
            continue
        for a in range(offs[i], max(offs[i] + 1, offs[j] - DEPTH + 1), STRETCH):
            b = min(offs[j], a + STRETCH + DEPTH - 1)
            yield i, data[a:b], np.array([0, b - a]), a - offs[i]


def _blob(spans: np.ndarray) -> bytes:
    return spans.tobytes()


_ROWS = "kind int, key long, at long, n long, gram long, blob binary"
_NAMES = ["kind", "key", "at", "n", "gram", "blob"]


def _batch(kind, key, at=None, n=None, gram=None, blob=None) -> pa.RecordBatch:
    size = len(key)
    fill = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()), fill(key, pa.int64()), fill(at, pa.int64()), fill(n, pa.int64()), fill(gram, pa.int64()), fill(blob, pa.binary())], names=_NAMES)


# kinds of rows
_SEGS, _GONE, _OPEN, _TEXT = 0, 1, 2, 3


def _gone(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Removed stretches, one row for each document among them."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    spans = np.empty(len(ids), _SPAN)
    spans["start"], spans["end"] = start[order], end[order]
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    stop = np.append(head[1:], len(ids))
    for i in range(0, len(head), 20_000):
        h, s = head[i : i + 20_000], stop[i : i + 20_000]
        yield _batch(_GONE, ids[h], blob=[spans[x:y].tobytes() for x, y in zip(h, s)])


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys given (last first, as in lexsort) and whether each sorted row begins a group of all but the first two keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.bool_)
    new[:1] = True
    for k in keys[2:]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _read(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes()
        for batch in slices(batches, 3000):
            ids = np.array(batch.column(0), np.int64)
            data, offs = tx.utf8(batch.column(1))
            found = []
            for first, piece, at, base in _stretches(data, offs):
                doc, start, n, gram, seg, _ = segments(piece, at, codes)
                if len(doc):
                    found.append((ids[doc + first], start + base, n, gram, seg))
            if not found:
                continue
            own, start, n, gram, seg = (np.concatenate(x) for x in zip(*found))
            del found
            order, new = _first_of(start, own, seg, gram)
            again = order[~new]
            if len(again):
                yield from _gone(own[again], start[again], start[again] + n[again] - 1 + DEPTH)
            keep = order[new]
            part = (gram[keep] % _U(n_parts)).astype(np.int64)
            keep = keep[np.argsort(part, kind="stable")]
            part = np.sort(part)
            rows = np.empty(len(keep), _SEGMENT)
            short = gram[keep] // _U(n_parts)
            rows["seg"], rows["hi"], rows["lo"], rows["id"], rows["at"], rows["n"] = seg[keep], ((short >> _U(8)) & _U(0xFFFFFFFF)).astype(np.uint32), (short & _U(0xFF)).astype(np.uint8), own[keep], start[keep], n[keep]
            cut = np.searchsorted(part, np.arange(n_parts + 1))
            live = np.flatnonzero(np.diff(cut))
            yield _batch(_SEGS, live, blob=[rows[cut[p] : cut[p + 1]].tobytes() for p in live])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce by anchor, over a partition sorted by key: all but the earliest of equal segments go; earliest ones under a shared anchor stay open."""

    def reduce(part: int, blobs: list) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(blobs)
        gram = _U(part & 0x7FFFFF) << _U(40) | rows["hi"].astype(_U) << _U(8) | rows["lo"]
        order, new = _first_of(rows["at"], rows["id"], rows["seg"], gram)
        again = rows[order[~new]]
        yield from _gone(again["id"], again["at"], again["at"].astype(np.int64) + again["n"] - 1 + DEPTH)
        head = order[new]
        g = gram[head]
        if len(g) < 2:
            return
        same = g[1:] == g[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        rows, g = rows[head[shared]], g[shared]
        for i in range(0, len(g), 100_000):
            r = rows[i : i + 100_000]
            yield _batch(_OPEN, r["id"], r["at"].astype(np.int64), r["n"].astype(np.int64), g[i : i + 100_000].view(np.int64))

    part, blobs = None, []
    for batch in batches:
        kind, key = np.array(batch.column("kind")), np.array(batch.column("key"), np.int64)
        other = np.flatnonzero(kind != _SEGS)
        if len(other):
            yield batch.take(pa.array(other))
        for r in np.flatnonzero(kind == _SEGS).tolist():
            if key[r] != part and blobs:
                yield from reduce(part, blobs)
                blobs = []
            part = int(key[r])
            blobs.append(np.frombuffer(batch.column("blob")[r].as_buffer(), _SEGMENT).copy())
    if blobs:
        yield from reduce(part, blobs)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open segments, from the documents they stand in."""
    for batch in slices(batches):
        key, at, n, gram, blob = [], [], [], [], []
        for r in range(batch.num_rows):
            doc, text, own = batch.column(0)[r].as_py(), batch.column(1)[r].as_buffer(), batch.column(2)[r].as_py()
            for x in own:
                key.append(doc)
                at.append(x["at"])
                n.append(x["n"])
                gram.append(x["gram"])
                blob.append(text[x["at"] : x["at"] + x["n"] - 1 + DEPTH].to_pybytes())
        if key:
            yield _batch(_TEXT, key, at, n, gram, blob)


def repeated_windows(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``DEPTH`` bytes at ``start`` that occur more than once: their indices in the order of their bytes, and the group of each.

    Most significant digit first: a pass orders what is left by the next ``DIGIT`` bytes within the groups so far and drops every suffix that
    is alone; it ends after ``DEPTH`` bytes, so equal groups are exactly the repeated windows. Digits are the bytes themselves.
    """
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    digits = np.ndarray(max(0, len(data) - DIGIT + 1), f">u{DIGIT}", data, strides=(1,))
    for depth in [*range(0, DEPTH - DIGIT, DIGIT), DEPTH - DIGIT]:  # the last digit may overlap the one before
        if not len(live):
            break
        digit = digits[start[live] + depth].astype(_U)
        order = np.lexsort((digit, group))
        digit, old, live = digit[order], group[order], live[order]
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (old[1:] != old[:-1])])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        live = live[~alone]
    return live, group


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce by anchor, over a partition sorted by it: windows of open segments are radix sorted; all but the earliest of equal ones go.

    Whole anchors are taken together until they have ``LOT`` windows, so memory follows a lot or one anchor, not the partition.
    """

    def settle(rows: list) -> Iterator[pa.RecordBatch]:
        ids, at, n = (np.array(x, np.int64) for x in zip(*(r[:3] for r in rows)))
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        offs = np.concatenate([[0], np.cumsum(n - 1 + DEPTH)])
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        live, group = repeated_windows(data, np.repeat(offs[:-1], n) + within)
        if not len(live):
            return
        doc, place = np.repeat(ids, n), np.repeat(at, n) + within
        order = np.lexsort((place[live], doc[live], group))
        live, group = live[order], group[order]
        again = np.sort(live[1:][group[1:] == group[:-1]])
        # neighbouring windows of a segment are one stretch
        head = np.concatenate([[True], (again[1:] != again[:-1] + 1) | (within[again[1:]] == 0)])
        last = np.append(np.flatnonzero(head)[1:] - 1, len(again) - 1)
        yield from _gone(doc[again[head]], place[again[head]], place[again[last]] + DEPTH)

    rows, gram, held = [], None, 0
    for batch in batches:
        for key, at, n, own, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "n", "gram", "blob"))):
            if own != gram and held >= LOT:
                yield from settle(rows)
                rows, held = [], 0
            gram = own
            rows.append((key, at, n, blob))
            held += n
    if rows:
        yield from settle(rows)


def _runs(blobs, n: int) -> np.ndarray:
    """Maximal runs (start, end) of the union of stretches."""
    spans = np.concatenate([np.frombuffer(b, _SPAN) for b in blobs])
    spans = spans[np.argsort(spans["start"], kind="stable")]
    start, reach = spans["start"].astype(np.int64), np.maximum.accumulate(spans["end"].astype(np.int64))
    head = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(start) - 1)
    return np.stack([start[head], reach[last]], 1)


def _remove(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            size, gone, out, digest, kept_all = [], [], [], [], []
            for r in range(batch.num_rows):
                text, blobs = batch.column(1)[r], batch.column(2)[r].as_py()
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs = _runs(blobs, len(data)) if blobs else np.zeros((0, 2), np.int64)
                kept, at = [], 0
                for a, b in runs.tolist():
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                size.append(len(data))
                gone.append(len(data) - len(kept))
                out.append([{"start": a, "end": b} for a, b in runs.tolist()])
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_all.append(kept if keep_bytes else None)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, span), pa.array(digest, pa.string())]
            names = [batch.schema.names[0], "n_bytes", "n_removed", "spans", "kept_sha256"]
            if keep_bytes:
                columns.append(pa.array(kept_all, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, spans (byte runs removed), kept_sha256 and, if asked for, the kept bytes."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col, text_col).select(id_col, F.col(text_col).cast("string").alias(text_col))
    settled = materialize(rows.mapInArrow(_read(parts(spark)), _ROWS).repartition("key").sortWithinPartitions("key").mapInArrow(_settle, _ROWS))
    open_ = settled.filter(F.col("kind") == _OPEN).groupBy(F.col("key").alias(id_col)).agg(F.collect_list(F.struct("at", "n", "gram")).alias("own"))
    cut = rows.join(open_, id_col).select(id_col, text_col, "own").mapInArrow(_cut_out, _ROWS)
    compared = cut.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, _ROWS)
    gone = settled.filter(F.col("kind") == _GONE).select(F.col("key").alias(id_col), "blob").unionByName(compared.select(F.col("key").alias(id_col), "blob"))
    gone = gone.groupBy(id_col).agg(F.collect_list("blob").alias("gone"))
    schema = f"`{id_col}` long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return rows.join(gone, id_col, "left").select(id_col, text_col, "gone").mapInArrow(_remove(keep_bytes), schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = dedup(docs, id_col, text_col, keep_bytes=False)
    return found.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
