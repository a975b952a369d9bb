"""LM scoring by online logistic context mixing.

A text is its bytes and an end mark. Each symbol is a path of binary decisions in a code tree fitted to the corpus. Four predictors give log-odds
for every decision: hashed contexts of the last 2, 3 and 5 bytes, with odds from counts over all training documents, and a match predictor that
learns from the text itself, symbol by symbol: what followed the last place where the same ``MATCH`` symbols stood, the surer the longer it has
been right. A gate (the depth in the tree) picks the weights that add them up. Each document starts with the same weights and refines them by
online gradient steps as it is read: after 8 symbols, then after twice as many each time, at most ``LAST_BLOCK``. The sum of log probabilities
over the bytes gives total bits per byte. Beside it stands the add-one unigram score over words.

Counts travel as one blob for each task and part, so what is gathered follows the corpus; the predictors' tables have twice as many slots as
the corpus has different decisions (at least ``TABLE_BITS``). The ``FREQUENT`` commonest words, a bound by construction, are broadcast with their counts; occurrences of all other words are
dealt by word, counted there, and their sums go back to their documents. No word's occurrences beyond the training share of a
frequent one meet in a task.

Defined results: a null text is an empty text, which holds one token, the end. Rows are scored one by one, so repeated ids do no harm; a row with a
null id is learned from. Without training documents every decision has even odds and every count is 0. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import text as tx
from statloom.llm.frames import ship, shuffle_partitions

ORDERS = (2, 3, 5)
#: The least table of each order, as a power of two, and the most (slot and bit share 32 bits).
TABLE_BITS, MOST_BITS = (19, 20, 21), 31
#: One in so many contexts, by hash, is kept to count the different decisions of the corpus.
SAMPLED = 64
GATES = 4
#: Weights that every document starts with, one for each order and one for the match predictor, and how far a step goes.
START, RATE = (0.20, 0.35, 0.60, 0.50), 0.02
#: Symbols after which a document's weights take a step: few at first, twice as many each time, never more than the second.
FIRST_BLOCK, LAST_BLOCK = 8, 2048
#: The match predictor: symbols that must agree with an earlier place of the same text, its log-odds, and the longest run that adds to them.
MATCH, MATCH_ODDS, MATCH_RUN = 6, 0.25, 16
FREQUENT = 1 << 17
SLICES = 32
PIECE = 2 << 20
#: Places whose contexts are hashed at once: few enough to stay near the processor.
TILE = 1 << 15
END = 256
#: No guess, in place of a symbol.
_NONE = END + 1
_END_WORD = np.uint64(0x8E9D5A3B17C4F261)
_U, _I = np.uint64, np.uint32
_WORDS = tx.word_table(tx.SPACE_BYTES)


def code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman paths of the 257 symbols: number of decisions, and node and bit of each (padded)."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    name = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[name] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], name, name))
        name += 1
    paths: list = [None] * len(counts)
    todo = [(heap[0][2], [])]
    while todo:
        x, path = todo.pop()
        if x in children:
            todo += [(c, [*path, (x - len(counts), bit)]) for bit, c in enumerate(children[x])]
        else:
            paths[x] = path
    depth = np.array([len(p) for p in paths])
    node, bit = np.zeros((len(counts), depth.max()), _I), np.zeros((len(counts), depth.max()), np.uint8)
    for s, p in enumerate(paths):
        for k, (x, b) in enumerate(p):
            node[s, k], bit[s, k] = x, b
    return depth, node, bit


def _symbols(data: np.ndarray, offs: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols of all documents (bytes, then the end mark), where each document begins, and the hashed contexts of every symbol."""
    pad, lens = max(orders), np.diff(offs)
    docs, n = len(lens), len(data) + len(lens)
    first = np.append(offs[:-1] + np.arange(docs), n)
    symbols, byte = np.full(n, END, np.uint16), np.ones(n, np.bool_)
    byte[first[1:] - 1] = False
    symbols[byte] = data
    start = first[:-1] + (np.arange(docs) + 1) * pad
    keep = np.ones(n + docs * pad, np.bool_)
    for k in range(1, pad + 1):
        keep[start - k] = False
    kept = np.flatnonzero(keep)
    laid = np.zeros(len(keep), _I)  # 0 stands before the text
    laid[kept] = symbols + np.uint16(1)
    contexts = []
    h, shifted = np.zeros(len(laid), _I), np.empty(TILE, _I)
    for order in orders:
        for a in range(pad, len(laid), TILE):
            b = min(a + TILE, len(laid))
            own, moved = h[a:b], shifted[: b - a]
            own.fill(order * 0x9E3779B1 & 0xFFFFFFFF)
            for k in range(1, order + 1):
                own ^= laid[a - k : b - k]
                own *= _I(0x85EBCA6B)
                np.right_shift(own, _I(13), out=moved)
                own ^= moved
        contexts.append(h.take(kept))
    return symbols, first, contexts


def _slot(context: np.ndarray, mixed: np.ndarray, bits: int) -> np.ndarray:
    """The slot of a decision: both arguments are hashes already, so one multiplication spreads their sum."""
    h = context ^ mixed
    h *= _I(0x9E3779B1)
    h >>= _I(32 - bits)
    return h


def _mixed(node: np.ndarray) -> np.ndarray:
    return tx.mix(node.astype(_U) + _U(1)).astype(_I)


def table_bits(tree, seen: np.ndarray) -> list[int]:
    """Size of each order's table, for two slots a decision, from the sampled contexts and the symbols after them (``_histogram``)."""
    depth, node, _ = tree
    seen = seen - _SEEN
    order, context, symbol = seen >> 41, seen >> 9 & 0xFFFFFFFF, seen & 511
    bits = []
    for o, least in enumerate(TABLE_BITS):
        own = order == o
        c, s = context[own], symbol[own]
        met = [np.unique(c[depth[s] > k] << 9 | node[s[depth[s] > k], k]) for k in range(depth.max())]
        decisions = SAMPLED * len(np.unique(np.concatenate(met)))
        bits.append(min(MOST_BITS, max(least, int(np.ceil(np.log2(2 * decisions + 1))))))
    return bits


class Counts:
    """Decisions by slot and bit of each order, over the documents of a task."""

    def __init__(self, tree, bits: list[int]):
        self.depth, node, self.bit = tree
        self.mixed, self.bits = _mixed(node), bits
        self.tables = [np.zeros(2 << b, np.uint32) for b in bits]

    def add(self, data: np.ndarray, offs: np.ndarray) -> None:
        symbols, _, contexts = _symbols(data, offs)
        symbols = symbols.astype(_U)
        for o, context in enumerate(contexts):
            # equal symbols after equal contexts make the same decisions, so each such pair is walked once
            pair = context.astype(_U)
            pair <<= _U(9)
            pair |= symbols
            pair.sort()
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(pair))).astype(np.uint32)
            pair = pair[head]
            symbol, context = (pair & _U(511)).astype(np.intp), (pair >> _U(9)).astype(_I)
            for k in range(self.depth.max()):
                live = self.depth[symbol] > k
                if not live.all():
                    live = np.flatnonzero(live)
                    symbol, context, times = symbol.take(live), context.take(live), times.take(live)
                if not len(symbol):
                    break
                slot = _slot(context, self.mixed[:, k].take(symbol), self.bits[o])
                slot <<= _I(1)
                slot |= self.bit[:, k].take(symbol)
                np.add.at(self.tables[o], slot, times)

    def blobs(self) -> list[bytes]:
        """The tables in ``SLICES`` compressed slices."""
        cut = [t.reshape(SLICES, -1) for t in self.tables]
        return [zlib.compress(np.concatenate([t[s] for t in cut]).tobytes(), 1) for s in range(SLICES)]


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of bit 1 from counts (slot, bit); 0 where nothing was seen."""
    n = counts.reshape(-1, 2).astype(np.float64)
    return np.log((n[:, 1] + 0.3) / (n[:, 0] + 0.3)).astype(np.float32)


def matches(symbols: np.ndarray, first: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each document itself has to say: the symbol that came after the last earlier place with the same ``MATCH`` symbols before it
    (``_NONE`` if there is none), and how many such guesses in a row were right up to here.

    ``context`` is the hash of those symbols. A guess depends on nothing but the document up to its place.
    """
    n, docs = len(symbols), len(first) - 1
    guess = np.full(n, _NONE, np.int16)
    bits = max(1, n.bit_length())
    doc = np.repeat(np.arange(docs, dtype=_U), np.diff(first))
    key = doc << _U(24 + bits) | (context >> _I(8)).astype(_U) << _U(bits) | np.arange(n, dtype=_U)
    key.sort()
    at = (key & _U((1 << bits) - 1)).astype(np.int64)
    key >>= _U(bits)
    same = np.flatnonzero((key[1:] == key[:-1]) & (context[at[1:]] == context[at[:-1]]))
    guess[at[same + 1]] = symbols[at[same]]
    right = guess == symbols
    place = np.arange(n, dtype=np.int32)
    wrong = np.maximum.accumulate(np.where(right, np.int32(-1), place))  # the last wrong guess, this place included
    run = place - np.int32(1) - np.append(np.int32(-1), wrong[:-1]).astype(np.int32)
    return guess, np.minimum(run, MATCH_RUN)


class Model:
    """Predictors by slot, learned from the corpus and fixed, and a match predictor that learns from each document as it is read."""

    def __init__(self, tree, tables: list[np.ndarray]):
        self.depth, self.node, self.bit = tree
        self.mixed = _mixed(self.node)
        self.sign = self.bit.astype(np.float32) * np.float32(2) - np.float32(1)
        # paths of guesses: no node where a path has ended, nor on that of no guess
        ended = np.arange(self.node.shape[1])[None, :] >= self.depth[:, None]
        self.guessed = np.concatenate([np.where(ended, -1, self.node.astype(np.int64)), np.full((1, self.node.shape[1]), -1)]).astype(np.int32).T.copy()
        self.guessed_sign = np.concatenate([self.sign, np.zeros((1, self.sign.shape[1]), np.float32)]).T.copy()
        self.mixed_at, self.against, self.path = self.mixed.T.copy(), -self.sign.T.copy(), self.node.astype(np.int32).T.copy()
        # decisions from level GATES - 1 on share a gate: those of each symbol side by side
        last = GATES - 1
        self.rest = np.maximum(self.depth - last, 0)
        self.rest_first = np.cumsum(self.rest) - self.rest
        own, self.rest_level = np.nonzero(~ended[:, last:])
        self.rest_level += last
        self.rest_mixed, self.rest_against, self.rest_path = self.mixed[own, self.rest_level], -self.sign[own, self.rest_level], self.node[own, self.rest_level].astype(np.int32)
        self.tables, self.bits = tables, [len(t).bit_length() - 1 for t in tables]

    def log10(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log10 probability of each document."""
        symbols, first, contexts = _symbols(data, offs, (*ORDERS, MATCH))
        guess, run = matches(symbols, first, contexts.pop())
        symbols, guess = symbols.astype(np.intp), guess.astype(np.intp)
        strength = (np.float32(MATCH_ODDS) * (run + 1)).astype(np.float32)
        docs = len(offs) - 1
        total = np.zeros(docs)
        weights = np.tile(np.array(START, np.float32), (docs, GATES, 1))
        size = np.diff(first)
        at, block = 0, FIRST_BLOCK
        while True:
            own = np.flatnonzero(size > at)
            if not len(own):
                break
            n = np.minimum(size[own] - at, block)
            if at == 0 and n.sum() == len(symbols):
                pick = slice(None)
            else:
                pick = np.repeat(first[own] + at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self._block(own, n, symbols[pick], [c[pick] for c in contexts], guess[pick], strength[pick], weights, total)
            at += block
            block = min(2 * block, LAST_BLOCK)
        return total / np.log(10)

    def _block(self, own, n, symbols, contexts, guess, strength, weights, total) -> None:
        """One block of each document in ``own``: score it with the weights so far, then refine them."""
        bounds = np.concatenate([[0], np.cumsum(n)])
        steps, seen = np.zeros((len(own), GATES, len(START)), np.float32), np.zeros((len(own), GATES), np.float32)
        for gate in range(min(GATES, self.depth.max())):
            live = self.depth.take(symbols) > gate
            if not live.all():
                kept = np.concatenate([[0], np.cumsum(live)])
                bounds, live = kept[bounds], np.flatnonzero(live)
                symbols, contexts, guess, strength = symbols.take(live), [c.take(live) for c in contexts], guess.take(live), strength.take(live)
            if not len(symbols):
                break
            if gate < GATES - 1:
                mixed, against, path = self.mixed_at[gate].take(symbols), self.against[gate].take(symbols), self.path[gate].take(symbols)
                guessed, match = self.guessed[gate].take(guess), self.guessed_sign[gate].take(guess)
            else:  # all further decisions at once, those of a symbol side by side
                times = self.rest.take(symbols)
                ends = np.cumsum(times)
                at = np.repeat(self.rest_first.take(symbols) - (ends - times), times)
                at += np.arange(len(at))
                mixed, against, path = self.rest_mixed.take(at), self.rest_against.take(at), self.rest_path.take(at)
                at = self.rest_level.take(at)
                at *= self.guessed.shape[1]
                at += np.repeat(guess, times)
                guessed, match = self.guessed.take(at), self.guessed_sign.take(at)
                contexts, strength = [np.repeat(c, times) for c in contexts], np.repeat(strength, times)
                bounds = np.append(0, ends)[bounds]
            count = np.diff(bounds)
            odds = [t.take(_slot(c, mixed, b)) for t, c, b in zip(self.tables, contexts, self.bits)]
            # the guess speaks as long as its path is that of the decisions so far
            match *= strength
            match *= (guessed == path).view(np.uint8).astype(np.float32)
            odds.append(match)
            z = odds[0] * np.repeat(weights[own, gate, 0], count)
            for o in range(1, len(START)):
                z += odds[o] * np.repeat(weights[own, gate, o], count)
            z *= against
            np.clip(z, -20, 20, out=z)
            np.exp(z, out=z)
            z += 1  # 1 / probability of the bit that came
            some = np.flatnonzero(count)
            cuts = bounds[:-1][some]
            total[own[some]] -= np.add.reduceat(np.log(z), cuts, dtype=np.float64)
            miss = np.reciprocal(z, out=z)
            miss -= 1
            miss *= against
            for o in range(len(START)):
                odds[o] *= miss
                steps[some, gate, o] += np.add.reduceat(odds[o], cuts)
            seen[some, gate] += count[some]
        weights[own] += np.float32(RATE) * steps / np.sqrt(np.maximum(seen, 1))[:, :, None]


def _held_out(id_col: str, held_out: tuple[int, int]):
    modulus, remainder = held_out
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


_ROWS = "key long, kind int, chunk long, blob binary"
_WORD_COUNT = np.dtype([("word", "<u8"), ("n", "<u4")])
_USE = np.dtype([("word", "<u8"), ("doc", "<u4")])
_PART_SUM = np.dtype([("doc", "<u4"), ("known", "<u4"), ("log", "<f8")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("held", "u1"), ("tokens", "<i8"), ("known", "<i8"), ("log", "<f8"), ("score", "<f8"), ("bytes", "<i8")])


def _rows(key, kind, chunk, blob) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.full(n, kind), pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(blob, pa.binary())], names=["key", "kind", "chunk", "blob"])


def _dealt(rows: np.ndarray, n_parts: int, kind: int, chunk: int, extra: bytes = b"") -> Iterator[pa.RecordBatch]:
    part = (rows["word"] % _U(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, cut = rows[order], np.searchsorted(part[order], np.arange(n_parts + 1))
    live = np.flatnonzero(np.diff(cut))
    if len(live):
        yield _rows(live, kind, chunk, [extra + rows[cut[p] : cut[p + 1]].tobytes() for p in live])


def _pieces(batch: pa.RecordBatch, limit: int = PIECE):
    data, offs = tx.utf8(batch.column("text"))
    for i, j in tx.pieces(offs, limit):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, first = tx.word_hashes(data, offs, _WORDS, tx.byte_codes())
    return words, np.repeat(np.arange(len(offs) - 1), np.diff(first))


#: From here on the histogram's keys are sampled contexts: order, context and the symbol after it.
_SEEN = 1 << 44


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols with their counts, and the sampled contexts with the symbols that follow (n = 0)."""
    count, seen, fresh, held = np.zeros(END + 1, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        for _, _, data, offs in _pieces(batch):
            symbols, _, contexts = _symbols(data, offs)
            count += np.bincount(symbols, minlength=END + 1)
            for o, c in enumerate(contexts):
                kept = np.flatnonzero(c & _I(SAMPLED - 1) == 0)
                fresh.append(_SEEN + (o << 41) + (c[kept].astype(np.int64) << 9) + symbols[kept])
                held += len(kept)
            if held > max(1 << 20, len(seen)):
                seen, fresh, held = np.unique(np.concatenate([seen, *fresh])), [], 0
    seen = np.unique(np.concatenate([seen, *fresh]))
    live = np.flatnonzero(count)
    keys, n = np.concatenate([live, seen]), np.concatenate([count[live], np.zeros(len(seen), np.int64)])
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["symbol", "n"])


def _count(tree, bits: list[int], n_parts: int):
    """Words and decisions of the training documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decisions, words, counts, docs, held = Counts(tree, bits), [], [], 0, 0

        def merged():
            word, place = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
            return word, n

        def flush():
            word, n = merged()
            rows = np.empty(len(word), _WORD_COUNT)
            rows["word"], rows["n"] = word, n
            return _dealt(rows, n_parts, 0, 0)

        for batch in batches:
            for _, _, data, offs in _pieces(batch):
                decisions.add(data, offs)
                word, n = np.unique(_words(data, offs)[0], return_counts=True)
                words.append(word)
                counts.append(n)
                held += len(word)
                if held > 4_000_000:
                    word, n = merged()
                    words, counts, held = [word], [n], len(word)
                    if held > 2_000_000:
                        yield from flush()
                        words, counts, held = [], [], 0
            docs += batch.num_rows
        if docs:
            words.append(np.array([_END_WORD]))
            counts.append(np.array([docs]))
            yield from flush()
            yield _rows(np.arange(SLICES) + n_parts, 1, 0, decisions.blobs())

    return run


def _sum_up(n_parts: int):
    """Reduce by part of words (tokens, distinct words, the commonest) and by slice of the tables (log-odds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, list] = {}
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, kind, blob in zip(batch.column("key").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
                if kind == 0:
                    words.setdefault(key, []).append(np.frombuffer(blob.as_buffer(), _WORD_COUNT).copy())
                else:
                    got = np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32)
                    if key in tables:
                        tables[key] += got
                    else:
                        tables[key] = got.astype(np.uint64)
        for key, blobs in words.items():
            rows = np.concatenate(blobs)
            word, place = np.unique(rows["word"], return_inverse=True)
            n = np.bincount(place, weights=rows["n"]).astype(np.int64)
            top = np.argsort(-n, kind="stable")[: max(1, FREQUENT // n_parts)]
            best = np.stack([word[top].view(np.int64), n[top]], 1)
            yield _rows([key], 0, 0, [np.array([n.sum(), len(word)], np.int64).tobytes() + best.tobytes()])
        for key, table in tables.items():
            yield _rows([key], 1, 0, [_odds(table).tobytes()])

    return run


class Fitted:
    """The model, token and type counts, and the commonest words with their counts (sorted by word)."""

    def __init__(self, model: Model, tokens: int, types: int, words: np.ndarray, counts: np.ndarray):
        self.model, self.tokens, self.types, self.words, self.counts = model, tokens, types, words, counts
        self.shift = _U(64 - max(1, len(words).bit_length()))
        self.start = np.searchsorted(words >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=_U)).astype(np.intp)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the commonest words have each of ``words`` (hashes), and whether they have it: a look at the few with the same leading bits."""
        lead = (words >> self.shift).astype(np.intp)
        at, end = self.start.take(lead), self.start.take(lead + 1)
        hit = np.zeros(len(words), np.bool_)
        rest = np.flatnonzero(at < end)
        while len(rest):
            same = self.words.take(at.take(rest)) == words.take(rest)
            hit[rest[same]] = True
            rest = rest[~same]
            at[rest] += 1
            rest = rest[at.take(rest) < end.take(rest)]
        return at, hit


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2)) -> Fitted:
    """Learn from all rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(~_held_out(id_col, held_out)).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    histogram = np.zeros(END + 1, np.int64)
    found = rows.mapInArrow(_histogram, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    key, n = np.array(found.column("symbol"), np.int64), np.array(found.column("n"), np.int64)
    histogram[key[key <= END]] = n[key <= END]
    tree = code_tree(histogram)
    bits = table_bits(tree, key[key > END])
    n_parts = shuffle_partitions(spark)
    got = rows.mapInArrow(_count(tree, bits, n_parts), _ROWS).repartition("key").mapInArrow(_sum_up(n_parts), _ROWS).collect()
    tables = [np.zeros((SLICES, (1 << b) // SLICES), np.float32) for b in bits]
    tokens = types = 0
    best = [np.zeros((0, 2), np.int64)]
    for r in got:
        if r["kind"] == 0:
            x = np.frombuffer(r["blob"], np.int64)
            tokens, types = tokens + int(x[0]), types + int(x[1])
            best.append(x[2:].reshape(-1, 2))
        else:
            x, a = np.frombuffer(r["blob"], np.float32), 0
            for t in tables:
                t[r["key"] - n_parts] = x[a : a + t.shape[1]]
                a += t.shape[1]
    best = np.concatenate(best)
    order = np.argsort(best[:, 0].view(_U))
    return Fitted(Model(tree, [t.ravel() for t in tables]), tokens, types, best[order, 0].view(_U), best[order, 1])


def _score(shared, n_parts: int):
    """Score every document; uses of words that are not among the commonest are dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        log = np.log10(fitted.counts + 1.0)
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            chunk = (task << 32) | k
            out = np.zeros(batch.num_rows, _DOC)
            ids = batch.column("id")
            out["null"] = np.array(ids.is_null())
            out["id"] = np.array(tx.pc.fill_null(ids, 0))
            out["held"] = np.array(batch.column("held"))
            rare = []
            for i, j, data, offs in _pieces(batch, PIECE // 2):
                words, doc = _words(data, offs)
                words, doc = np.concatenate([words, np.full(j - i, _END_WORD)]), np.concatenate([doc, np.arange(j - i)])
                at, hit = fitted.find(words)
                out["tokens"][i:j] = np.bincount(doc, minlength=j - i)
                out["known"][i:j] = np.bincount(doc[hit], minlength=j - i)
                out["log"][i:j] = np.bincount(doc[hit], weights=log[at[hit]], minlength=j - i)
                use = np.empty(int((~hit).sum()), _USE)
                use["word"], use["doc"] = words[~hit], doc[~hit] + i
                rare.append(use)
                out["score"][i:j] = fitted.model.log10(data, offs)
                out["bytes"][i:j] = np.diff(offs)
            yield _rows([chunk], 2, chunk, [out.tobytes()])
            use = np.concatenate(rare)
            # a use by a training document counts: marked in the highest bit of the document's number
            use["doc"] |= np.where(out["held"][use["doc"]] == 0, _I(1 << 31), _I(0))
            yield from _dealt(use, n_parts, 3, chunk)

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce by word: count training uses, and sum the logs for each document that uses them."""
    blobs, chunks = [], []
    for batch in batches:
        kind = np.array(batch.column("kind"))
        other = np.flatnonzero(kind != 3)
        if len(other):
            yield batch.take(pa.array(other))
        for r in np.flatnonzero(kind == 3):
            blobs.append(np.frombuffer(batch.column("blob")[r].as_buffer(), _USE).copy())
            chunks.append(batch.column("chunk")[r].as_py())
    if not blobs:
        return
    uses = np.concatenate(blobs)
    chunk = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    trained = uses["doc"] >> _I(31)
    _, place = np.unique(uses["word"], return_inverse=True)
    count = np.bincount(place, weights=trained)[place]
    doc = uses["doc"] & _I(0x7FFFFFFF)
    key = (np.unique(chunks, return_inverse=True)[1][chunk].astype(np.int64) << 32) | doc
    owner, place = np.unique(key, return_inverse=True)
    sums = np.empty(len(owner), _PART_SUM)
    sums["doc"], sums["log"], sums["known"] = owner & 0xFFFFFFFF, np.bincount(place, weights=np.log10(count + 1)), np.bincount(place, weights=count > 0)
    which = owner >> 32
    names = np.unique(chunks)
    cut = np.searchsorted(which, np.arange(len(names) + 1))
    for c in range(len(names)):
        yield _rows([int(names[c])], 4, int(names[c]), [sums[cut[c] : cut[c + 1]].tobytes()])


def _finish(fitted_tokens: int, fitted_types: int):
    """Reduce by chunk: documents with the sums of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, np.ndarray] = {}
        sums: dict[int, list] = {}
        for batch in batches:
            for kind, chunk, blob in zip(batch.column("kind").to_pylist(), batch.column("chunk").to_pylist(), batch.column("blob")):
                if kind == 2:
                    docs[chunk] = np.frombuffer(blob.as_buffer(), _DOC).copy()
                else:
                    sums.setdefault(chunk, []).append(np.frombuffer(blob.as_buffer(), _PART_SUM).copy())
        for chunk, out in docs.items():
            if chunk in sums:
                s = np.concatenate(sums.pop(chunk))
                out["log"] += np.bincount(s["doc"], weights=s["log"], minlength=len(out))
                out["known"] += np.bincount(s["doc"], weights=s["known"], minlength=len(out)).astype(np.int64)
            base = out["log"] - out["tokens"] * np.log10(fitted_tokens + fitted_types + 1.0)
            columns = [pa.array(out["id"], mask=out["null"].astype(bool)), pa.array(out["held"].astype(bool)), pa.array(out["tokens"]), pa.array(out["known"]), pa.array(np.full(len(out), fitted_tokens)), pa.array(base), pa.array(out["score"])]
            empty = out["bytes"] == 0
            rate = -out["score"] * np.log2(10) / np.maximum(out["bytes"], 1)
            columns += [pa.array(out["bytes"]), pa.array(rate, mask=empty)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return run


def score(docs: DataFrame, fitted: Fitted | None = None, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2)) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities),
    n_bytes and bits_per_byte (of the score, the end mark included; null for an empty text).

    With ``fitted`` from other documents, words outside its commonest count only what ``docs`` itself trains on.
    """
    spark = docs.sparkSession
    fitted = fitted or fit(docs, id_col, text_col, held_out)
    shared = spark.sparkContext.broadcast(fitted)
    n_parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _held_out(id_col, held_out).alias("held"))
    scored = rows.mapInArrow(_score(shared, n_parts), _ROWS).repartition("key").mapInArrow(_look_up, _ROWS)
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return scored.repartition("chunk").mapInArrow(_finish(fitted.tokens, fitted.types), schema).withColumnRenamed("id", id_col)


def bits_per_byte(scored: DataFrame, *by: str) -> DataFrame:
    """Total bits per byte of what was scored, or of each group of the columns ``by``: one pass, however ids repeat."""
    total = F.try_divide(-F.sum("score") * F.lit(float(np.log2(10))), F.sum("n_bytes")).alias("bits_per_byte")
    return scored.groupBy(*by).agg(F.sum("n_bytes").alias("n_bytes"), total)
