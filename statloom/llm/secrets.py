"""Secret scans: every rule compiled into one minimal automaton that reads each byte once.

Defined results: a null or empty text has no spans. Offsets count code points, ends are exclusive. Repeated rows and repeated or null
ids are scanned on their own and each gives its row. Other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.automaton import Automaton
from statloom.llm.frames import ship


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost, longest, non-overlapping matches; those shorter than ``least`` are dropped afterwards.

    With ``value_only`` the length is that of the value after the first ``:`` or ``=``, not of the whole match.
    """

    kind: str
    pattern: str
    fold: bool = False
    least: int = 0
    value_only: bool = False


# The base rules, in the order that ties are listed. A hex match is a whole run, so runs of under 8, which never have
# the length, need not be found; with {32,} the counter would give the automaton four times as many states.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", fold=True, least=8, value_only=True),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{8,}", least=32),
)
# Further kinds that scanners look for.
EXTRA = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# The characters of an assigned value.
_VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


class Scanner:
    """All rules in one automaton; ``spans`` gives (start, end, rule) of a text in bytes."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + EXTRA):
        self.rules = rules
        self.combined = Automaton([(r.pattern, r.fold) for r in rules], searching=True)
        self.forward = [Automaton([(r.pattern, r.fold)], searching=False) for r in rules]
        self.backward = [Automaton([(r.pattern, r.fold)], searching=False, reverse=True) for r in rules]
        self.root = self.combined.linked()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "root"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.root = self.combined.linked()

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        row, ends = self.root, []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                ends.append((i + 1, row[256]))
        if not ends:
            return []
        out = []
        reach = [0] * len(self.rules)
        for end, found in ends:
            for k in found:
                if end <= reach[k]:
                    continue
                start = self._start(k, data, end, reach[k])
                if start < 0:
                    continue
                stop = self._stop(k, data, start, end)
                reach[k] = stop
                if self._long_enough(self.rules[k], data, start, stop):
                    out.append((start, stop, k))
        out.sort(key=lambda s: (s[0], s[2], s[1]))
        return out

    def _start(self, k: int, data: bytes, end: int, low: int) -> int:
        """The leftmost start, at ``low`` or after, of a match that ends at ``end``; -1 if there is none."""
        auto, s, best = self.backward[k], 0, -1
        for i in range(end - 1, low - 1, -1):
            s = auto.next[s][data[i]]
            if s == auto.dead:
                break
            if auto.accepts[s]:
                best = i
        return best

    def _stop(self, k: int, data: bytes, start: int, end: int) -> int:
        """The end of the longest match from ``start``."""
        auto, s, best = self.forward[k], 0, end
        for i in range(start, len(data)):
            s = auto.next[s][data[i]]
            if s == auto.dead:
                break
            if auto.accepts[s]:
                best = i + 1
        return best

    @staticmethod
    def _long_enough(rule: Rule, data: bytes, start: int, stop: int) -> bool:
        if not rule.value_only:
            return stop - start >= rule.least
        # the value begins after the first : or = and what may stand around it
        i = start
        while data[i] not in b":=":
            i += 1
        i += 1
        while data[i] == 0x20:
            i += 1
        if data[i] not in _VALUE:
            i += 1
        return stop - i >= rule.least


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """One row for each input row: the id and ``spans``, an array of (kind, start, end) by start, then rule order.

    One narrow pass over the table: no shuffle, memory bounded by an Arrow batch; the driver compiles the rules and tasks get the
    transition arrays, whose size depends on the rules alone.
    """
    ship(docs.sparkSession)
    schema = f"`{id_col}` long, spans array<struct<kind:string,start:long,end:long>>"

    scanner = Scanner(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in rules]
        for batch in batches:
            found = []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans = scanner.spans(data)
                if spans and not data.isascii():
                    spans = [(len(data[:a].decode()), len(data[:b].decode()), k) for a, b, k in spans]
                found.append([{"kind": kinds[k], "start": a, "end": b} for a, b, k in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(scan, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """The ids and texts with every span replaced by ``mask``; overlapping spans become one."""
    ship(docs.sparkSession)

    scanner = Scanner(rules)

    def clean(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                if not text.is_valid:
                    out.append(None)
                    continue
                data, last, kept = text.as_buffer().to_pybytes(), 0, []
                for start, stop, _ in scanner.spans(data):
                    if start >= last:
                        kept += [data[last:start], mask.encode()]
                    last = max(last, stop)
                out.append(b"".join([*kept, data[last:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, text_col])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(clean, f"`{id_col}` long, `{text_col}` string")


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report columns: counts of the base kinds, the digest of the base spans and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in BASE]
    return spans.select(
        id_col,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(*base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    """The digest of base spans (start, end, kind) already in order; for tests and single texts."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
