"""Repeated units of text across a corpus: sentences, lines or paragraphs by digest, and lines by template.

Both operators explode documents into units, find the units that repeat with aggregates that combine map-side, and drop them. The
units that repeat most (a bounded number of keys) are probed by broadcast, all others by a shuffled join, so that no key gathers in one task.

Units by digest (``drop_repeats``): normalised units are grouped by digest over the whole corpus and every unit but the earliest of its
group, by (id, position), is a repeat. Short units such as ``Of.`` repeat by chance, so only runs go: consecutive repeats of ``MIN_RUN``
words or more together, at least one of them of ``MIN_UNIT`` words.

Templates (``drop_templates``): lines go down a tree of fixed depth, by token count and then by leading tokens, tokens with a digit being
variable at every level. In a leaf, a position that holds more than ``values`` different tokens among the leaf's different lines is a variable
field, whatever the order in which lines arrive; a line whose template would keep less than ``similarity`` of its positions stays as it is. A
template goes if it stands in ``min_docs`` documents, or from ``long_tokens`` tokens on in ``long_docs``.

Defined results, for both: null text stays null and has no units; empty text stays empty; units that are empty after normalising are
never removed on their own and do not end a run. Rows that repeat an id count as one document (see ``frames.keyed``), rows with a null id
are left out. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.frames import keyed, materialize, ship, slices

#: So many of the most frequent keys are broadcast; the rows' size is fixed, so this bounds the broadcast.
HOT_KEYS = 2000
#: The least words of a run of repeated units, and of the longest unit in it.
MIN_RUN, MIN_UNIT = 20, 4
#: Documents in which a template recurs before it goes, the tokens from which it is long, and the documents that a long one takes.
MIN_DOCS, LONG_TOKENS, LONG_DOCS = 10, 20, 2
#: More different tokens than this make a position of a leaf a variable field; the share of positions that a template keeps.
VALUES, SIMILARITY = 10, 0.7

# Fixed values.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"[\x20\x09-\x0D]+"
VARIABLE = "<*>"
#: Units by kind; the matches of each pattern, one after the other, are the whole text.
UNITS = {
    "sentence": r"[^.!?\n]*[.!?\n]+|[^.!?\n]+",
    "line": r"[^\n]*\n|[^\n]+",
    "paragraph": r"(?s).+?(?:\n{2,}|$)",
}


def _folded(text: str | Column) -> Column:
    return F.translate(F.col(text) if isinstance(text, str) else text, _UPPER, _LOWER)


def normalised(folded: Column) -> Column:
    """Runs of white space as one space, none at the ends; A-Z are folded before the text is split."""
    return F.trim(F.regexp_replace(folded, _SPACES, " "))


def digest(unit: Column) -> Column:
    return F.unhex(F.md5(unit.cast("binary")))


def _tokens(line: Column) -> Column:
    """Number of tokens of a normalised line that is not empty."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _repeated(units: DataFrame, repeats: DataFrame, condition: str) -> DataFrame:
    """Rows of ``units`` whose key is in ``repeats`` (key, n, ...) and for which ``condition`` holds."""
    repeats = materialize(repeats)
    hot = F.broadcast(repeats.orderBy(F.desc("n"), "key").limit(HOT_KEYS))
    rest = repeats.join(hot.select("key"), "key", "left_anti")
    often = units.join(hot, "key").filter(condition)
    seldom = units.join(hot.select("key"), "key", "left_anti").join(rest, "key").filter(condition)
    return often.unionByName(seldom)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rebuild(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, remove) -> DataFrame:
    """id, kept text, number of units and what was removed as (start, end) code points of the input text.

    ``gone`` has one row for each document that may lose something; ``remove(text, positions)`` gives kept text, units and spans.
    """
    ship(docs.sparkSession)
    joined = docs.join(gone.select(id_col, "_gone"), id_col, "left").select(id_col, text_col, "_gone")
    schema = f"`{id_col}` long, kept string, n_units long, spans array<struct<start:long,end:long>>"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(None, 0, []) if text is None else remove(text, gone) for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kept, size, spans = zip(*found) if found else ((), (), ())
            spans = [[{"start": a, "end": b} for a, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(spans, _SPAN)], names=[id_col, "kept", "n_units", "spans"])

    return joined.mapInArrow(rebuild, schema)


def _runs_of(pattern: str, min_run: int, min_unit: int):
    """Remove runs of repeated units; positions count the units that are not empty, and empty ones within a run go with it."""
    unit, word = re.compile(pattern), re.compile(r"[^\x20\x09-\x0D]+")

    def remove(text: str, gone) -> tuple[str, int, list]:
        again, spans, n = set(gone or ()), [], 0
        start, end, total, most = None, 0, 0, 0

        def close():
            if start is not None and total >= min_run and most >= min_unit:
                spans.append((start, end))

        for m in unit.finditer(text):
            words = len(word.findall(m[0]))
            if not words:
                continue
            if n in again:
                if start is None:
                    start, total, most = m.start(), 0, 0
                end, total, most = m.end(), total + words, max(most, words)
            else:
                close()
                start = None
            n += 1
        close()
        at, stay = 0, []
        for a, b in spans:
            stay.append(text[at:a])
            at = b
        return "".join([*stay, text[at:]]), n, spans

    return remove


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_run: int = MIN_RUN, min_unit: int = MIN_UNIT) -> DataFrame:
    """Every unit stays where it stands first, by (id, position); runs of repeats go everywhere else. Offsets are those of the input text.

    ``unit`` is a key of ``UNITS``. With ``min_run`` and ``min_unit`` 1 every repeat goes. Result: id, kept, n_units, spans.
    """
    docs = keyed(docs, id_col, text_col)
    found = F.filter(F.transform(F.regexp_extract_all(_folded(text_col), F.lit(UNITS[unit]), F.lit(0)), normalised), lambda u: u != F.lit(""))
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.posexplode(found).alias("pos", "unit"))
    units = materialize(rows.select(id_col, "pos", _tokens(F.col("unit")).alias("words"), digest(F.col("unit")).alias("key")))
    first = units.groupBy("key").agg(F.min(F.struct(F.col(id_col).alias("d"), F.col("pos").alias("p"))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = _repeated(units, first, f"not (`{id_col}` = first.d and pos = first.p)").select(id_col, "pos", "words")
    gone = again.groupBy(id_col).agg(F.collect_list("pos").alias("_gone"), F.sum("words").alias("words"), F.max("words").alias("most"))
    return _rebuild(docs, gone.filter((F.col("words") >= min_run) & (F.col("most") >= min_unit)), id_col, text_col, _runs_of(UNITS[unit], min_run, min_unit))


def masked(line: Column) -> Column:
    """A normalised line with every token that has a digit as a variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(line)


def _templates(units: DataFrame, depth: int, values: int, similarity: float) -> DataFrame:
    """(key, template) of the lines that generalise further than by their digits; ``units`` has leaf, key, tokens and line.

    Only leaves with more than ``values`` different lines can have a variable field, so the tokens of all others are never read.
    """
    lines = units.groupBy("leaf", "key").agg(F.first("tokens").alias("tokens"))
    crowded = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("size")).filter((F.col("n") > values) & (F.col("size") > depth))
    crowded = materialize(crowded.select(F.col("leaf").alias("key"), "n"))
    own = _repeated(units.select(F.col("leaf").alias("key"), F.col("key").alias("line_key"), "line"), crowded, "true")
    own = materialize(own.groupBy(F.col("key").alias("leaf"), F.col("line_key").alias("key")).agg(F.first("line").alias("line")))
    fields = own.select("leaf", F.posexplode(F.split("line", " ")).alias("at", "token")).filter(F.col("at") >= depth).groupBy("leaf", "at", "token").agg(F.lit(1).alias("one"))
    variable = fields.groupBy("leaf", "at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > values).groupBy("leaf").agg(F.sort_array(F.collect_list("at")).alias("variable"))
    shown = F.transform(F.split("line", " "), lambda t, i: F.when(F.array_contains("variable", i), F.lit(VARIABLE)).otherwise(t))
    found = own.join(materialize(variable), "leaf").filter(F.size("variable") <= (1 - similarity) * F.size(F.split("line", " ")) + 1e-9)
    return found.select("key", digest(F.array_join(shown, " ")).alias("template"))


def _without(text: str, gone) -> tuple[str, int, list]:
    """The text without the lines at the positions given."""
    lines = text.split("\n")
    if not gone:
        return text, len(lines), []
    gone, at, stay, spans = set(gone), 0, [], []
    for k, line in enumerate(lines):
        if k in gone:
            spans.append((at, at + len(line)))
        else:
            stay.append(line)
        at += len(line) + 1
    return "\n".join(stay), len(lines), spans


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, depth: int = 3, keep_first: bool = True, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS, values: int = VALUES, similarity: float = SIMILARITY) -> DataFrame:
    """Lines whose template recurs in enough documents go; with ``keep_first`` the document of smallest id keeps its own.

    Result: id, kept, n_units, spans.
    """
    docs = keyed(docs, id_col, text_col)
    lines = F.transform(F.split(_folded(text_col), "\n", -1), lambda u: masked(normalised(u)))
    rows = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.posexplode(lines).alias("pos", "line")).filter("line <> ''")
    leaf = F.xxhash64(_tokens(F.col("line")), F.substring_index("line", " ", depth), F.lit("leaf"))
    units = materialize(rows.select(id_col, "pos", leaf.alias("leaf"), digest(F.col("line")).alias("key"), _tokens(F.col("line")).alias("tokens"), "line"))
    templates = materialize(_templates(units, depth, values, similarity))
    tagged = units.select(id_col, "pos", "key", "tokens").join(templates, "key", "left").select(id_col, "pos", "tokens", F.coalesce("template", "key").alias("key"))
    tagged = materialize(tagged)
    by_doc = tagged.groupBy("key", id_col).agg(F.first("tokens").alias("tokens"))
    often = by_doc.groupBy("key").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens"))
    often = often.filter((F.col("n") >= min_docs) | (F.col("tokens") >= long_tokens) & (F.col("n") >= long_docs)).drop("tokens")
    dropped = _repeated(tagged, often, f"`{id_col}` <> first" if keep_first else "true")
    return _rebuild(docs, dropped.groupBy(id_col).agg(F.collect_set("pos").alias("_gone")), id_col, text_col, _without)


def report(rebuilt: DataFrame, id_col: str = "doc_id") -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rebuilt.select(id_col, "n_units", F.size("spans").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"), spans.alias("spans"))


def oracle_repeats(unit: str = "sentence", min_run: int = MIN_RUN, min_unit: int = MIN_UNIT) -> str:
    """The report of ``drop_repeats`` in DuckDB SQL."""
    norm = f"trim(regexp_replace(translate(u, '{_UPPER}', '{_LOWER}'), '{_SPACES}', ' ', 'g'), ' ')"
    extract = f"regexp_extract_all(text, '{UNITS[unit]}')"
    return f"""
WITH a AS (SELECT doc_id, unnest({extract}) AS u, generate_subscripts({extract}, 1) AS ix FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, ix, u, nullif({norm}, '') AS key, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY ix) AS e FROM a),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, ix) > 1 AS again FROM k WHERE key IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ix) AS island, len(string_split(key, ' ')) AS words FROM m),
r AS (SELECT doc_id, min(e - length(u)) AS s, max(e) AS e FROM g WHERE again GROUP BY doc_id, island HAVING sum(words) >= {min_run} AND max(words) >= {min_unit}),
x AS (SELECT k.doc_id, k.ix, k.u, r.doc_id IS NOT NULL AS gone FROM k LEFT JOIN r ON k.doc_id = r.doc_id AND k.e > r.s AND k.e <= r.e),
t AS (SELECT doc_id, string_agg(u, '' ORDER BY ix) FILTER (NOT gone) AS kept FROM x GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_units FROM m GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN o USING (doc_id) WHERE d.doc_id IS NOT NULL"""


def oracle_templates(min_docs: int = MIN_DOCS, depth: int = 3, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS, values: int = VALUES, similarity: float = SIMILARITY) -> str:
    """The report of ``drop_templates`` in DuckDB SQL."""
    norm = f"trim(regexp_replace(translate(u, '{_UPPER}', '{_LOWER}'), '{_SPACES}', ' ', 'g'), ' ')"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, pos, u, CASE WHEN {norm} <> '' THEN list_transform(string_split({norm}, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) END AS t,
             sum(length(u) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(u) - 1 AS s FROM l),
leaves AS (SELECT DISTINCT len(t) AS size, t[1:{depth}] AS lead, t FROM k WHERE t IS NOT NULL),
f AS (SELECT size, lead, ix FROM (SELECT size, lead, unnest(t) AS token, generate_subscripts(t, 1) AS ix FROM leaves) WHERE ix > {depth} GROUP BY ALL HAVING count(DISTINCT token) > {values}),
v AS (SELECT size, lead, list(ix) AS variable FROM f GROUP BY ALL HAVING count(*) <= {1 - similarity} * size + 1e-9),
p AS (SELECT k.*, CASE WHEN variable IS NULL THEN t ELSE list_transform(t, lambda x, i: CASE WHEN list_contains(variable, i) THEN '{VARIABLE}' ELSE x END) END AS key
      FROM k LEFT JOIN v ON len(k.t) = v.size AND k.t[1:{depth}] = v.lead),
c AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM p WHERE key IS NOT NULL GROUP BY key),
m AS (SELECT p.*, p.key IS NOT NULL AND (n >= {min_docs} OR len(p.key) >= {long_tokens} AND n >= {long_docs}) AND doc_id <> first AS gone FROM p LEFT JOIN c ON p.key = c.key),
r AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, string_agg(u, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept,
             string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(u) AS BIGINT), ',' ORDER BY pos) FILTER (gone) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN r USING (doc_id) WHERE d.doc_id IS NOT NULL"""
