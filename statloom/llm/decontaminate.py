"""Benchmark decontamination, in DataFrame operations only.

The benchmark's windows are a broadcast hash set; a document's word windows are hashed in place and probed in it, and each hit is verified
word by word before it counts. A set above ``BROADCAST_BYTES`` is joined by a shuffle of the hashes instead. Documents are read and parted
into words once; only windows that hold a known shorter run of words at a fixed step are hashed at all (``grams``), which loses none.

Defined results: a null or empty text has no words and is clean; an item without words has no window. An item of fewer words than the
window is one window of its own length. Rows that repeat a key count once (see ``frames.keyed``); rows with a null key are left out.
Other columns of either input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.frames import fresh, keyed, materialize
from statloom.llm.text import NON_ALNUM_BYTES

WINDOW = 10
#: The window table is broadcast up to this size; beyond it the probe is a shuffled join that AQE splits where a window is hot.
BROADCAST_BYTES = 64 << 20

# Words are what stands between these characters; A-Z is folded first. Each is named alone, as Java looks such a class up in a table.
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in NON_ALNUM_BYTES) + "]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # there, lower() folds A-Z and nothing else
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, key, window): every window of every item and its hash."""
    items = keyed(benchmark, id_col, text_col).select(F.col(id_col).cast("string").alias("item_id"), words(text_col).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1)))
    out = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()
    return out.select("item_id", F.xxhash64("window").alias("key"), "window")


def step(n: int) -> int:
    """Every how many words a document is looked at for windows of ``n`` words."""
    return (n + 1) // 2


def grams(windows: DataFrame) -> DataFrame:
    """Rows (gram): hashes of the runs of words of which one starts at a multiple of ``step`` wherever a window occurs.

    Of ``step(n)`` places in a row one is such a multiple, so the runs of n + 1 - step(n) words at the first ``step(n)`` places of a window are enough.
    """
    every = F.expr("(len + 1) div 2").cast("int")
    runs = F.transform(F.sequence(F.lit(1), every), lambda i: F.xxhash64("len", F.slice("window", i, F.col("len") + 1 - every)))
    return windows.select(F.explode(runs).alias("gram")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified occurrences (id, at, len, key) of benchmark windows, ``at`` from 0, and the window table itself."""
    table = windows(benchmark, size, item_col, item_text)
    return _occurrences(docs, table, id_col, text_col, False).select(id_col, "at", "len", "key"), table


def _occurrences(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, counted: bool) -> DataFrame:
    """Rows (id, n_words, at, len, key): the verified occurrences, and if ``counted`` one row more for each document, in which ``at`` is null.

    At every ``step`` words of a document the run of words is hashed, in generated code, and looked up in ``grams``. The windows around a run that is known
    are hashed and probed in the set of window hashes; where one is found, all words are compared. Each window has one such run, so it is found once.
    """
    probe = table.select("key", "window").distinct().withColumn("len", F.size("window"))
    shape = probe.agg(F.collect_set("len").alias("lens"), F.sum(F.lit(64) + F.aggregate("window", F.lit(0), lambda a, w: a + F.octet_length(w) + F.lit(24))).alias("bytes")).collect()[0]
    small = (shape["bytes"] or 0) <= BROADCAST_BYTES
    lens = sorted(shape["lens"]) or [WINDOW]
    k, steps = len(lens), [step(n) for n in lens]
    base = docs.select(id_col, words(text_col).alias("w"))
    # one number for each place and length: place * k + index of the length; -1 stands for the document itself
    places = [
        F.when(F.size("w") >= n, F.sequence(F.lit(j).cast("long"), (F.size("w") - F.lit(n + 1 - s)).cast("long") * k + j, F.lit(k * s).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
        for j, (n, s) in enumerate(zip(lens, steps))
    ]
    codes = F.concat(F.array(F.lit(-1).cast("long")), *places)
    of = lambda values: F.lit(values[0]) if k == 1 else F.get(F.array(*[F.lit(v) for v in values]), (F.col("code") % k).cast("int"))
    itself = F.col("code") < 0
    # never empty, but explode() would add a filter that parts the text into words a second time
    runs = base.select(id_col, "w", F.explode_outer(codes).alias("code"))
    runs = runs.withColumns({"len": of(lens), "q": F.expr(f"cast(code div {k} as int)"), "every": of(steps)})
    runs = runs.withColumn("gram", F.when(itself, F.lit(0).cast("long")).otherwise(F.xxhash64("len", F.slice("w", F.col("q") + 1, F.col("len") + 1 - F.col("every")))))
    known = grams(probe).withColumn("known", F.lit(True))
    side = probe.select("key", "window")
    if small:
        met = runs.join(F.broadcast(known), "gram", "left").filter(itself | F.col("known"))
    else:  # runs are dealt by hash without their words; the few that are known fetch them
        met = runs.filter(~itself).select(id_col, "code", "len", "q", "every", "gram").join(known, "gram").join(base, id_col)
    around = F.sequence(F.greatest(F.lit(0), F.col("q") + 1 - F.col("every")), F.least(F.col("q"), F.size("w") - F.col("len")))
    at = met.select(id_col, "w", "code", "len", F.explode_outer(F.when(itself, F.array(F.lit(0))).otherwise(around)).alias("at"))
    at = at.select(id_col, F.size("w").cast("long").alias("n_words"), "code", "len", "at", F.when(~itself, F.slice("w", F.col("at") + 1, F.col("len"))).alias("own"))
    at = at.withColumn("key", F.when(~itself, F.xxhash64("own")))
    found = at.join(F.broadcast(side), "key", "left") if small else at.join(side, "key")
    found = found.filter(itself | (F.col("own") == F.col("window"))).select(id_col, "n_words", F.when(~itself, F.col("at").cast("long")).alias("at"), F.when(~itself, F.col("len")).alias("len"), "key")
    if not counted:
        return found.filter(F.col("at").isNotNull())
    if small:
        return found
    none = [F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("len", "int"), ("key", "long"))]
    return found.unionByName(base.select(id_col, F.size("w").cast("long").alias("n_words"), *none))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated and ``spans`` (hit word ranges, end exclusive).

    Hits are first gathered for each document where they are found (map-side combine), so a window that many documents share is spread by document.
    """
    return _report(keyed(docs, id_col, text_col), benchmark, size, id_col, text_col, item_col, item_text)


def _report(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """``report`` of documents that have a key of any type, each once."""
    table = windows(benchmark, size, item_col, item_text)
    found = materialize(_occurrences(docs, table, id_col, text_col, True))
    by_doc = found.filter(F.col("at").isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("h"), F.collect_set("key").alias("keys"))
    # sorted ranges; a range that begins before the farthest end so far adds only what lies beyond it
    spans = F.aggregate(
        "h",
        F.expr("cast(array() as array<struct<at:bigint,end:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["at"] <= F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["at"].alias("at"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = materialize(by_doc.select(id_col, "keys", spans.alias("spans")))
    items = merged.select(id_col, F.explode("keys").alias("key")).join(table.select("key", "item_id"), "key").groupBy(id_col).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = merged.join(items, id_col).select(id_col, "spans", "items")
    return (
        found.filter(F.col("at").isNull())
        .select(id_col, "n_words")
        .join(hit, id_col, "left")
        .select(
            id_col,
            "n_words",
            F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["at"]), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("spans").isNotNull().alias("contaminated"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<at:bigint,end:bigint>>)")).alias("spans"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", mode: str = "documents", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with ``mode='spans'`` without the hit words (the kept words joined by spaces).

    Every row is judged by its own text, so null or repeated ids need no rule: all rows come back but the contaminated ones.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    key, own, hit = fresh(docs, "text_key"), fresh(docs, "words"), fresh(docs, "hit_spans")
    rows = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    if mode == "documents":
        found, _ = hits(rows, benchmark, size, key, text_col, item_col, item_text)
        return rows.join(found.select(F.col(key)).distinct(), key, "left_anti").select(docs.columns)
    texts = rows.select(key, F.col(text_col).alias("text")).dropDuplicates([key])
    spans = _report(texts, benchmark, size, key, "text", item_col, item_text).filter("contaminated").select(key, F.col("spans").alias(hit))
    rows = rows.join(spans, key, "left").withColumn(own, F.when(F.col(hit).isNotNull(), words(text_col)))
    kept = F.filter(own, lambda x, i: ~F.exists(hit, lambda s: (i >= s["at"]) & (i < s["end"])))
    columns = [F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(F.array_join(kept, " ")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return rows.select(columns)


def oracle(size: int = WINDOW) -> str:
    """The same report in DuckDB SQL."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered}, '{word}') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({lowered}, '{word}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {size}) AS n, array_to_string(w[i : i + least(len(w), {size}) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {size - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
