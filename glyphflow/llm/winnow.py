"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's fingerprints are the minimum hash of K-word grams in each window of K such grams, so any shared span of
SPAN = 2 K - 1 words has a fingerprint in common.  Fingerprints of documents and of benchmark items are joined, which
leaves few documents.  In these each gram that is a fingerprint of an item gives a diagonal (document position less item
position), along which the item's windows of SPAN words are compared with the document's words, exactly.  An item shorter
than SPAN is one window and its own fingerprint.

Grams hash the hashes of their words, so each word is read once; words are counted and cut in the text's own case, and
only words beyond ASCII are lower-cased letter by letter.  Fingerprints, diagonals and windows are rows of their own:
nothing is gathered but the ids of a document's items.  The benchmark's tables are broadcast if they have at most
BROADCAST_ROWS rows, else joined by a shuffle that the adaptive planner splits.

Defined cases: null and wordless texts have no words and no hits, and wordless items no windows; equal rows get equal
rows; items with one id are one item; an item without an id marks words but isn't counted; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.llm import runtime

SPAN, K = 13, 7
#: The same words as of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in a text in lower case, for any case; Java's matcher needs a
#: twentieth of the time for the class that isn't negated.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of at most about 40 bytes that may be broadcast.
BROADCAST_ROWS = 500_000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row and not once for each use."""
    return F.transform(F.array(value), then)[0]


def lowered(word: Column) -> Column:
    """A word with A-Z in lower case."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, in its own case."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def upto(last: Column) -> Column:
    """1 to last, nothing if last is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def hashed(words: Column) -> Column:
    """The hash of each word in lower case."""
    return F.transform(words, lambda w: F.xxhash64(lowered(w)))


def grams(hashes: Column, size: Column) -> Column:
    """The hash of each gram of that many words, by the hashes of the words."""
    return F.transform(upto(F.size(hashes) - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, size), size))


def minima(hashes: Column) -> Column:
    """The distinct minima of the windows of K grams."""
    return F.array_distinct(F.transform(upto(F.size(hashes) - (K - 1)), lambda i: F.array_min(F.slice(hashes, i, K))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame, text: str, key: str) -> DataFrame:
    """item, item_id, words, size (of a gram) and span (of a window) of each item with words."""
    words = F.transform(words_of(benchmark[text]), lowered)
    rows = benchmark.select(benchmark[key].cast("string").alias("item_id"), words.alias("words")).distinct()
    size = F.when(F.size("words") >= SPAN, K).otherwise(F.size("words"))
    return rows.where(F.size("words") > 0).select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", size.alias("size"), F.least(F.size("words"), F.lit(SPAN)).alias("span"))


def _fingerprints(items: DataFrame) -> DataFrame:
    """hash, item, at: where an item's fingerprints are, from 1."""
    rows = items.select("item", F.size("words").alias("n"), let(hashed(F.col("words")), lambda h: grams(h, F.col("size"))).alias("hashes"))
    everywhere = rows.select("item", F.posexplode("hashes").alias("at", "hash")).select("item", (F.col("at") + 1).alias("at"), "hash")
    chosen = rows.select("item", F.explode(F.when(F.col("n") >= SPAN, minima(F.col("hashes"))).otherwise(F.col("hashes"))).alias("hash"))
    return everywhere.join(chosen, ["item", "hash"], "left_semi")


def _windows(docs: DataFrame, items: DataFrame, prints: DataFrame, short: list[int]) -> DataFrame:
    """rid, item_id, first, span: where, from 1, a document holds a window of an item.  A row may come more than once."""
    chosen = let(hashed(words_of(F.col("text"))), lambda h: F.concat(let(grams(h, F.lit(K)), minima), *(F.array_distinct(grams(h, F.lit(m))) for m in short)))
    found = docs.select("rid", F.explode(chosen).alias("hash")).join(_small(prints.select("hash").distinct()), "hash", "left_semi")
    hit = runtime.written(found.select("rid").distinct(), "hit")
    texts = docs.join(_small(hit), "rid", "left_semi").select("rid", F.transform(words_of(F.col("text")), lowered).alias("words"))
    texts = runtime.written(texts.dropDuplicates(["rid"]), "texts")

    own = let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.array(*(grams(h, F.lit(m)) for m in [K, *short])))
    placed = texts.select("rid", F.explode(own).alias("hashes")).select("rid", F.posexplode("hashes").alias("place", "hash"))
    shifts = placed.join(_small(prints), "hash").select("rid", "item", (F.col("place") + 1 - F.col("at")).alias("shift")).distinct()
    shifts = runtime.written(shifts, "shifts")
    pairs = texts.join(_small(shifts), "rid").join(_small(items.withColumnRenamed("words", "item_words")), "item")
    starts = F.filter(
        upto(F.size("item_words") - F.col("span") + 1),
        lambda s: (s + F.col("shift") >= 1) & (F.slice("words", F.greatest(s + F.col("shift"), F.lit(1)), F.col("span")) == F.slice("item_words", s, F.col("span"))),
    )
    placed = pairs.select("rid", "item_id", "shift", "span", F.explode(starts).alias("start"))
    windows = runtime.written(placed.select("rid", "item_id", (F.col("start") + F.col("shift")).alias("first"), "span"), "windows")
    runtime.drop(hit, texts, shifts)
    return windows


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """rid, key, n_words, n_hit, n_items, items_sha256, contaminated; rid is equal for rows of equal key and text."""
    docs = df.select(df[key].alias("doc_id"), F.xxhash64(df[key], df[text]).alias("rid"), df[text].cast("string").alias("text"))
    items = runtime.written(_items(benchmark, item_text, item_key), "items")
    prints = runtime.written(_fingerprints(items), "prints")
    short = [r[0] for r in items.where(F.col("span") < SPAN).select("size").distinct().orderBy("size").limit(SPAN).collect()]
    windows = _windows(docs, items, prints, short)

    # Words covered: each window adds what lies beyond the ends of all windows that start before it.
    last = F.col("first") + F.col("span") - 1
    places = windows.groupBy("rid", "first").agg(F.max(last).alias("last"))
    before = F.max("last").over(Window.partitionBy("rid").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    covered = places.select("rid", (F.col("last") - F.greatest(F.col("first") - 1, F.least("last", F.coalesce(before, F.lit(0))))).alias("more"))
    covered = covered.groupBy("rid").agg(F.sum("more").alias("n_hit"))
    ids = windows.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    told = runtime.written(covered.join(ids, "rid").select("rid", F.col("n_hit").cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids")), "told")
    runtime.drop(items, prints, windows)
    out = docs.select("rid", "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")).join(_small(told), "rid", "left")
    out = out.select("rid", "doc_id", "n_words", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_hit", "n_items")), F.coalesce("ids", F.lit("")).alias("ids"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("rid", F.col("doc_id").alias(key), "n_words", "n_hit", "n_items", F.sha2("ids", 256).alias("items_sha256"), contaminated.alias("contaminated"))


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", most: int = SPAN - 1) -> DataFrame:
    """The rows of df, with all their columns, that aren't contaminated and have at most that many words hit.

    By default a whole window of SPAN words is too much in a text of any length, while a shorter item has to make up its
    share of the text.
    """
    bad = runtime.written(contamination(df, benchmark, text, key).where(F.col("contaminated") | (F.col("n_hit") > most)).select("rid").distinct(), "contaminated")
    return df.withColumn("__rid", F.xxhash64(df[key], df[text])).join(_small(bad.withColumnRenamed("rid", "__rid")), "__rid", "left_anti").drop("__rid")


def op6_winnow_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark")).drop("rid")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS words
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words
  FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, pos, size, item_id FROM doc_windows JOIN item_windows USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
