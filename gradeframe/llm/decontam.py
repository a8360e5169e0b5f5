"""Benchmark decontamination as a prefix-filtered join of word windows.

An item's windows are its runs of WINDOW words. A window that occurs in a
document occurs with each of its words, so one necessary word, the rarest over
all documents, finds its candidates. Neighbouring windows mostly share that
word: the join is on (word, place in the item), which fixes the alignment of
item and document. Bounds on length and position drop alignments that stick out
of the document, and the words of the window are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.llm.common import checkpoint, join_counted, table

WINDOW = 13
#: Rows of benchmark words or windows that may be broadcast; beyond, the joins are by shuffle, with the same results.
BROADCAST_ROWS = 200_000
#: Prefix words, a few bytes each, that may be broadcast then to keep all other words of the documents out of the shuffle.
BROADCAST_KEYS = 1_000_000
#: What parts words; A-Z belong to words, and are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(text: str = "text") -> Column:
    """A text cut into words, as they are written; the first and the last piece may be empty. None for null."""
    return F.split(F.coalesce(F.col(text), F.lit("")), BREAK)


def n_words(cut: Column) -> Column:
    first, last = (F.element_at(cut, 1) == "").cast("long"), (F.element_at(cut, -1) == "").cast("long")
    return F.when(F.size(cut) == 1, 1 - first).otherwise(F.size(cut) - first - last).cast("long")


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame) -> DataFrame:
    """(item, start, length, body): every window of every item."""
    words = F.filter(lowered(pieces()), lambda w: w != "")
    split = items.select(F.col("item_id").alias("item"), words.alias("all")).filter(F.size("all") > 0)
    last = F.greatest(F.lit(0), F.size("all") - WINDOW)
    each = split.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    length = F.least(F.lit(WINDOW), F.size("all"))
    return each.select("item", "start", length.alias("length"), F.slice("all", F.col("start") + 1, length).alias("body"))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per occurrence of a window: doc_id, mark (a hash of the text), at, length, item."""
    wins = checkpoint(windows(items))
    n_wins = wins.count()
    placed = wins.select("item", "start", "length", "body", F.posexplode("body").alias("place", "word"))
    # rarity over all documents, by lower(): it equates at least what lowered() does, and is quick
    placed = placed.withColumn("key", F.lower("word"))
    said = docs.select(F.explode(pieces()).alias("word")).select(F.lower("word").alias("key"))
    wanted = placed.select("key").distinct()
    if n_wins * WINDOW <= BROADCAST_ROWS:
        said = said.join(F.broadcast(wanted), "key", "left_semi")
        wanted = None
    seen = said.groupBy("key").agg(F.count("*").alias("seen"))  # counted on both sides of the shuffle
    seen = checkpoint(seen if wanted is None else seen.join(wanted, "key", "left_semi"))
    own = W.partitionBy("item", "start")
    order = own.orderBy("seen", F.length("word").desc(), "word", "place")
    # a window with a word that no document has is nowhere
    rarest = (
        placed.join(small(seen, n_wins * WINDOW), "key")
        .withColumn("have", F.count("*").over(own))
        .withColumn("rank", F.row_number().over(order))
        .filter((F.col("have") == F.col("length")) & (F.col("rank") == 1))
    )
    prefix = checkpoint(rarest.groupBy("key").agg(F.collect_list(F.struct("item", "length", "place", F.array_join("body", " ").alias("text"), F.lower(F.col("body")[0]).alias("first"), F.lower(F.element_at("body", -1)).alias("last"))).alias("wins")))
    split = docs.select("doc_id", F.xxhash64("text").alias("mark"), pieces().alias("all"))
    if n_wins <= BROADCAST_ROWS:
        spoken = split.select("doc_id", "mark", "all", F.posexplode("all").alias("pos", "word")).withColumn("key", F.lower("word"))
        near = spoken.join(F.broadcast(prefix), "key").select("doc_id", "mark", "all", "pos", F.explode("wins").alias("w"))
        near = near.withColumn("at", F.col("pos") - F.col("w.place"))
    else:
        # only (word, document, place) meets the windows; a document's words are fetched for its candidates afterwards
        spoken = split.select("doc_id", "mark", F.posexplode("all").alias("pos", "word")).select("doc_id", "mark", "pos", F.lower("word").alias("key"))
        keys = prefix.select("key")
        if keys.count() <= BROADCAST_KEYS:
            spoken = spoken.join(F.broadcast(keys), "key", "left_semi")
        counted = prefix.join(seen, "key")
        met = join_counted(spoken, counted, "key", "seen", max(1, counted.agg(F.sum("seen")).first()[0] or 0))
        met = met.select("doc_id", "mark", "pos", F.explode("wins").alias("w")).withColumn("at", F.col("pos") - F.col("w.place")).filter("at >= 0")
        candidates = met.select(F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark"), "at", "w").distinct()
        near = split.join(candidates, split["doc_id"].eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")))
    return (
        near.filter((F.col("at") >= 0) & (F.col("at") + F.col("w.length") <= F.size("all")))
        .filter((F.lower(F.get("all", F.col("at"))) == F.col("w.first")) & (F.lower(F.get("all", F.col("at") + F.col("w.length") - 1)) == F.col("w.last")))
        # no lambda here: it would end the generated code and have each candidate carry its document's words
        .filter(F.translate(F.array_join(F.slice("all", F.col("at") + 1, F.col("w.length")), " "), UPPER, LOWER) == F.col("w.text"))
        .select("doc_id", "mark", "at", F.col("w.length").alias("length"), F.col("w.item").alias("item"))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and are clean; null item texts have no
    windows; null item ids are not listed but their windows hit. Rows of the same
    id and text get the same result each. Other columns are ignored.
    """
    hits = checkpoint(find(docs, items).distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), n_words(pieces()).alias("n_words"))
    places = hits.select("doc_id", "mark", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("place"))
    n_hit = places.distinct().groupBy("doc_id", "mark").agg(F.count("*").alias("n_hit"))
    by_item = hits.select("doc_id", "mark", "item").distinct().groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("found"))
    both = n_hit.join(by_item, (n_hit.doc_id.eqNullSafe(by_item.doc_id)) & (n_hit.mark == by_item.mark)).select(
        n_hit.doc_id.alias("hit_id"), n_hit.mark.alias("hit_mark"), "n_hit", "found"
    )
    joined = rows.join(both, rows.doc_id.eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"),
        "mark",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns.

    Null and wordless texts are clean; rows with the same id and text go or stay
    together; null ids are values like others. Without items all rows stay; an
    empty table gives an empty result.
    """
    bad = decontaminate(docs, items).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__mark"))
    return docs.join(bad, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1)::VARCHAR AS body
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)
), p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM d WHERE len(w) > 0),
h AS (
  SELECT p.doc_id, p.s, l.n, i.item_id
  FROM p CROSS JOIN (SELECT DISTINCT n FROM i) l JOIN i ON i.n = l.n AND i.body = list_slice(p.w, p.s, p.s + l.n - 1)::VARCHAR
  WHERE p.s + l.n - 1 <= len(p.w)
), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
