"""Benchmark decontamination by winnowing.

A window of t words is wanted wherever it stands in a document. With k-grams of
k = ceil(t / 2) words, the smallest k-gram hash of every t words in a row is kept as a
fingerprint: a window that stands in two texts gives both the same one, so a join of
fingerprints loses no shared window. Its hits are extended to the windows that hold
them, and those are compared word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.llm.common import broadcast_if_small, let, lower_ascii
from annalog.session import cut_lineage

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, of lower-cased text
WINDOW = 10


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    spaced = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _gram(length: int) -> int:
    return (length + 1) // 2


def _gram_hash(tokens: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(tokens, at + j) for j in range(k)])


def _fingerprints(tokens: Column, length: int) -> Column:
    """Distinct smallest hashes of every `length` words in a row; none if too short."""
    k = _gram(length)
    span = length - k + 1
    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - k), lambda i: _gram_hash(tokens, i, k))

    def smallest(h: Column) -> Column:
        if span == 1:
            return F.array_distinct(h)
        starts = F.sequence(F.lit(0), F.size(h) - span)
        return F.array_distinct(F.transform(starts, lambda i: F.least(*[F.get(h, i + j) for j in range(span)])))

    enough = F.size(tokens) >= length
    return F.when(enough, let(hashes, smallest)).otherwise(F.array().cast("array<bigint>"))


def _windows(tokens: Column, length: int, hits: Column) -> Column:
    """(start, length, text) of the windows that hold a k-gram of `hits`."""
    k = _gram(length)
    n = F.size(tokens)
    at = F.filter(F.sequence(F.lit(0), n - k), lambda i: F.array_contains(hits, _gram_hash(tokens, i, k)))
    starts = F.transform(
        at, lambda p: F.sequence(F.greatest(p - (length - k), F.lit(0)), F.least(p, n - length))
    )
    found = F.transform(
        F.array_distinct(F.flatten(starts)),
        lambda s: F.struct(
            s.alias("start"),
            F.lit(length).alias("length"),
            F.concat_ws(" ", *[F.get(tokens, s + j) for j in range(length)]).alias("window"),
        ),
    )
    return F.when(n >= length, found).otherwise(_no_windows())


def _no_windows() -> Column:
    return F.array().cast("array<struct<start:int,length:int,window:string>>")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, length, item_id), distinct: all windows of each item's text, and the whole
    text of an item that is shorter. Items without words or without id have none."""
    rows = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    cut = F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, length), " "))
    rows = rows.where(F.size("w") > 0).select("item_id", length.alias("length"), F.explode(cut).alias("window"))
    return rows.distinct()


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (start, length)."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        fresh = F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.sort_array(spans), begin, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, and `key`, a hash of the text.

    A null or empty text has no words and no hits; without items nothing is hit. Rows
    that repeat a doc_id and text get the same result each, rows that share only the
    doc_id are judged apart, a null doc_id stays. Other columns are not read.

    The items' windows and fingerprints are stored and counted; up to a million rows
    they are broadcast, beyond that the same joins shuffle (the hash of a passage that
    many documents share is then split by the adaptive skew join). The texts are
    shuffled once, by their own key, to meet the hashes found in them."""
    spark = docs.sparkSession
    wanted = cut_lineage(item_windows(items, window))
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())  # at most `window`
    by_text = cut_lineage(wanted.groupBy("window").agg(F.collect_set("item_id").alias("items")))
    n_windows = by_text.count()

    tokens = F.split("window", " ")
    none = F.array().cast("array<bigint>")
    prints = none
    for n in lengths:
        prints = F.when(F.col("length") == n, _fingerprints(tokens, n)).otherwise(prints)
    hashes = wanted.select(F.explode(prints).alias("hash")).distinct()
    hashes = broadcast_if_small(hashes, n_windows)

    key = F.xxhash64("text")
    rows = docs.select("doc_id", "text")
    if not lengths:
        found = spark.createDataFrame([], docs.select("doc_id").schema).select(
            "doc_id", F.lit(0).cast("long").alias("key"), none.alias("hits")
        )
    else:
        every = let(words(F.col("text")), lambda w: F.array_distinct(F.concat(*[_fingerprints(w, n) for n in lengths])))
        shared = rows.select("doc_id", key.alias("key"), F.explode(every).alias("hash")).join(
            hashes, "hash", "left_semi"
        )
        found = shared.groupBy("doc_id", "key").agg(F.collect_set("hash").alias("hits"))

    # Every row brings a marker (start -1), so that rows without windows stay and
    # repeated rows are counted.
    mark = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window")))

    def judge(w: Column) -> Column:
        spans = F.concat(mark, *[_windows(w, n, F.col("hits")) for n in lengths])
        return F.struct(F.size(w).alias("n"), F.when(F.col("hits").isNull(), mark).otherwise(spans).alias("spans"))

    left, right = rows.withColumn("key", key).alias("l"), found.alias("r")
    joined = left.join(
        right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key")), "left"
    ).select("l.doc_id", "l.key", "l.text", "r.hits")
    judged = joined.select("doc_id", "key", let(words(F.col("text")), judge).alias("j"))
    spans = judged.select("doc_id", "key", F.col("j.n").cast("long").alias("n_words"), F.explode("j.spans").alias("s"))
    spans = spans.select("doc_id", "key", "n_words", "s.start", "s.length", "s.window")
    exact = spans.join(broadcast_if_small(by_text, n_windows), "window", "left").where(
        (F.col("start") < 0) | F.col("items").isNotNull()
    )
    hit = F.col("start") >= 0
    grouped = exact.groupBy("doc_id", "key", "n_words").agg(
        F.count_if(~hit).alias("copies"),
        F.collect_set(F.when(hit, F.struct("start", "length"))).alias("spans"),
        F.collect_set(F.when(hit, F.col("items"))).alias("items"),
    )
    out = grouped.select(
        "doc_id",
        "key",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.array_distinct(F.flatten("items")).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))),
    )
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "key",
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows that hold a window of an item; see `contamination`."""
    bad = contamination(docs, items, window).where("contaminated").select("doc_id", "key").distinct()
    bad = cut_lineage(bad)
    l, r = docs.alias("l"), broadcast_if_small(bad, bad.count()).alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("l.text") == F.col("r.key"))
    return l.join(r, same, "left_anti").select("l.*")
