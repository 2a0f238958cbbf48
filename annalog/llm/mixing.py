"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share a number of words by weight; none gives more than a multiple of its own size,
and what it can't give is shared by the others. The words are handed out in equal blocks:
a source's target, counted in blocks, is its vote, and the seats (blocks) go one by one to
the highest quotient vote / 1, vote / 3, vote / 5, ... The quota of a source is apportioned
in the same way to its shards, sets of its documents of about `SHARD` words. In a shard the
documents stand in a seeded order and its words are cut into equal blocks; the quota takes
all blocks as often as it can, and the rest from a seeded block on, so that almost all
documents are taken whole.

No seat is handled one by one. Seats whose quotient is surely among the highest are counted
by a division, and only about four per party around the border are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from annalog.llm.common import count_words
from annalog.operators.lookup import lookup
from annalog.operators.numbering import running_total, text_digit
from annalog.operators.skew import small_side
from annalog.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 16  # words
SHARD = 1_000_000  # words
SEED = 7


def apportion(parties: DataFrame, group: Sequence[str], party: str, votes: str, seats: str) -> DataFrame:
    """`parties` with `quota` long: how many of the group's `seats` (the same in all its rows)
    fall to each party by Sainte-Laguë. `party` is a long that is unique in its group; equal
    quotients go to the smaller one. Votes are whole numbers; a party without votes gets
    nothing, and a group without any votes hands out no seat."""
    group = list(group)
    voting = parties.where(F.col(votes) > 0)
    totals = voting.groupBy(*group).agg(
        F.sum(F.col(votes).cast("double")).alias("_all"), F.count("*").alias("_half"), F.min(seats).alias("_seats")
    )
    rows = voting.select(*group, party, F.col(votes).cast("double").alias("_v")).join(small_side(totals), group)
    # Divisors for which the rounded shares surely add up to the seats or less, and or more.
    few = F.floor(F.col("_v") * (F.col("_seats") - F.col("_half") / 2) / F.col("_all") + 0.5) - 1
    many = F.floor(F.col("_v") * (F.col("_seats") + F.col("_half") / 2) / F.col("_all") + 0.5) + 1
    rows = cut_lineage(
        rows.where("_seats > 0").select(*group, party, "_v", "_seats", F.greatest(few, F.lit(0)).alias("_sure"), many.alias("_many"))
    )
    left = rows.groupBy(*group).agg((F.min("_seats") - F.sum("_sure")).alias("_left"))
    border = rows.select(*group, party, "_v", F.explode(F.sequence(F.col("_sure") + 1, F.col("_many"))).alias("_seat"))
    border = border.withColumn("_quotient", F.col("_v") / (2 * F.col("_seat") - 1))
    ranked = running_total(
        border,
        group,
        [F.col("_quotient").desc(), F.col(party)],
        [-F.floor(F.col("_quotient") * 1024), F.col(party)],
        name="_rank",
    )
    won = ranked.join(small_side(left), group).where("_rank <= _left").groupBy(*group, party).agg(F.count("*").alias("_won"))
    quota = rows.join(won, [*group, party], "left").select(
        *group, party, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota")
    )
    return parties.join(quota, [*group, party], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size) with `source_no` from 0 (by code point, null last),
    `weight` and `target`: the weights repeat in that order."""
    numbered = running_total(
        sources.withColumn("_all", F.lit(0)),
        ["_all"],
        [F.col("source").isNull(), F.col("source")],
        [F.col("source").isNull().cast("long"), text_digit(F.coalesce("source", F.lit("")))],
        name="source_no",
    )
    number = F.col("source_no") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = numbered.select("source", "source_size", number.alias("source_no"), weight.alias("weight"))
    rows = cut_lineage(rows.withColumn("_cap", F.lit(float(most)) * F.col("source_size")))
    wanted = rows.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight, full = share * wanted, rows.agg(F.sum("weight")).first()[0] or 0.0, 0
    while open_weight:  # each round fills at least one more source
        share_of = F.lit(rest) * F.col("weight") / F.lit(open_weight)
        over = share_of > F.col("_cap")
        caps, others, n = rows.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == full:
            break
        rest, open_weight, full = share * wanted - (caps or 0.0), others or 0.0, n
    target = F.col("_cap")
    if open_weight:
        target = F.least(F.lit(rest) * F.col("weight") / F.lit(open_weight), F.col("_cap"))
    return rows.withColumn("target", target).drop("_cap")


def _number(text: Column) -> Column:
    """The first eight hexadecimal digits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of `docs` (doc_id, source, text): doc_id, source, the columns of
    `keep`, size (its words), source_size, target, taken (words the mix takes), laps (how
    often the whole document is taken) and spans (places of the words, from 0, that are taken
    once more: an array of structs first, end; end is exclusive).

    Null is a source of its own, the last one. Null, empty and blank texts have size 0 and
    nothing is taken. A repeated row is a document of its own; equal rows may swap their
    results. A source without words has target 0. No document is taken more than `most`
    times. Other columns are not read."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    sized = cut_lineage(docs.select("doc_id", "source", *keep, count_words(F.col("text")).alias("size"), draw.alias("_draw")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = cut_lineage(sources.withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1))))

    named = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name")]
    known = sources.select(*named, "source_no", "source_size", "target", "_shards")
    rows = lookup(sized.select("*", *named), known, ["_none", "_name"], "_of")
    at = (F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") % F.col("_of._shards")).alias("_shard")
    rows = rows.select("doc_id", "source", *keep, "size", "_draw", "_of.source_no", "_of.source_size", "_of.target", at)

    cells = rows.groupBy("source_no", "_shard").agg(F.sum("size").alias("_words")).where("_words > 0")
    n = F.greatest(F.floor(F.col("_words") / block + 0.5), F.lit(1)).alias("_blocks")
    cells = cut_lineage(cells.select("source_no", "_shard", "_words", n))
    blocks = cells.groupBy("source_no").agg(F.sum("_blocks").alias("_own"))
    votes = F.floor(F.col("target") * F.col("_own") / F.col("source_size") * 1000 + 0.5).cast("long")
    votes = cut_lineage(sources.join(blocks, "source_no").select("source_no", "_own", votes.alias("_votes")))
    seats = ((votes.agg(F.sum("_votes")).first()[0] or 0) + 500) // 1000
    quotas = apportion(votes.select("*", F.lit(0).alias("_mix"), F.lit(seats).alias("_seats")), ["_mix"], "source_no", "_votes", "_seats")
    quotas = quotas.select("source_no", F.least("quota", F.col("_own") * most).alias("_quota"))
    cells = apportion(cells.join(small_side(cut_lineage(quotas)), "source_no"), ["source_no"], "_shard", "_blocks", "_quota")

    start = _number(F.concat_ws(":", F.lit(str(seed)), F.col("source_no"), F.col("_shard"))) % F.col("_blocks")
    rest = F.col("quota") % F.col("_blocks")
    edge = lambda b: F.floor(b * F.col("_words") / F.col("_blocks"))
    cells = cells.select(
        "source_no",
        "_shard",
        F.floor(F.col("quota") / F.col("_blocks")).alias("laps"),
        edge(start).alias("_low"),
        edge(F.least(start + rest, F.col("_blocks"))).alias("_high"),
        edge(F.greatest(start + rest - F.col("_blocks"), F.lit(0))).alias("_over"),
    )
    shard_order = Window.partitionBy("source_no", "_shard").orderBy("_draw").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.coalesce(F.sum("size").over(shard_order), F.lit(0)))
    rows = rows.join(cells, ["source_no", "_shard"], "left")
    inside = lambda low, high: F.struct(
        F.greatest(low - F.col("_from"), F.lit(0)).alias("first"), F.least(high - F.col("_from"), F.col("size")).alias("end")
    )
    spans = F.array(inside(F.lit(0), F.col("_over")), inside(F.col("_low"), F.col("_high")))
    rows = rows.withColumn("laps", F.when(F.col("size") > 0, F.col("laps")).otherwise(0))
    rows = rows.withColumn("spans", F.filter(spans, lambda s: s["end"] > s["first"]))
    more = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return rows.select(
        "doc_id", "source", *keep, "size", "source_size", "target", (F.col("laps") * F.col("size") + more).alias("taken"), "laps", "spans"
    )
