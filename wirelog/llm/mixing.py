"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources share ``share`` times the words of the corpus by weight; a source takes at most
``most`` times its own words, and what it cannot take is shared again by weight. The shares
become whole blocks of ``BLOCK_WORDS`` words, dealt to sources by highest quotients. A source's
documents are dealt by hash to shards of about ``SHARD_WORDS`` words, and the source's blocks
to its shards, again by highest quotients. In a shard the documents lie end to end in seeded
order and are cut into blocks; the quota takes every block as often as it goes round, and the
rest in seeded order of blocks. A document gives the words of it that lie in taken blocks.
Everything follows from hashes of ids and sizes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelog.llm.frames import Scratch, named, words_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 16
SEED = 17


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (a small table).

    Sources in order of code points, null last, weigh ``weights`` in turn. The water level
    at which capped sources and the shares of the others add up is found by one running sum
    over sources in order of capacity per weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levelled = weighed.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return levelled.withColumn("open", open_level).select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least("cap", F.coalesce(F.col("open") * F.col("weight"), F.col("cap"))))
        .alias("target"),
    )


def sainte_lague(parties: DataFrame, within: list[str], key: Column, votes: str, seats: str, out: str) -> DataFrame:
    """``parties`` with ``out``: whole seats by highest quotients votes / (2 k + 1) in each group.

    A divisor too large by construction gives seats that are safe; the few that remain go to
    the highest quotients left, ties to the least ``key``. The candidates are at most a few
    per party, so their table is no larger than a multiple of the parties.
    """
    group = Window.partitionBy(*within)
    summed = parties.withColumns(
        {"_key": key, "_votes": F.sum(votes).over(group).cast("double"), "_n": F.count("*").over(group)}
    )
    spare = F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0.0))
    sure = F.when((spare > 0) & (F.col("_votes") > 0), F.floor(F.col(votes) * spare / F.col("_votes") + 0.5 - 1e-9)).otherwise(0)
    counted = summed.withColumn("_sure", F.greatest(sure, F.lit(0)).cast("long"))
    counted = counted.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    more = F.when(
        (F.col("_votes") > 0) & (F.col("_left") > 0),
        F.least(F.col("_left"), F.ceil(F.col(votes) * F.col("_n") / F.col("_votes")) + 2),
    ).otherwise(0).cast("long")
    offers = counted.select(
        *within, "_key", "_left",
        F.explode(F.when(more > 0, F.sequence(F.lit(0).cast("long"), more - 1))).alias("_step"),
        F.col("_sure"), F.col(votes).alias("_offer"),
    ).withColumn("_quotient", F.col("_offer") / (2 * (F.col("_sure") + F.col("_step")) + 1))
    ranked = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), "_key", "_step")
    won = (
        offers.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(*within, "_key")
        .agg(F.count("*").alias("_won"))
    )
    condition = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*within, "_key"]]
    joined = counted.alias("p").join(won.alias("w"), condition, "left")
    return joined.select(
        *[F.col(f"p.{c}") for c in parties.columns],
        (F.col("p._sure") + F.coalesce("w._won", F.lit(0))).alias(out),
    )


def mix_sources(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` per row of ``docs``.

    ``size`` counts the words of the text (null: none), ``taken`` the words the mix takes with
    repeats, at most ``most`` times ``size`` for a whole ``most``. A null source is a source,
    the last in order. Rows that repeat an id are placed one after the other. Rows of size 0
    give nothing; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        named(id_column).alias("doc_id"),
        named(source_column).alias("source"),
        F.size(words_of(named(text_column))).cast("long").alias("size"),
    )
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = scratch.store(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = targets(sizes.select("source", "source_size"), weights, share, most).join(
        sizes.select(F.col("source").alias("_source"), "n_rows"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seated = sainte_lague(
        plan.withColumns({"all": F.lit(0), "seats": F.round(F.sum("target").over(everything) / block_words).cast("long")}),
        ["all"], F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "target", "seats", "blocks",
    )
    n_shards = F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_rows") / SHARD_ROWS)
    ).cast("long")
    seated = scratch.store(
        seated.select("source", "source_size", "target", "blocks", n_shards.alias("n_shards")), "sources"
    )
    # one row per source, broadcast by Spark only if its measured size allows
    placed = rows.join(seated.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", "blocks",
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("n_shards")).alias("shard"),
        F.xxhash64("doc_id", F.lit(seed + 1)).alias("turn"),
    )
    line = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = scratch.store(placed.withColumn("end", F.sum("size").over(line)), "laid")
    shards = laid.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = sainte_lague(shards, ["source"], F.col("shard"), "words", "blocks", "quota").withColumn(
        "n_blocks", F.ceil(F.col("words") / block_words).cast("long")
    )
    quotas = scratch.store(
        quotas.where("n_blocks > 0").withColumn("quota", F.least("quota", (F.col("n_blocks") * F.lit(most)).cast("long"))),
        "quotas",
    )
    blocks = quotas.select(
        "source", "shard", "quota", "n_blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"),
    )
    drawn = Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed)), "block")
    times = blocks.withColumn("rank", F.row_number().over(drawn)).select(
        "source", "shard", "block",
        (F.floor(F.col("quota") / F.col("n_blocks")) + (F.col("rank") <= F.col("quota") % F.col("n_blocks")).cast("long")).alias("times"),
    )
    first = F.floor((F.col("end") - F.col("size")) / block_words)
    last = F.floor((F.col("end") - 1) / block_words)
    numbered = laid.withColumn("row", F.struct("doc_id", "end"))
    pieces = numbered.where("size > 0").select(
        "source", "shard", "doc_id", "size", "end", F.explode(F.sequence(first, last)).alias("block")
    )
    at = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("source", "shard", "block")]
    overlap = F.least("end", (F.col("d.block") + 1) * block_words) - F.greatest(F.col("end") - F.col("size"), F.col("d.block") * block_words)
    taken = (
        # one row per block of the corpus: merged, for its size cannot be told from its source
        pieces.alias("d").join(times.alias("t").hint("merge"), at)
        .groupBy("d.source", "d.shard", "doc_id", "size", "end")
        .agg(F.sum(overlap * F.col("times")).alias("taken"))
    )
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("source", "shard", "doc_id", "size", "end")]
    return laid.alias("l").join(taken.alias("k"), same, "left").select(
        F.col("l.doc_id").alias("doc_id"), F.col("l.size").alias("size"), F.col("l.source_size").alias("source_size"),
        F.col("l.target").alias("target"), F.coalesce("k.taken", F.lit(0).cast("long")).alias("taken"),
    )
