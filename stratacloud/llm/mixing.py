"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from water-filling in closed form.  Blocks go to the highest quotients
weight / (2 * seats + 1), first among the sources and then among the shards of each source,
so quotas are integers that add up.  A shard is a stream of documents in a seeded order; its
quota takes whole passes over the stream and then a cyclic run of blocks from a seeded start,
so nearly all documents are taken whole.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm._common import WORD, cut, repeated_ids, text_or_empty

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_TOKENS = 4
#: A source has a shard for so many documents, and at most so many shards.
SHARD_DOCS, MOST_SHARDS = 64, 256
SEED = 17


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _ticket(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """totals(source, source_size, ...) with place, weight and target.

    The level to which sources fill is the largest of (total - capacities of the sources
    that fill first) / (weights of the rest) over the order of capacity by weight.  One
    row per source: the window without a key covers the sources, not the documents.
    """
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    parts = F.array(*map(F.lit, weights))
    placed = placed.withColumn("weight", F.element_at(parts, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    first = Window.orderBy((most * F.col("source_size")).cast("double") / F.col("weight"), "place")
    everything = Window.partitionBy()
    earlier = first.rowsBetween(Window.unboundedPreceding, -1)
    rest = first.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(earlier), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    filled = placed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.col("level"))).drop("level")


def sainte_lague(parties: DataFrame, key: list[str], weight: str, seats: str, order: list[str], out: str) -> DataFrame:
    """parties with `out`: the seats of each, `seats` of them in all for each key, ties in `order`.

    With n parties and S seats, a party of share f gets at least f * (S - n / 2) - 1 / 2 seats
    and at most f * (S + n / 2) + 1 / 2, so only the seats between are ranked by quotient:
    about five for each party, however many seats there are.
    """
    group = Window.partitionBy(*key)
    share = F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sum(F.col(weight).cast("double")).over(group)), F.lit(0.0))
    ranged = parties.withColumn("_f", share).withColumn("_half", F.count("*").over(group) / 2)
    ranged = ranged.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_f") * (F.col(seats) - F.col("_half")) - 1)).cast("long"))
    ranged = ranged.withColumn("_high", F.when(F.col("_f") > 0, F.ceil(F.col("_f") * (F.col(seats) + F.col("_half")) + 1)).otherwise(0).cast("long"))
    ranged = ranged.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    seat = F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)).otherwise(F.array().cast("array<long>"))
    ranked = ranged.withColumn("_seat", F.explode_outer(seat))
    quotient = F.col(weight).cast("double") / (2 * F.col("_seat") + 1)
    ranked = ranked.withColumn("_rank", F.when(F.col("_seat").isNotNull(), F.row_number().over(group.orderBy(quotient.desc_nulls_last(), *order))))
    own = [c for c in parties.columns]
    return ranked.groupBy(*own, "_low").agg(F.count(F.when(F.col("_rank") <= F.col("_open"), True)).alias("_more")).withColumn(out, F.col("_low") + F.col("_more")).select(*own, out)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    docs needs doc_id, source and text.  size counts words (null text: 0); taken counts the
    words of the document that the mix takes, repeats counted, at most `most` times its size.
    Sources rank by code point, null last, as a source of its own.  Empty documents are
    taken 0 times.  Repeated rows are taken each for itself; an empty table gives an empty result; if all
    sizes are 0, so are all targets.  Reruns agree, whatever the partitioning.
    """
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), _ticket(seed).alias("ticket")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(totals, weights, most).withColumn("shards", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("int"))
    blocks = F.round(F.sum("source_size").over(Window.partitionBy()) / block_tokens).cast("long")
    seated = sainte_lague(targets.withColumn("all", F.lit(1)).withColumn("blocks", blocks), ["all"], "target", "blocks", ["place"], "quota")
    seated = cut(seated.select("source", "place", "source_size", "target", "shards", "quota"), "quotas")

    by_source = seated.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    shard = F.pmod(F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long"), F.col("shards")).cast("int")
    placed = sized.join(by_source, same).select("doc_id", "source", "size", "ticket", "place", "source_size", "target", "quota", shard.alias("shard"))
    streams = placed.groupBy("place", "shard", "quota").agg(F.sum("size").alias("words"))
    quotas = sainte_lague(streams, ["place"], "words", "quota", ["shard"], "seats").select("place", "shard", "words", "seats")
    count = F.greatest(F.lit(1), F.round(F.col("words") / block_tokens)).cast("long")
    quotas = quotas.withColumn("n", count).withColumn("seats", F.least("seats", most * F.col("n")))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("place"), F.col("shard"))), 1, 8), 16, 10).cast("long")
    quotas = quotas.select(
        "place", "shard", F.expr("seats div n").alias("passes"), F.expr("seats % n").alias("run"), F.pmod(start, F.col("n")).alias("start"), "n", "words"
    )
    edge = lambda j: f"(({j}) * (words div n) + least({j}, words % n))"  # noqa: E731  first word of block j
    quotas = quotas.select(
        "place", "shard", "passes",
        F.expr(edge("start")).alias("from_word"), F.expr(edge("least(start + run, n)")).alias("to_word"), F.expr(edge("greatest(start + run - n, 0)")).alias("wrap_word"),
    )
    stream = Window.partitionBy("place", "shard").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(quotas, ["place", "shard"])
    end = F.col("at") + F.col("size")
    part = F.greatest(F.lit(0), F.least(end, F.col("to_word")) - F.greatest("at", "from_word")) + F.greatest(F.lit(0), F.least(end, F.col("wrap_word")) - F.col("at"))
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs as the mix takes them, each as often as it is taken whole.

    A document of which a part is taken stays whole with the chance of that part, decided
    by a seeded hash of its id, and documents never taken go.  Rows without id, or with one that other rows
    have too, go by id and text; of them only equal rows are taken alike.  Columns are those of docs.
    """
    own = docs.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    again = repeated_ids(docs)
    odd = F.col("_id").isNull()
    if not again.isEmpty():
        own = own.join(again.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")), "_id", "left")
        odd = odd | F.col("_again").isNotNull()
    named = F.concat_ws(":", F.coalesce("doc_id", F.lit("")), F.coalesce("source", F.lit("")), F.md5(text_or_empty("text")))
    own = own.withColumn("doc_id", F.when(odd, named).otherwise(F.col("doc_id")))
    taken = mix(own, seed=seed, **options).groupBy("doc_id").agg(F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("_times"))
    chance = F.conv(F.substring(_ticket(seed + 1), 1, 8), 16, 10).cast("double") / 2.0**32
    times = F.floor("_times").cast("int") + F.when(chance < F.col("_times") - F.floor("_times"), 1).otherwise(0)
    kept = own.join(taken, "doc_id").withColumn("_copies", times).where("_copies > 0").withColumn("doc_id", F.col("_id"))
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
