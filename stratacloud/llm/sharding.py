"""Sharding by balanced label propagation: linked documents meet in a shard, row counts at most one apart.

Links are hubs: documents with equal texts hang on one.  Hubs of more than a bucket of a shard,
a bounded list, are seated on the driver, the largest first, each whole in the fullest shard that
holds it; only a hub that no shard can hold is split, into as few shards as have room.  The
others join the shard that most of their documents are in, as far as the room of the whole
shard allows; hubs that found none are offered a shard that can hold them, until none moves.
Those left, again a bounded list, are split as above.  A last step evens the counts exactly:
rows in surplus, unlinked ones first and whole hubs never, fill the gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm._common import cut, drop_cut, text_or_empty

SHARDS = 40
#: Turns for which hubs are offered a shard before the first look at whether any still moves.
ROUNDS = 4
#: Ranks and quotas are dealt within at most so many buckets of a shard, each of at least so
#: many rows, so no task has to hold a shard.
BUCKETS, BUCKET_ROWS = 32, 1000
#: Parts by which the rows of a split hub are dealt to its pieces.
PARTS = 10**9


def text_size(text: str | Column = "text") -> Column:
    return (F.octet_length(text_or_empty(text)) + 16).cast("long")


def assign(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows(doc_id, link, ...) with shard and slot.

    Rows with equal link are linked; a null link links nothing.  Counts of any two shards
    differ by at most one, slots count from 0 within a shard without gaps.  Rows repeating an
    id get slots of their own; an empty table gives an empty result; with fewer rows than shards some
    shards are empty.  Reruns give the same shards.
    """
    total = rows.count()
    even = max(1, total // shards)
    buckets = max(1, min(BUCKETS, even // BUCKET_ROWS))
    first = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")
    hashed = rows.withColumn("shard", first)
    held = hashed.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n"))
    most = F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("goal")
    hubs = cut(held.groupBy("link").agg(F.sum("n").alias("n"), most).where("n > 1"), "hubs")
    free = [even] * shards
    large = F.col("n") * BUCKETS > even  # at most shards * BUCKETS of them, and as many rows on the driver
    pieces = _seat(hubs.where(large).select("link", "n").collect(), free)
    seated, waiting = [], hubs.where(~large)
    turn = 0
    while True:
        accepted = cut(_accept(waiting, free, buckets, turn), "accepted")
        taken = {r["goal"]: r["n"] for r in accepted.groupBy("goal").agg(F.sum("n").alias("n")).collect()}  # a number for each shard
        free = [f - taken.get(s, 0) for s, f in enumerate(free)]
        seated.append(accepted)
        waiting = cut(waiting.join(accepted, "link", "left_anti"), "waiting")
        turn += 1
        if waiting.isEmpty() or (turn >= rounds and not taken):
            break
    # no shard can hold the smallest of those left, so with the free rows they are fewer than two for each shard
    pieces += _seat(waiting.select("link", "n").collect(), free)
    current = cut(_placed(hashed, seated, pieces), "labels")
    drop_cut(hubs, *seated, waiting)
    return _even_out(current, total, shards, buckets)


def _seat(hubs: list, free: list[int]) -> list[tuple]:
    """(link, upto, shard, whole) of each piece, upto in thousand-millionths of the hub; takes the rows from free."""
    out = []
    for link, n in sorted(((h["link"], h["n"]) for h in hubs), key=lambda h: (-h[1], str(h[0]))):
        fits = [s for s, f in enumerate(free) if f >= n]
        if fits:
            at = min(fits, key=lambda s: (free[s], s))
            free[at] -= n
            out.append((link, PARTS, at, True))
            continue
        done = 0
        while done < n and max(free) > 0:
            at = max(range(len(free)), key=lambda s: (free[s], -s))
            part = min(n - done, free[at])
            free[at] -= part
            done += part
            out.append((link, done * PARTS // n, at, False))
    return out


def _accept(waiting: DataFrame, free: list[int], buckets: int, turn: int) -> DataFrame:
    """link, n, goal of the hubs that a shard takes: running sums within buckets, then over the buckets of a shard."""
    room = F.array(*[F.lit(f).cast("long") for f in free])
    able = F.filter(F.transform(room, lambda f, s: F.when(f >= F.col("n"), s)), lambda s: s.isNotNull())
    other = F.try_element_at(able, (F.pmod(F.xxhash64(F.lit(turn), "link"), F.greatest(F.lit(1), F.size(able))) + 1).cast("int"))
    wanted = waiting.withColumn("goal", F.col("goal") if turn == 0 else other).where("goal is not null")
    wanted = wanted.withColumn("room", F.element_at(room, F.col("goal") + 1)).where("n <= room")
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("link"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("goal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = wanted.groupBy("goal", "bucket").agg(F.sum("n").alias("_n")).select("goal", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("goal", "bucket").orderBy(F.desc("n"), "link").rowsBetween(Window.unboundedPreceding, 0)
    summed = wanted.withColumn("sum", F.sum("n").over(within)).join(F.broadcast(offsets), ["goal", "bucket"])
    return summed.where(F.col("offset") + F.col("sum") <= F.col("room")).select("link", "n", "goal")


def _placed(hashed: DataFrame, seated: list[DataFrame], pieces: list[tuple]) -> DataFrame:
    """hashed with the shards of the hubs, and keep: 0 for rows of whole hubs, 1 of split ones, 2 for unlinked rows."""
    spark = hashed.sparkSession
    kind = hashed.schema["link"].dataType.simpleString()
    split = spark.createDataFrame(pieces, f"link {kind}, upto long, at int, whole boolean")
    split = split.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("upto", "at"))).alias("pieces"), F.bool_and("whole").alias("whole"))
    small = seated[0]
    for more in seated[1:]:
        small = small.unionByName(more)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS))
    piece = F.try_element_at(F.filter("pieces", lambda p: p["upto"] > part), F.lit(1))["at"]
    marked = hashed.join(F.broadcast(split), "link", "left")
    # rows that look for no small hub are spread by their id
    own = F.col("pieces").isNull() & F.col("link").isNotNull()
    marked = marked.withColumn("_link", F.when(own, F.col("link"))).withColumn("_key", F.when(own, F.xxhash64("link")).otherwise(F.xxhash64("doc_id")))
    marked = marked.join(small.select(F.col("link").alias("_link"), F.xxhash64("link").alias("_key"), "goal"), ["_key", "_link"], "left")
    keep = F.when(F.col("goal").isNotNull() | F.col("whole"), 0).when(F.col("whole").isNotNull(), 1).otherwise(2)
    return marked.withColumn("keep", keep).withColumn("shard", F.coalesce("goal", piece, "shard").cast("int")).select(*hashed.columns, "keep")


def _even_out(current: DataFrame, total: int, shards: int, buckets: int) -> DataFrame:
    bucket = (F.col("keep") * buckets + F.pmod(F.xxhash64("doc_id", "link"), F.lit(buckets))).cast("int")
    dealt = current.withColumn("bucket", bucket)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    here = {r["shard"]: r["n"] for r in offsets.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a number for each shard
    here = [here.get(s, 0) for s in range(shards)]
    extra = set(sorted(range(shards), key=lambda s: (-here[s], s))[: total % shards])
    goal = [total // shards + (s in extra) for s in range(shards)]
    surplus, gaps = [0], [0]
    for s in range(shards):
        surplus.append(surplus[-1] + max(0, here[s] - goal[s]))
        gaps.append(gaps[-1] + max(0, goal[s] - here[s]))
    of = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)
    order = [c for c in ("link", "doc_id", "size", "text_crc32") if c in current.columns]
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order))
    placed = dealt.withColumn("_rank", rank).join(offsets.select("shard", "bucket", "offset"), ["shard", "bucket"])
    placed = placed.withColumn("_at", F.col("offset") + F.col("_rank") - 1)
    over = F.col("_at") - of(goal, F.col("shard"))
    placed = placed.withColumn("_k", F.when(over >= 0, of(surplus[:-1], F.col("shard")) + over))
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in gaps[:-1]]), lambda g: g <= F.col("_k"))) - 1
    # gaps before a shard without gap equal those of the next one, so the last match is the shard itself
    placed = placed.withColumn("_to", F.when(F.col("_k").isNotNull(), to))
    slot = F.when(F.col("_to").isNull(), F.col("_at")).otherwise(of(here, F.col("_to")) + F.col("_k") - of(gaps[:-1], F.col("_to")))
    out = placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.coalesce("_to", "shard").cast("int"))
    return out.drop("bucket", "offset", "_rank", "_at", "_k", "_to")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: links, cut of placed(link, shard): pairs of rows with equal link, and those of them in two shards.

    Counted from sizes of groups, so no pairs are made; null links link nothing.
    """
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    held = placed.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n"))
    each = held.groupBy("link").agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("inside"))
    return each.agg(F.coalesce(F.sum(pairs("n")), F.lit(0)).alias("links"), F.coalesce(F.sum(pairs("n") - F.col("inside")), F.lit(0)).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: counts at most one apart.  Null text counts as empty, and empty texts are
    equal texts; grown_shard is null under this law.
    """
    body = text_or_empty("text")
    rows = docs.select("doc_id", text_size().alias("size"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("link"))
    return assign(cut(rows, "rows"), shards, rounds).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
