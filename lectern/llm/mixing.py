"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has ``repeat`` times the words of the corpus, shared among the sources
by weight; a source gives at most ``cap`` times its own words and what it cannot
give is shared again among the others.  Words are allotted in equal blocks: each
next block goes to the source with the highest quotient ``target / (2 s + 1)``,
``s`` being the blocks it has.  A source's blocks are then allotted to its shards
of about ``SHARD_ROWS`` documents by the same rule (where there are more than
``FAN`` shards, first to groups of them), and within a shard a seeded affine
permutation of the blocks says which are taken.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window, functions as F

from . import staging

BLOCK = 32
SHARD_ROWS = 1024
#: Shards, or groups of shards, that share one quota at most.
FAN = 1024
#: Copies of a row that are numbered together.
COPIES = 1000
SEED = 20240501
#: Primes above every number of blocks of a shard, drawn between 2**31 and 2**32, for the seeded permutations.
PRIMES = (2427256577, 2821154957, 2859831641, 2903913653, 2993072699, 3244611641, 3946332937, 4058038399)
_SIZE = "regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')"


def targets(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Share ``total`` by weight; no share exceeds ``cap`` times its size."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if weights[i] * level <= cap * sizes[i]]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients ``votes / (2 s + 1)``; ties go to the earlier party.

    A divisor that gives slightly too few seats stands for the bulk of the
    quotients; a heap hands out the rest one at a time.
    """
    if seats <= 0 or not any(v > 0 for v in votes):
        return [0] * len(votes)
    won = lambda d: [math.floor(v / d + 0.5) for v in votes]
    low, high = sum(votes) / (seats + len(votes) + 1), 2 * sum(votes) / seats + 1
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if sum(won(middle)) <= seats else (middle, high)
    have = won(high)
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, have, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(have)):
        _, i = heapq.heappop(heap)
        have[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * have[i] + 1), i))
    return have


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeat: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``size`` counts the runs of non-space characters of the text (null: 0).
    Sources are weighed in the order of their names by code point, null last,
    by ``weights`` again and again.  ``taken`` is how many of the document's
    words the mix takes, repeats counted: at most ``ceil(cap)`` passes over a
    block, so at most ``cap`` times its size for a whole ``cap``.  Equal inputs
    give equal results: the order of a shard comes from hashes of doc_id and
    text, never from file order.  An empty table gives an empty result, a source
    without words the target 0.  Extra columns are ignored.

    Only one row per source passes the driver; documents never do.
    """
    spark = docs.sparkSession
    own = staging.only(docs, "doc_id", "text", "source").select("doc_id", "source", F.expr(_SIZE).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("rank_"))
    # Rows that repeat id and text are numbered, so that copies spread over the shards as other rows do.
    once = own.groupBy("doc_id", "source", "size", "rank_").agg(F.count(F.lit(1)).alias("n"))
    dealt = once.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition("rank_", "from")
    copy = F.explode(F.expr(f"sequence(from, least(from + {COPIES - 1}, n - 1))"))
    sized = staging.stage(dealt.select("doc_id", "source", "size", "rank_", copy.alias("copy")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], repeat * sum(sizes), cap)
    quotas = sainte_lague(goal, round(sum(goal) / block))
    plan = spark.createDataFrame(
        [(r["source"], int(r["size"]), float(t), int(q), max(1, math.ceil(r["docs"] / SHARD_ROWS))) for r, t, q in zip(found, goal, quotas, strict=True)],
        "source string, source_size long, target double, quota long, shards int",
    )
    named = lambda df: df.withColumn("party", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    dealt = staging.join_bounded(named(sized), named(plan).drop("source"), "party", len(found)).withColumn("shard", F.pmod(F.xxhash64("rank_", "copy"), F.col("shards")).cast("int"))

    parts = dealt.groupBy("party", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("source_size").alias("source_size"))
    shared = _shard_quotas(parts, max([math.ceil(r["docs"] / SHARD_ROWS) for r in found], default=1))
    shared = shared.select("party", "shard", "words", F.least(F.col("won") * block, F.floor(F.col("words") * cap)).cast("long").alias("give"))
    order = Window.partitionBy("party", "shard").orderBy("rank_", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = placed.join(shared, ["party", "shard"]).withColumn("taken", _taken(block, seed))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _shard_quotas(parts: DataFrame, most: int) -> DataFrame:
    """Blocks that each shard wins (party, shard, words, won): its source's, handed down by Sainte-Laguë through groups of ``FAN``.

    ``most`` is the largest number of shards of a source; no window sees more than ``FAN`` of a group.
    """
    levels = 1
    while FAN**levels < most:
        levels += 1
    node = lambda level: F.floor(F.col("shard") / FAN**level)
    above = parts.groupBy("party").agg(F.sum("words").alias("source_size"), F.first("quota").alias("quota")).withColumn("parent", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        mine = parts.groupBy("party", node(level + 1).alias("parent"), node(level).alias("shard")).agg(F.sum("words").alias("words"))
        won = _apportion(mine.join(above, ["party", "parent"]))
        above = won.select("party", F.col("shard").alias("parent"), F.col("words").alias("source_size"), F.col("won").alias("quota"))
    return won.select("party", F.col("shard").cast("int").alias("shard"), "words", "won")


def _apportion(parts: DataFrame) -> DataFrame:
    """Blocks won by each shard of a parent (party, parent): the parent's quota by Sainte-Laguë over the shards' words.

    Rounding at the parent's average divisor leaves a few blocks too many or too
    few; they are the last or next quotients of the shards, found by rank.
    """
    ideal = F.col("words") * F.col("quota") / F.greatest(F.col("source_size"), F.lit(1))
    based = parts.withColumn("base", F.floor(ideal + 0.5))
    short = based.withColumn("short", F.col("quota") - F.sum("base").over(Window.partitionBy("party", "parent")))
    turns = short.withColumn("step", F.explode(F.expr("case when short = 0 then array(0) when short > 0 then array(0, 1, 2) else array(0, -1, -2) end")))
    # step s > 0 asks for one more block than base + s - 1; step s < 0 gives back block base + s + 1.
    quotient = F.col("words") / (2 * (F.col("base") + F.when(F.col("step") > 0, F.col("step") - 1).otherwise(F.col("step"))) + 1)
    ranked = turns.where("step = 0 or step > 0 or base + step >= 0").withColumn("quotient", quotient).withColumn(
        "nth", F.row_number().over(Window.partitionBy("party", "parent", F.signum("step")).orderBy(F.when(F.col("step") < 0, F.col("quotient")).otherwise(-F.col("quotient")), "shard", F.abs("step")))
    )
    moved = F.sum(F.when((F.col("step") != 0) & (F.col("nth") <= F.abs("short")), F.signum("step")).otherwise(0.0))
    return ranked.groupBy("party", "parent", "shard").agg(F.first("words").alias("words"), (F.first("base") + moved).cast("long").alias("won"))


def _taken(block: int, seed: int) -> F.Column:
    """Words taken from a document at [begin, begin + size) of its shard's stream.

    ``give`` words are whole passes over the shard, then the blocks of lowest
    seeded rank, the last of them cut so that the shard gives exactly ``give``.
    Rank of block j of n: (p j + c) mod n, a permutation, for a seeded prime p
    above n that is neither 1 nor -1 modulo n where there is one; only the stream's
    last block is shorter than the others.
    """
    turn = f"int(pmod(xxhash64(party, shard, {seed + 1}), {len(PRIMES)}))"
    primes = f"array({', '.join(f'{p}L' for p in PRIMES)})"
    blocks = f"((words + {block - 1}) div {block})"
    start = f"pmod(xxhash64(party, shard, {seed}), {blocks})"
    turned = f"concat(slice({primes}, 1 + {turn}, {len(PRIMES)}), slice({primes}, 1, {turn}))"
    factor = f"coalesce(filter({turned}, p -> pmod(p, {blocks}) not in (1, {blocks} - 1))[0], {primes}[0])"
    rank = f"pmod(j * p + {start}, {blocks})"
    missing = f"({blocks} * {block} - words)"
    before = f"({rank} * {block} - if({rank} > pmod(({blocks} - 1) * p + {start}, {blocks}), {missing}, 0L))"
    got = f"least(greatest(give % words - {before}, 0L), {block}L, words - j * {block})"
    walk = f"""aggregate(sequence(begin div {block}, (begin + size - 1) div {block}), 0L,
      (sum, j) -> sum + greatest(0L, least(begin + size, j * {block} + {got}) - greatest(begin, j * {block})))"""
    return F.expr(f"case when size = 0 or give = 0 then 0L else size * (give div words) + transform(array({factor}), p -> {walk})[0] end")
