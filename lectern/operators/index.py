"""The inverted index: postings, vocabulary, shards and their codec; written in segments, published as versions.

An index is a folder of segments.  A segment is never changed once written; a
version names the segments that make the index.  Units are numbered by bigints
in the order in which they were indexed, whatever their own ids are, and a unit
that changes gets a new number.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.functions.text import shard_key, with_stem, words
from lectern.sources.stored import delete, exists, folder_of, staged

from .joins import BROADCAST_ROWS, numbered

# Fixed value: characters of a two-letter shard beyond which it is split by three letters.
DEEP = 96 * 1024
#: Units whose postings of a stem stand in one string; a frequent stem has many.
BLOCK = 4096
#: A word with more than this share of all words is frequent: of these there are as many at most, so that they can be broadcast.
FREQUENT = 1 << 16
#: Segments beyond which an update writes all into one, and versions that are kept for readers that began before.
SEGMENTS, VERSIONS = 8, 2
KEY = ["volume_id", "book", "unit"]
#: Of tables whose folders are parts, which an empty one has none of.
VOCABULARY, POSTINGS = "word string, own long, cnt long, stem string, letter string", "stem string, block long, encoded string, shard string"


def tokens(verses: DataFrame) -> DataFrame:
    """One row per word of a verse."""
    return verses.select("volume_id", "unit", "verse", F.explode(words(F.col("text"))).alias("word"))


def vocabulary(verses: DataFrame) -> DataFrame:
    """Words with count and first letter."""
    return tokens(verses).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).withColumn("letter", F.substring("word", 1, 1))


def stems(verses: DataFrame) -> DataFrame:
    """Each distinct word with its stem: words are stemmed once, however often they stand."""
    return with_stem(tokens(verses).select("word").distinct())


def with_stems(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows with a ``word`` and its ``stem``, from a vocabulary (word, cnt, stem).

    A small vocabulary is broadcast whole.  Of a large one the frequent words
    are, as many as ``FREQUENT`` at most by what frequent means; the others,
    none of which holds more than that share of the rows, are shuffled.
    """
    if vocab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(vocab.select("word", "stem")), "word")
    total = vocab.agg(F.sum("cnt")).first()[0]
    frequent = vocab.where(F.col("cnt") * FREQUENT > total).select("word", F.col("stem").alias("frequent"))
    told = rows.join(F.broadcast(frequent), "word", "left")
    rare = told.where("frequent is null").drop("frequent").join(vocab.where(F.col("cnt") * FREQUENT <= total).select("word", "stem"), "word")
    return told.where("frequent is not null").withColumnRenamed("frequent", "stem").unionByName(rare)


def postings(verses: DataFrame) -> DataFrame:
    """stem, unit, verses: a verse is listed once for each occurrence."""
    own = tokens(verses)
    vocab = staged(with_stem(own.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))), "vocabulary")
    return _by_block(with_stems(own.select("unit", "verse", "word"), vocab)).groupBy("stem", "block", "unit").agg(F.sort_array(F.collect_list("verse")).alias("verses")).drop("block")


def _by_block(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (stem, unit, …) dealt by stem and ``block`` of units, as their strings are: what groups them by units or by blocks shuffles no more."""
    return rows.withColumn("block", F.floor(F.col("unit") / block)).repartition("stem", "block")


def encoded(post: DataFrame, block: int = BLOCK) -> DataFrame:
    """A string for each stem and block of units: units as base-36 steps from the one before (the first from the block's start), each with its verses in base 36."""
    b36 = lambda c: F.lower(F.conv(c.cast("string"), 10, 36))
    own = post if "block" in post.columns else post.withColumn("block", F.floor(F.col("unit") / block))
    step = F.col("unit") - F.coalesce(F.lag("unit").over(Window.partitionBy("stem", "block").orderBy("unit")), F.col("block") * block)
    piece = F.concat(b36(step), F.lit(":"), F.array_join(F.transform("verses", b36), "."))
    listed = own.withColumn("piece", piece).groupBy("stem", "block").agg(F.sort_array(F.collect_list(F.struct("unit", "piece"))).alias("pieces"))
    return listed.select("stem", "block", F.array_join(F.col("pieces.piece"), ",").alias("encoded"))


def decoded(strings: DataFrame, block: int = BLOCK) -> DataFrame:
    """The postings of encoded strings; units are bigints."""
    parts = strings.select("stem", "block", F.posexplode(F.split("encoded", ",")).alias("at", "piece"))
    back = lambda c: F.conv(c, 36, 10).cast("long")
    unit = F.col("block") * block + F.sum(back(F.substring_index("piece", ":", 1))).over(Window.partitionBy("stem", "block").orderBy("at"))
    return parts.select("stem", unit.cast("long").alias("unit"), F.transform(F.split(F.substring_index("piece", ":", -1), r"\."), lambda v: back(v).cast("int")).alias("verses"))


def steps(strings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of encoded strings each unit's step from the one before, a stem's first from 0: stem, unit, step, n (occurrences).

    Within a block the steps are those encoded; only over a block's first unit
    the blocks' last units, one row a string, meet in a window.
    """
    own = staged(strings, "strings")
    back = lambda c: F.conv(F.substring_index(c, ":", 1), 36, 10).cast("long")
    last = F.col("block") * block + F.aggregate(F.split("encoded", ","), F.lit(0).cast("long"), lambda a, p: a + back(p))
    ends = own.select("stem", "block", last.alias("last"))
    before = ends.select("stem", "block", F.lag("last", 1, 0).over(Window.partitionBy("stem").orderBy("block")).alias("before"))
    parts = own.select("stem", "block", F.posexplode(F.split("encoded", ",")).alias("at", "piece")).withColumn("from", back(F.col("piece")))
    unit = F.col("block") * block + F.sum("from").over(Window.partitionBy("stem", "block").orderBy("at"))
    told = parts.withColumn("unit", unit.cast("long")).join(before, ["stem", "block"])
    n = F.size(F.split(F.substring_index("piece", ":", -1), r"\."))
    return told.select("stem", "unit", F.when(F.col("at") == 0, F.col("unit") - F.col("before")).otherwise(F.col("from")).cast("long").alias("step"), n.alias("n"))


def deep_prefixes(strings: DataFrame, limit: int = DEEP) -> DataFrame:
    """Two-letter prefixes whose encoded postings are longer than ``limit``."""
    return strings.groupBy(F.rpad(F.substring("stem", 1, 2), 2, "_").alias("prefix")).agg(F.sum(F.length("encoded") + F.length("stem")).alias("size")).where(F.col("size") > limit)


def sharded(strings: DataFrame, deep: DataFrame) -> DataFrame:
    """Encoded postings with their shard; ``deep`` prefixes, few and bounded by the letters, are split by three."""
    own = strings.withColumn("prefix", F.rpad(F.substring("stem", 1, 2), 2, "_")).join(F.broadcast(deep.select("prefix", F.lit(3).alias("depth"))), "prefix", "left")
    return own.select("stem", "block", "encoded", shard_key(F.col("stem"), F.coalesce("depth", F.lit(2))).alias("shard"))


# Versions: a small file for each in ``versions``, named by its number, holding the names of its segments.


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, f"{path}/versions"):
        return []
    fs, target = folder_of(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(target) if s.getPath().getName().isdigit())


def segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the segments of the version that is published now, oldest first; none if there is no index."""
    found = _versions(spark, path)
    if not found:
        return []
    return _named(spark, path, found[-1])


def _named(spark: SparkSession, path: str, version: int) -> list[str]:
    return json.loads(spark.read.text(f"{path}/versions/{version:09d}", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, names: list[str]) -> None:
    """Make the named segments the index.

    All that they hold has been written; readers see the version before or this
    one, never a part.  A version's file is created only if there is none, so
    that of two writers one fails.  Older versions than the last ``VERSIONS``
    go, and segments that no version names.
    """
    found = _versions(spark, path)
    number = found[-1] + 1 if found else 1
    fs, target = folder_of(spark, f"{path}/versions/{number:09d}")
    half, whole = folder_of(spark, f"{path}/versions/_{uuid.uuid4().hex}")[1], bytearray(json.dumps(names).encode())
    out = fs.create(half, False)
    out.write(whole, 0, len(whole))
    out.close()
    if fs.exists(target) or not fs.rename(half, target):
        fs.delete(half, True)
        raise RuntimeError(f"another writer has published version {number} of {path}")
    kept = [n for n in (*found, number)][-VERSIONS:]
    used = {s for n in kept for s in _named(spark, path, n)}
    for n in sorted(set(found) - set(kept)):
        old = _named(spark, path, n)
        delete(spark, f"{path}/versions/{n:09d}")
        for s in set(old) - used:
            delete(spark, f"{path}/segments/{s}")


# Segments: forward (the words of each unit, in order of units), vocabulary (counts, below zero for what is gone),
# postings by shard, deep prefixes, units with a digest, texts by block, and the numbers of units that are gone.


def _digest() -> Column:
    """Of a unit's verses in any order: two sums of hashes, and an exclusive or."""
    row = lambda seed: F.xxhash64("verse", "text", F.lit(seed))
    return F.concat_ws(":", F.sum(row(1).cast("decimal(38,0)")), F.bit_xor(row(2)), F.sum(row(3).cast("decimal(38,0)")))


def _units(verses: DataFrame) -> DataFrame:
    return verses.groupBy(*KEY).agg(F.count(F.lit(1)).cast("long").alias("verse_count"), _digest().alias("digest"))


def _same_unit(a: str, b: str) -> Column:
    return F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in KEY))


def _write_segment(verses: DataFrame, fresh: DataFrame, first: int, path: str, limit: int, gone: DataFrame | None = None) -> None:
    """The units ``fresh`` (KEY, verse_count, digest) of ``verses``, numbered from ``first``; ``gone`` (word, cnt) comes off the counts."""
    spark = verses.sparkSession
    order = numbered(fresh, KEY, "nth").withColumn("unit_no", F.col("nth") + first)
    order.select("unit_no", *KEY, "verse_count", "digest").write.parquet(f"{path}/units")
    numbers = spark.read.parquet(f"{path}/units").select("unit_no", *KEY)
    own = verses.select(*KEY, "verse", "text").alias("v").join(numbers.alias("n"), _same_unit("v", "n")).select("n.unit_no", "v.verse", "v.text")
    own.withColumn("block", F.floor(F.col("unit_no") / BLOCK)).repartitionByRange("unit_no").sortWithinPartitions("unit_no", "verse").write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    listed = texts.select("unit_no", "verse", F.explode(words(F.col("text"))).alias("word")).groupBy("unit_no", "word").agg(F.sort_array(F.collect_list("verse")).alias("verses"))
    listed.sortWithinPartitions("unit_no").write.parquet(f"{path}/forward")
    _index_forward(spark, path, limit, gone)


def _index_forward(spark: SparkSession, path: str, limit: int, gone: DataFrame | None = None) -> None:
    """Vocabulary, postings and deep prefixes from a segment's forward table; counts less those of ``gone`` (word, cnt)."""
    forward = spark.read.parquet(f"{path}/forward")
    counts = forward.groupBy("word").agg(F.sum(F.size("verses")).cast("long").alias("own")).withColumn("cnt", F.col("own"))
    if gone is not None:
        less = gone.select("word", F.lit(0).cast("long").alias("own"), (-F.col("cnt")).alias("cnt"))
        counts = counts.unionByName(less).groupBy("word").agg(F.sum("own").alias("own"), F.sum("cnt").alias("cnt"))
    stemmed = with_stem(counts.withColumn("letter", F.substring("word", 1, 1)))
    # A letter's words are spread over tasks by their hash: a frequent letter is no task's alone.
    stemmed.repartition("letter", F.pmod(F.hash("word"), F.lit(16))).sortWithinPartitions(F.desc("cnt"), "word").write.partitionBy("letter").parquet(f"{path}/vocabulary")
    vocab = spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary").where("own > 0").select("word", F.col("own").alias("cnt"), "stem")
    stemmed = _by_block(with_stems(forward, vocab).withColumnRenamed("unit_no", "unit"))
    post = stemmed.groupBy("stem", "block", "unit").agg(F.sort_array(F.flatten(F.collect_list("verses"))).alias("verses"))
    strings = staged(encoded(post), "strings")
    deep_prefixes(strings, limit).select("prefix").write.parquet(f"{path}/deep")
    # A shard's blocks are spread over tasks, so that a frequent stem is no task's alone.
    sharded(strings, spark.read.parquet(f"{path}/deep")).repartition("shard", "block").write.partitionBy("shard").parquet(f"{path}/postings")


def write_index(verses: DataFrame, path: str, limit: int = DEEP) -> None:
    """Write and publish an index of all verses (volume_id, book, unit, verse, text); ids of any type, of units by columns."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    _write_segment(verses, staged(_units(verses), "units"), 0, at, limit)
    verses.sparkSession.createDataFrame([], "unit_no long").write.parquet(f"{at}/removed")
    publish(verses.sparkSession, path, [name])


def update_index(verses: DataFrame, path: str, limit: int = DEEP) -> dict[str, int]:
    """Bring an index up to what ``verses`` are now; returns the units that are new, changed and gone.

    Units are compared by digests.  Only those that are new or changed are read
    into words, and make a segment of their own; what it takes from the counts
    of words comes from the words that the index has stored for the units that
    are gone or changed.  Nothing that is written changes.  Past ``SEGMENTS``
    segments, all become one, without reading any text again.
    """
    spark = verses.sparkSession
    names = segments(spark, path)
    if not names:
        write_index(verses, path, limit)
        return {"new": read_units(spark, path).count(), "changed": 0, "gone": 0}
    now, old = staged(_units(verses), "units").alias("n"), read_units(spark, path).alias("o")
    both = now.join(old, _same_unit("n", "o"), "full")
    state = staged(both.select(*[F.col(f"n.{k}").alias(k) for k in KEY], "n.verse_count", "n.digest", F.col("o.digest").alias("before"), F.col("o.unit_no").alias("unit_no")).where("not (digest <=> before)"), "state")
    counts = state.agg(*[F.count_if(F.expr(e)) for e in ("before is null", "digest is not null and before is not null", "digest is null")]).first()
    told = dict(zip(("new", "changed", "gone"), counts))
    if not any(told.values()):
        return told
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    state.where("before is not null").select("unit_no").write.parquet(f"{at}/removed")
    removed = spark.read.parquet(f"{at}/removed")
    gone = _tables(spark, path, names, "forward").join(removed, "unit_no", "left_semi").groupBy("word").agg(F.sum(F.size("verses")).cast("long").alias("cnt"))
    top = _tables(spark, path, names, "units").agg(F.max("unit_no")).first()[0]
    fresh = state.where("digest is not null").select(*KEY, "verse_count", "digest")
    touched = verses.alias("v").join(fresh.select(*KEY).alias("f"), _same_unit("v", "f"), "left_semi")
    _write_segment(touched, fresh, 0 if top is None else top + 1, at, limit, staged(gone, "gone"))
    names = [*names, name]
    if len(names) > SEGMENTS:
        names = [_merged(spark, path, names, limit)]
    publish(spark, path, names)
    return told


def _tables(spark: SparkSession, path: str, names: list[str], what: str) -> DataFrame:
    """One kind of table of several segments."""
    paths = [f"{path}/segments/{n}/{what}" for n in names]
    if what == "vocabulary":  # whose folders are parts: read one by one
        return reduce(DataFrame.unionByName, [spark.read.schema(VOCABULARY).parquet(p) for p in paths])
    return spark.read.parquet(*paths)


def _merged(spark: SparkSession, path: str, names: list[str], limit: int) -> str:
    """One segment of what is left of several."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    removed = _tables(spark, path, names, "removed")
    for what in ("units", "texts", "forward"):
        left = _tables(spark, path, names, what).join(removed, "unit_no", "left_anti")
        left.repartitionByRange("unit_no").sortWithinPartitions("unit_no").write.parquet(f"{at}/{what}")
    spark.createDataFrame([], "unit_no long").write.parquet(f"{at}/removed")
    _index_forward(spark, at, limit)
    return name


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of the index: unit_no, volume_id, book, unit, verse_count, digest."""
    names = segments(spark, path)
    return _tables(spark, path, names, "units").join(_tables(spark, path, names, "removed"), "unit_no", "left_anti")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Words of the index: word, cnt, stem, letter."""
    names = segments(spark, path)
    every = _tables(spark, path, names, "vocabulary")
    if len(names) > 1:
        every = every.groupBy("word", "stem", "letter").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    return every.select("word", "cnt", "stem", "letter")


def read_texts(spark: SparkSession, path: str, blocks: list[int] | None = None) -> DataFrame:
    """Verses of the index by number: unit_no, verse, text; those of some blocks of units only, if given."""
    every = _tables(spark, path, segments(spark, path), "texts")
    return (every if blocks is None else every.where(F.col("block").isin(blocks))).select("unit_no", "verse", "text")


def read_postings(spark: SparkSession, path: str, found: list[str]) -> DataFrame:
    """Postings of some stems (stem, unit, verses), units by number; only their shards are read, a shard that is absent has no rows."""
    pad = lambda s, n: s[:n].ljust(n, "_")
    names, out = segments(spark, path), None
    for n in names:
        deep = {r["prefix"] for r in spark.read.parquet(f"{path}/segments/{n}/deep").collect()}
        keys = sorted({pad(s, 3 if pad(s, 2) in deep else 2) for s in found})
        own = spark.read.schema(POSTINGS).parquet(f"{path}/segments/{n}/postings").where(F.col("shard").isin(keys) & F.col("stem").isin(found))
        # Blocks of two segments may have one number; each is decoded by itself.
        own = decoded(own)
        out = own if out is None else out.unionByName(own)
    return out if len(names) < 2 else out.join(_tables(spark, path, names, "removed").withColumnRenamed("unit_no", "unit"), "unit", "left_anti").select("stem", "unit", "verses")
