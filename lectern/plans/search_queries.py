"""Queries of the index and the search, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import text as T
from lectern.operators import index, search as S
from lectern.operators.joins import numbered
from lectern.sources.corpus import document_verses, units
from lectern.sources.stored import once

from .registry import query, table

#: Terms of the registered searches, frequent and rare.
ONE, TWO, PHRASE, VOLUMES, ABSENT = "tion", "the and", "of the", ("en", "fr"), "the zzyzx"

LINES = "verses as (select lang volume_id, source book, doc_id unit, i verse, parts[i] as text from (select lang, source, doc_id, string_split(text, chr(10)) parts from documents where text is not null) d, unnest(generate_series(1, len(parts))) t(i))"
TOKENS = LINES + ", tok as (select volume_id, book, unit, verse, unnest(regexp_extract_all(regexp_replace(lower(text), '[''’]', '', 'g'), '[a-z]+')) word from verses)"


def _stem_sql(source: str = "select distinct word from tok") -> str:
    """CTEs st0..: ``stemmed(word, stem)`` of the distinct words."""
    out = f"st0 as (select word, word w from ({source}) q)"
    for n, step in enumerate(T.stem_steps()):
        out += f", st{n + 1} as (select word, case when length(word) < 3 then w else {step.replace('RLIKE(', 'regexp_matches(')} end w from st{n})"
    return out + f", stemmed as (select word, w stem from st{len(T.stem_steps())})"


STEMS = TOKENS + ", " + _stem_sql()
POSTS = STEMS + ", post as (select stem, unit, list(verse order by verse) vs from tok join stemmed using (word) group by stem, unit)"


def _verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_verses(table(spark, sf_dir, "documents"))


@query(f"with {TOKENS} select word, count(*) cnt from tok group by word")
def word_freq(spark, sf_dir):
    return index.vocabulary(_verses(spark, sf_dir)).select("word", "cnt")


@query(f"with {TOKENS}, c as (select word, count(*) cnt, substr(word, 1, 1) letter from tok group by word) select letter, word, cnt, row_number() over (partition by letter order by cnt desc, word) nth from c")
def vocab_by_letter(spark, sf_dir):
    """The whole vocabulary of each letter, most frequent first."""
    vocab = index.read_vocabulary(spark, _index(spark, sf_dir))
    every = numbered(vocab.withColumn("less", -F.col("cnt")), ["letter", "less", "word"], "n")
    first = every.groupBy("letter").agg(F.min("n").alias("first"))  # one row a letter
    return every.join(F.broadcast(first), "letter").select("letter", "word", "cnt", (F.col("n") - F.col("first") + 1).cast("int").alias("nth"))


@query(f"with {LINES}, u as (select volume_id, book, unit, count(*) verse_count from verses group by all) select *, row_number() over (order by volume_id, book, unit) - 1 unit_no from u")
def unit_numbering(spark, sf_dir):
    return units(_verses(spark, sf_dir))


@query(f"with {STEMS} select * from stemmed")
def stems(spark, sf_dir):
    return index.stems(_verses(spark, sf_dir))


@query(f"with {POSTS} select stem, unit, array_to_string(vs, ' ') verses from post")
def stem_postings(spark, sf_dir):
    return index.postings(_verses(spark, sf_dir)).select("stem", "unit", F.array_join(F.transform("verses", lambda v: v.cast("string")), " ").alias("verses"))


@query(f"with {POSTS}, d as (select stem, unit, unit - lag(unit, 1, 0) over (partition by stem order by unit) step, len(vs) n from post) select stem, unit, cast(step as bigint) step, cast(n as int) n from d")
def posting_deltas(spark, sf_dir):
    """Steps between a stem's units, read back from the encoded strings."""
    return index.steps(index.encoded(index.postings(_verses(spark, sf_dir))))


@query(f"with {POSTS} select stem, unit, array_to_string(vs, ' ') verses from post")
def posting_roundtrip(spark, sf_dir):
    back = index.decoded(index.encoded(index.postings(_verses(spark, sf_dir))))
    return back.select("stem", F.col("unit").cast("long").alias("unit"), F.array_join(F.transform("verses", lambda v: v.cast("string")), " ").alias("verses"))


@query(f"with {POSTS} select rpad(substr(stem, 1, 2), 2, '_') shard, count(distinct stem) stems, count(*) postings, sum(len(vs)) occurrences from post group by 1 order by postings desc, shard limit 20")
def shard_sizes(spark, sf_dir):
    post = index.postings(_verses(spark, sf_dir)).withColumn("shard", T.shard_key(F.col("stem"), F.lit(2)))
    sizes = post.groupBy("shard").agg(F.count_distinct("stem").alias("stems"), F.count(F.lit(1)).alias("postings"), F.sum(F.size("verses")).alias("occurrences"))
    return sizes.orderBy(F.desc("postings"), "shard").limit(20)


#: Digits of a number in base 36.
_DIGITS = "case when {0} < 36 then 1 when {0} < 1296 then 2 when {0} < 46656 then 3 when {0} < 1679616 then 4 else 5 end"
_LIMIT = 2048


@query(f"""with {POSTS}, b as (select *, unit // {index.BLOCK} block from post), d as (select stem, block, vs, unit - coalesce(lag(unit) over (partition by stem, block order by unit), block * {index.BLOCK}) step from b),
e as (select stem, block, sum({_DIGITS.format('step')} + 1 + list_sum(list_transform(vs, lambda v: {_DIGITS.format('v')})) + len(vs) - 1) + count(*) - 1 n from d group by all)
select rpad(substr(stem, 1, 2), 2, '_') prefix, cast(sum(n + length(stem)) as bigint) size from e group by 1 having size > {_LIMIT}""")
def deep_prefixes(spark, sf_dir):
    """Prefixes whose encoded postings are long, at a limit that the small tables reach."""
    strings = index.encoded(index.postings(_verses(spark, sf_dir)))
    return index.deep_prefixes(strings, _LIMIT).select("prefix", F.col("size").cast("long").alias("size"))


def _search_sql(query_: str, extra: str = "", order: str = "score desc, unit", size: int | None = 25) -> str:
    terms = ", ".join(f"('{w}')" for w in dict.fromkeys(query_.split()))
    return f"""with {TOKENS}, qw(word) as (values {terms}), {_stem_sql('select distinct word from tok union select word from qw')},
q as (select distinct stem from qw join stemmed using (word)),
h as (select volume_id, unit, verse, count(*) n, list(distinct stem) s from tok join stemmed using (word) join q using (stem) group by all),
u as (select volume_id, unit, sum(n) hits, len(list_distinct(flatten(list(s)))) k, list(verse order by verse) vs, count(*) filter (len(s) = (select count(*) from q)) shared, min(verse) filter (len(s) = (select count(*) from q)) first_shared from h group by all),
z as (select volume_id, book, unit, count(*) verse_count from verses group by all)
select volume_id, book, unit, cast(hits as bigint) hits, verse_count, cast(shared as int) shared, array_to_string(vs, ' ') verses,
coalesce(first_shared, vs[1]) first_verse, round(hits / sqrt(verse_count) * (case when (select count(*) from q) > 1 then 1 + shared else 1 end), 6) score
from u join z using (volume_id, unit) where k = (select count(*) from q) {extra} order by {order} {f'limit {size}' if size else ''}"""


def _index(spark: SparkSession, sf_dir: str) -> str:
    """The stored index of a folder's documents, written at the first search in it."""
    return once(spark, f"index of {sf_dir}", f"{sf_dir}/documents.parquet", lambda path: index.write_index(_verses(spark, sf_dir), path))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("verses", F.array_join(F.transform("verses", lambda v: v.cast("string")), " "))


@query(_search_sql(ONE, size=None))
def search_one(spark, sf_dir):
    return _flat(S.search(spark, _index(spark, sf_dir), ONE))


@query(_search_sql(TWO))
def search_and(spark, sf_dir):
    return _flat(S.ranked(S.search(spark, _index(spark, sf_dir), TWO)))


@query(_search_sql(TWO, "and volume_id in ('en', 'fr')"))
def search_volume_filter(spark, sf_dir):
    return _flat(S.ranked(S.search(spark, _index(spark, sf_dir), TWO, VOLUMES)))


@query(_search_sql(TWO, order="unit"))
def search_scripture_order(spark, sf_dir):
    return _flat(S.search(spark, _index(spark, sf_dir), TWO).orderBy("unit").limit(25))


@query(f"with {STEMS} select 'zzyzx' word, 'zzyzx' stem where not exists (select 1 from tok where word = 'zzyzx')")
def search_missing(spark, sf_dir):
    return S.missing(spark, _index(spark, sf_dir), ABSENT)


@query(f"""with {STEMS}, w as (select unit, verse, regexp_extract_all(regexp_replace(lower(text), '[''’]', '', 'g'), '[a-z]+') ws from verses),
p as (select unit, verse, nth, stem from (select unit, verse, unnest(ws) word, unnest(generate_series(1, len(ws))) nth from w) q join stemmed using (word))
select a.unit, count(distinct a.verse) hits from p a join p b on a.unit = b.unit and a.verse = b.verse and b.nth = a.nth + 1 where a.stem = 'of' and b.stem = 'the' group by a.unit""")
def search_phrase(spark, sf_dir):
    """Units with the phrase."""
    return S.search(spark, _index(spark, sf_dir), PHRASE, phrase=True).select("unit", "hits")


@query(f"with r as ({_search_sql(TWO, size=None)}) select volume_id, count(*) n_units, cast(sum(len(string_split(verses, ' '))) as bigint) found from r group by volume_id")
def search_totals(spark, sf_dir):
    return S.search(spark, _index(spark, sf_dir), TWO).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.size("verses")).alias("found"))


@query()
def snippets(spark, sf_dir):
    """The best page of results with the snippet of the first verse that holds all terms."""
    path = _index(spark, sf_dir)
    best = S.ranked(S.search(spark, path, TWO)).select("unit", "score", F.col("first_verse").alias("verse"))
    texts = _verses(spark, sf_dir).select("unit", "verse", "text").join(F.broadcast(best), ["unit", "verse"])  # one page of rows
    return S.snippets(texts, path, TWO).withColumn("runs", F.to_json("runs"))


@query(f"with {TOKENS} select word, count(*) cnt from tok where word like 'th_%' group by word order by cnt desc, word limit 5")
def completions(spark, sf_dir):
    return S.completions(index.read_vocabulary(spark, _index(spark, sf_dir)), "th")


@query(f"""with {TOKENS}, v as (select word, count(*) cnt from tok where word like 'h%' and word <> 'hte' group by word), d as (select word, cnt, damerau_levenshtein(word, 'hte') distance from v where abs(length(word) - 3) <= 1)
select 'hte' asked, word, cnt, cast(distance as int) distance from d where distance <= 1 and not exists (select 1 from tok where word = 'hte') order by distance, cnt desc, word limit 3""")
def did_you_mean(spark, sf_dir):
    """Words near the terms of a query that the corpus lacks; within one edit the two distances are the same."""
    near = [f.select(F.lit(word).alias("asked"), "word", "cnt", "distance") for word, f in S.did_you_mean(spark, _index(spark, sf_dir), "the hte")]
    none = spark.createDataFrame([], "asked string, word string, cnt long, distance int")
    return reduce(lambda a, b: a.unionByName(b), near, none)


@query(f"with {LINES} select unit, cast(sum((length(f) - length(replace(f, 'the', ''))) // 3) as bigint) n from (select unit, replace(lower(text), '’', '''') f from verses) q group by unit having n > 0")
def find_count(spark, sf_dir):
    return _verses(spark, sf_dir).groupBy("unit").agg(F.sum(T.find_count(F.col("text"), "The")).alias("n")).where("n > 0")


@query(f"with {LINES}, p as (select *, lag(text) over (partition by unit order by verse) prev from verses), a as (select unit, verse, w, count(*) n from (select unit, verse, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from p) q group by all), pa as (select a.unit, a.verse, sum(least(a.n, b.n)) c from a join a b on a.unit = b.unit and b.verse = a.verse - 1 and a.w = b.w group by all), z as (select unit, verse, len(regexp_extract_all(lower(text), '[a-z]+')) k, len(regexp_extract_all(lower(prev), '[a-z]+')) j from p where prev is not null) select unit, verse, round(case when k + j > 0 then 2.0 * coalesce(c, 0) / (k + j) else 0.0 end, 6) similarity from z left join pa using (unit, verse)")
def bag_similarity(spark, sf_dir):
    from lectern.operators.align import bag_similarity as similarity

    verses = _verses(spark, sf_dir).select("unit", "verse", "text")
    before = verses.select("unit", (F.col("verse") + 1).alias("verse"), F.col("text").alias("other"))
    return similarity(verses.join(before, ["unit", "verse"]), ["unit", "verse"], "text", "other")
