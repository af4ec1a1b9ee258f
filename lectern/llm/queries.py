"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train, training_part

    docs = _table(spark, sf_dir, "documents")
    return identify(docs.withColumn("held_out", training_part()), train(docs), ["doc_id", "held_out"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import staging, warc

    return warc.round_trip(_table(spark, sf_dir, "pages"), staging.new_path(spark, "warc"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotrain import classify, train
    from .langid import training_part

    docs = _table(spark, sf_dir, "documents")
    return classify(docs.withColumn("held_out", training_part()), train(docs, _table(spark, sf_dir, "labels")), ["doc_id", "held_out"])


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .images import copies, page_pictures

    return copies(page_pictures(_table(spark, sf_dir, "pages")), "page_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("node")


#: Folder of the public vocabulary files; TOKENIZER_DIR sets another.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import score

    return score(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bwt_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    told = encode(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import rearrange, restored

    made = rearrange(_table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, flags

    return audit(flags(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), list("ABCDE"), ["good", "toxic"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
with d as (select doc_id, {WORDS_SQL} w from documents),
b as (select coalesce(cast(item_id as varchar), '') item_id, {WORDS_SQL} w from benchmark),
win as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') s
        from b, unnest(generate_series(1, greatest(len(w) - 12, 1))) t(i) where len(w) > 0),
ns as (select distinct n from win),
pos as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') s from d, ns, unnest(generate_series(1, len(w) - n + 1)) t(i) where len(w) >= n),
hit as (select doc_id, i, pos.n, item_id from pos join win on pos.n = win.n and pos.s = win.s),
cov as (select doc_id, count(distinct j) n_hit from hit, unnest(generate_series(i, i + n - 1)) t(j) group by doc_id),
ids as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) items_sha256 from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cov on d.doc_id = cov.doc_id left join ids on d.doc_id = ids.doc_id"""


OP3_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) x from pages),
first as (select x, min(page_id) least from p group by x)
select page_id, cast(n as bigint) payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, (k // 8) * 10 + 1, 10) as ubigint) >> (35 - 5 * (k % 8))) & 31 as int) + 1, 1)), '') payload_digest,
       case when page_id is not distinct from least then 'response' else 'revisit' end record_type,
       case when page_id is distinct from least then least end refers_to
from p join first using (x)"""


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) x from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w,
      list_transform(range(4), lambda k: cast('0x' || substr(x, 8 * k + 1, 8) as ubigint)) h from d),
c as (select doc_id, t, w, len(w) n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end form from u),
s as (select doc_id, t, n, form, array_to_string(w[1:a], '') p, array_to_string(w[a + 1:b], '') m, array_to_string(w[b + 1:], '') s from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from s"""


OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
least as (select t, min(doc_id) first from d group by t),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
f as (select part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > first, false)} v, coalesce(good, false) good, coalesce(toxic, false) toxic
      from d join least using (t) left join l on d.doc_id = l.doc_id),
g as (select part, good, toxic, count(*) c, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then v.A when 'B' then v.B when 'C' then v.C when 'D' then v.D else v.E end) failed
      from f group by part, good, toxic, failed),
x(x) as (select unnest(['A', 'B', 'C', 'D', 'E'])),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select part, filter_order, step, substr(filter_order, step, 1) f, c, good, toxic, failed, list_has(failed, substr(filter_order, step, 1)) fails,
             len(list_filter(failed, lambda y: instr(filter_order, y) < step)) > 0 gone from g, o, (select unnest(range(1, 6)) step)),
r as (select part, filter_order, step, f, coalesce(sum(c) filter (not gone and not fails), 0) kept, coalesce(sum(c) filter (not gone and fails), 0) removed, coalesce(sum(c) filter (gone and fails), 0) redundant,
             coalesce(sum(c) filter (fails and len(failed) = 1), 0) unique_fails, coalesce(sum(c) filter (not gone and fails and good), 0) good_lost, coalesce(sum(c) filter (not gone and fails and toxic), 0) toxic_lost
      from s group by all)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
       cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) shapley
from r"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op2_decontaminate": OP2_SQL, "op3_warc": OP3_SQL, "op12_fill_in_middle": OP12_SQL, "op13_filter_audit": OP13_SQL}
