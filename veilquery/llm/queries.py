"""The queries of the training-data operators, one per operator, and their plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.llm import decontamination, embedding_dedup, html_extract, jaccard_join, line_dedup, packing, secret_scan, substring_dedup, toxicity, warc

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = secret_scan.vocabulary_words(*(public_tokenizers.path(f"byte_bpe_{name}.tiktoken") for name in ("50k", "multi_50k")))
    return secret_scan.scan(_table(spark, sf_dir, "documents"), words=words)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_boilerplate(docs).select(
        "doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
with l as (
  select doc_id, source, i, string_split(text, chr(10))[i] as line
  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text <> '')
), b as (
  select trim(line, ' ' || chr(9)) as line from l where trim(line, ' ' || chr(9)) <> ''
  group by 1 having count(distinct coalesce(source, '')) >= 8
), k as (
  select l.*, b.line is not null as gone from l left join b on trim(l.line, ' ' || chr(9)) = b.line
), g as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
    coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept
  from k group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join g using (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as key
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from dw where len(w) >= 50)
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p
  from (select *, min(doc_id) over (partition by key) as least from win) where least < doc_id
), words as (
  select d.doc_id, d.i, d.w[d.i] as word, gone.p is not null as removed
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from dw where len(w) > 0) d
  left join gone on gone.doc_id = d.doc_id and gone.p = d.i
), g as (
  select doc_id, count(*) filter (removed) as n_removed, string_agg(word, ' ' order by i) filter (not removed) as kept
  from words group by doc_id
)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from dw left join g using (doc_id)
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive u as (
  select vec_id, label, embedding::double[] as e from embeddings where label is not null
), link as (
  select x.vec_id as a, y.vec_id as b from u x join u y
  on x.label = y.label and x.vec_id <> y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select reach.a, link.b from reach join link on reach.b = link.a
), n as (
  select a, count(*) as n_links from link group by a
)
select vec_id, coalesce(n_links, 0) as n_links, c as component_id, vec_id = c as kept
from embeddings left join n on n.a = vec_id join (select a, min(b) as c from reach group by a) r on r.a = vec_id
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), size=4, share=85)


OP6_SQL = rf"""
with recursive dw as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), sh as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from dw where len(w) > 0)
), n as (
  select doc_id, count(*) as n from sh group by doc_id
), link as (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as common from sh x join sh y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2
  ) join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 85 * (na.n + nb.n - common)
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, link.b from reach join link on reach.b = link.a
)
select d.doc_id, coalesce(n, 0) as n_shingles, least_id as component_id
from documents d left join n using (doc_id) join (select a, min(b) as least_id from reach group by a) on a = d.doc_id
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = rf"""
with dw as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct item_id, least(10, len(w)) as m, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') as key
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as j from bw where len(w) > 0)
), pos as (
  select doc_id, w, unnest(range(1, len(w) + 1)) as i from dw
), hit as (
  select doc_id, i, m, item_id from (
    select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as key
    from pos, (select distinct m from win) where i + m - 1 <= len(w)
  ) join win using (m, key)
), covered as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id
), found as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from hit) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join found using (doc_id)
"""

def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages
), t as (
  select *, case when n >= 1000 then max(page_id) over (partition by d, n) else page_id end as target from p
)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when target = page_id then 'response' else 'revisit' end as record_type,
  case when target <> page_id then target end as refers_to
from t
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op8_decontamination": OP8_SQL,
    "op9_warc": OP9_SQL}
