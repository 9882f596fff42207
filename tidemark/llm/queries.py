"""The queries of the training-data operators: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, license_scan, line_dedup, near_join, packing, quality, sharding, topk, warc

Query = Callable[[SparkSession, str], DataFrame]

#: Place of the byte-level BPE file on every executor; a parameter of the packing operator.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), long_ratio=line_dedup.LONG_RATIO, spare=False)
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases; the proximity matches of the same operator are a query of their own."""
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=0))


def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a window near which a document's words lie: doc_id, n_near_items, near_items (comma-joined)."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("near_items").cast("long").alias("n_near_items"), F.array_join("near_items", ",").alias("near_items"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), sharding.shard_names(sharding.SHARDS))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare their language in `lang` and come from `source`; pages in markup and address. Each row carries the
    doc_id of a document."""
    return langid.of_documents(table(spark, sf_dir, "documents"))


def op7_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return langid.identify(pages, id_col="page_id", text=langid.html_text(F.col("html")), declared=langid.html_lang(F.col("html")), url=F.col("url"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` keep no headers, so the records have none."""
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_topk, op2_license_scan, op3_line_dedup, op4_quality, op5_decontaminate, op5_proximity, op6_sharding, op7_language, op7_language_pages, op8_warc, op9_packing, op10_near_join,
    )
    return {f.__name__: f for f in found}


#: Exact top-k over `embeddings` by plain comparison of every query with every row.
TOPK_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)::bigint) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (select vec_id, unnest(range(1, len(e) + 1)) as i, unnest(e) as x from v),
scores as (select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score from cells q join cells c on q.i = c.i and q.vec_id <> c.vec_id
           where q.vec_id % {topk.EVERY} = 0 group by q.vec_id, c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= {topk.K}
"""

#: Windows of test items, and documents' runs of as many words; equal ones meet by their MD5.
DECONTAMINATE_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null and item_id is not null),
windows as (select distinct item_id, least(len(w), {decontaminate.WINDOW}) as n, md5(array_to_string(w[i : i + least(len(w), {decontaminate.WINDOW}) - 1], ' ')) as h
            from (select item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)),
grams as (select r, i, n, md5(array_to_string(w[i : i + n - 1], ' ')) as h from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) where len(w) >= n)),
found as (select r, i, g.n, item_id from grams g join windows using (n, h)),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) group by r),
items as (select r, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct r, cast(item_id as varchar) as k from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join items using (r)
"""


#: Classes of equal shingle sets, their exact links by counting shared shingles, and components by spreading the least id.
NEAR_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
g as materialized (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {near_join.SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {near_join.SHINGLE - 1}], ' ')))) as g from w where len(w) > 0),
k as materialized (select doc_id, g, md5(array_to_string(g, '|')) as d from g),
classes as materialized (select d, any_value(g) as g, min(doc_id) as rep, count(*) as copies, len(any_value(g)) as n from k group by d),
cells as materialized (select d, n, unnest(g) as x from classes),
edges as materialized (select a.d as a, b.d as b from cells a join cells b on a.x = b.x and a.d <> b.d and least(a.n, b.n) >= {near_join.THRESHOLD} * greatest(a.n, b.n) - 1e-9
  group by a.d, b.d having count(*) * (1 + {near_join.THRESHOLD}) >= {near_join.THRESHOLD} * (any_value(a.n) + any_value(b.n)) - 1e-6),
reach(d, root) as (select d, rep from classes union select e.b, r.root from reach r join edges e on e.a = r.d),
roots as (select d, min(root) as class_id from reach group by d),
links as (select a as d, count(*) as classes, sum(copies) as docs from edges join classes c on c.d = b group by a)
select k.doc_id, c.rep as copy_id, c.copies as n_copies, cast(coalesce(l.docs, 0) + c.copies - 1 as bigint) as n_links, coalesce(l.classes, 0)::bigint as n_class_links, r.class_id
from k join classes c using (d) join roots r using (d) left join links l using (d)
union all select doc_id, doc_id, 1, 0, 0, doc_id from w where len(w) = 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": TOPK_SQL, "op2_license_scan": license_scan.oracle_sql(), "op3_line_dedup": line_dedup.ORACLE_SQL, "op5_decontaminate": DECONTAMINATE_SQL, "op10_near_join": NEAR_SQL,
    }
