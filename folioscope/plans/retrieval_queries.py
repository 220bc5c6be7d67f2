"""Retrieval over the supplied vectors: every 100th vector asks, all answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.vectors import l2_norm, l2_normalize, max_sim
from folioscope.operators import indexing, retrieval
from folioscope.operators.encoders import HashEncoder, encode_column
from folioscope.session import read_table

TOP = 10


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks; every fourth lies on two pages, so scores tie."""
    v = read_table(spark, sf_dir, "embeddings")
    page = F.expr("vec_id div 4")
    pages = F.when(F.col("vec_id") % 4 == 3, F.array(page, page + 1)).otherwise(F.array(page))
    return v.select(F.format_string("v%08d", "vec_id").alias("chunk_id"), pages.alias("page_ids"), "embedding", "vec_id")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.score_dense(vector_chunks(spark, sf_dir), _asked(spark, sf_dir), decimals=6)


def _pages(how: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks, asked = vector_chunks(spark, sf_dir), _asked(spark, sf_dir)
        pages = retrieval.retrieve(chunks, asked, TOP, how, decimals=6, page_decimals=8)
        return pages.select("query_id", "page_id", "score", "rank")

    query.__name__ = f"dense_topk_pages_{how}"
    return query


def dense_topk_pages_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the others, with pages cut to the first ten of each batch before any shuffle."""
    chunks, asked = vector_chunks(spark, sf_dir), _asked(spark, sf_dir)
    return retrieval.retrieve(chunks, asked, TOP, "max", decimals=6).select("query_id", "page_id", "score", "rank")


def dense_chunk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank_chunks(_scored(spark, sf_dir), TOP).select("query_id", "chunk_id", "score", "rank")


def custom_agg_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.rank_chunks(_scored(spark, sf_dir))
    by_rank = lambda chunks: F.aggregate(chunks, F.lit(0.0), lambda acc, c: acc + c["score"] / c["rank"])
    pages = retrieval.aggregate_pages(ranked, by_rank, decimals=8)
    return retrieval.rank_pages(pages, TOP).select("query_id", "page_id", "score", "rank")


def page_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = vector_chunks(spark, sf_dir), _asked(spark, sf_dir)
    named = retrieval.retrieve(chunks, asked, TOP, "max", decimals=6, contributors=True)
    ids = F.array_join(F.transform("chunks", lambda c: c["chunk_id"]), ",")
    return named.select("query_id", "page_id", "rank", ids.alias("contributors"))


def l2_normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    unit = l2_normalize(F.col("embedding"))
    return v.select("vec_id", F.round(l2_norm(F.col("embedding")), 4).alias("norm"), F.round(unit[0], 5).alias("first_value"), F.round(l2_norm(unit), 6).alias("unit_norm"))


def index_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.index_positions(read_table(spark, sf_dir, "chunks").select("chunk_id").distinct())


def late_precomputed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two models: the guard must tell them apart."""
    model = F.when(F.col("vec_id") % 2 == 0, "first").otherwise("second")
    chunks = vector_chunks(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("embedding_model"), model))
    return indexing.precomputed_state(chunks)


def _matrices(rows: DataFrame) -> DataFrame:
    """Vectors cut into token matrices of a quarter of their width."""
    cut = F.expr("transform(sequence(0, 3), i -> slice(embedding, i * (size(embedding) div 4) + 1, size(embedding) div 4))")
    return rows.withColumn("tokens", cut)


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.score_late(_matrices(vector_chunks(spark, sf_dir)), _matrices(_asked(spark, sf_dir)), decimals=6)


def maxsim_topk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _matrices(vector_chunks(spark, sf_dir)), _matrices(_asked(spark, sf_dir))
    pages = retrieval.retrieve(chunks, asked, TOP, "max", "late_interaction", decimals=6, page_decimals=4)
    return pages.select("query_id", "page_id", "score", "rank")


def maxsim_candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = retrieval.rank_chunks(_late(spark, sf_dir), retrieval.CANDIDATES)
    return cut.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max("rank").alias("last_rank"))


def maxsim_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim by column functions, each vector against its successor."""
    rows = _matrices(vector_chunks(spark, sf_dir)).select("vec_id", "tokens")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("tokens").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(max_sim(F.col("tokens"), F.col("next")), 4).alias("score"))


def hash_encoder_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th query against all chunks, encoded by word hashes."""
    encoder = HashEncoder(128)
    chunks = read_table(spark, sf_dir, "chunks").where("content is not null").select("chunk_id", "page_ids", "content").distinct()
    asked = read_table(spark, sf_dir, "queries").where("query_id % 100 = 0 and text is not null").select("query_id", "text").distinct()
    index = encode_column(chunks, "content", "embedding", encoder, 512)
    asked = encode_column(asked, "text", "embedding", encoder)
    return retrieval.retrieve(index, asked, TOP, "max", decimals=6, page_decimals=5).select("query_id", "page_id", "score", "rank")


_SCORED = """
asked as (select vec_id query_id, cast(embedding as double[]) q from embeddings where vec_id % 100 = 0),
held as (select printf('v%08d', vec_id) chunk_id, vec_id, cast(embedding as double[]) e,
  case when vec_id % 4 = 3 then [vec_id // 4, vec_id // 4 + 1] else [vec_id // 4] end page_ids from embeddings),
scored as (select query_id, chunk_id, page_ids, round(list_cosine_similarity(q, e), 6) score from asked, held),
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from scored)"""
_PAGES = """
select query_id, page_id, score, cast(rank as int) rank from (
  select *, row_number() over (partition by query_id order by score desc, page_id) rank
  from (select query_id, page_id, round({how}, {digits}) score from (select *, unnest(page_ids) page_id from ranked) group by all))
where rank <= 10"""
_LATE = """
asked as (select vec_id query_id, cast(embedding as double[]) q from embeddings where vec_id % 100 = 0),
held as (select printf('v%08d', vec_id) chunk_id, vec_id, cast(embedding as double[]) e,
  case when vec_id % 4 = 3 then [vec_id // 4, vec_id // 4 + 1] else [vec_id // 4] end page_ids from embeddings),
parts as (select query_id, chunk_id, page_ids, i, max(list_inner_product(q[i * (len(q) // 4) + 1 : (i + 1) * (len(q) // 4)],
    e[j * (len(e) // 4) + 1 : (j + 1) * (len(e) // 4)])) best
  from asked, held, range(4) a(i), range(4) b(j) group by all),
scored as (select query_id, chunk_id, page_ids, round(sum(best), 6) score from parts group by all),
ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from scored) where rank <= 500)"""

ORACLES = {
    "dense_topk_pages_max": f"with {_SCORED}" + _PAGES.format(how="max(score)", digits=8),
    "dense_topk_pages_sum": f"with {_SCORED}" + _PAGES.format(how="sum(score)", digits=8),
    "dense_topk_pages_mean": f"with {_SCORED}" + _PAGES.format(how="avg(score)", digits=8),
    "custom_agg_reciprocal_rank": f"with {_SCORED}" + _PAGES.format(how="sum(score / rank)", digits=8),
    "dense_chunk_ranking": f"with {_SCORED} select query_id, chunk_id, score, cast(rank as int) rank from ranked where rank <= 10",
    "page_contributors": f"""with {_SCORED}, pages as ({_PAGES.format(how="max(score)", digits=8)})
select query_id, page_id, p.rank, string_agg(chunk_id, ',' order by r.rank) contributors
from pages p join (select *, unnest(page_ids) page_id from ranked) r using (query_id, page_id) group by all""",
    "l2_normalize_vectors": """
with v as (select vec_id, cast(embedding as double[]) e from embeddings),
n as (select *, sqrt(list_inner_product(e, e)) norm from v)
select vec_id, round(norm, 4) norm, round(e[1] / norm, 5) first_value, 1.0 unit_norm from n""",
    "index_positions": "select row_number() over (order by chunk_id) - 1 index_position, chunk_id from (select distinct chunk_id from chunks)",
    "late_precomputed_guard": """
select count(*) chunks, count(embedding) embedded, count(distinct vec_id % 2) models, 'first' model, count(distinct len(embedding)) widths,
  cast(max(len(embedding)) as int) width from embeddings""",
    "maxsim_topk_pages": f"with {_LATE}" + _PAGES.format(how="max(score)", digits=4),
    "maxsim_candidate_cap": f"with {_LATE} select query_id, count(*) candidates, cast(max(rank) as int) last_rank from ranked group by all",
    "maxsim_columns": """
with t as (select vec_id, cast(embedding as double[]) e, len(embedding) // 4 w from embeddings)
select vec_id, round(sum(best), 4) score from (
  select a.vec_id, i, max(list_inner_product(a.e[i * a.w + 1 : (i + 1) * a.w], b.e[j * b.w + 1 : (j + 1) * b.w])) best
  from t a join t b on b.vec_id = a.vec_id + 1, range(4) x(i), range(4) y(j) group by all) group by all""",
    "hash_encoder_text_search": r"""
with held as (select distinct chunk_id, page_ids, content from chunks where content is not null),
asked as (select distinct query_id, text from queries where query_id % 100 = 0 and text is not null),
slots as (select w, cast(('0x' || substr(md5(w), 1, 8)) as bigint) % 128 slot from (
  select distinct w from (select unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) w from held
    union all select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) from asked))),
c as (select id, slot, count(*) n from (select chunk_id || page_ids::varchar || md5(content) id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) w from held) join slots using (w) group by all),
q as (select query_id, text, slot, count(*) n from (select query_id, text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) w from asked) join slots using (w) group by all),
cn as (select id, sqrt(sum(n * n)) norm from c group by all), qn as (select query_id, text, sqrt(sum(n * n)) norm from q group by all),
dots as (select query_id, text, id, sum(q.n * c.n) d from q join c using (slot) group by all),
scored as (select query_id, id, round(d / qn.norm / cn.norm, 6) score from dots join qn using (query_id, text) join cn using (id)),
pages as (select query_id, page_id, round(max(score), 5) score from scored
  join (select chunk_id || page_ids::varchar || md5(content) id, unnest(page_ids) page_id from held) using (id) group by all)
select query_id, page_id, score, cast(rank as int) rank from (select *, row_number() over (partition by query_id order by score desc, page_id) rank from pages) where rank <= 10""",
}
QUERIES = {
    f.__name__: f
    for f in (
        dense_topk_pages_max, _pages("sum"), _pages("mean"), dense_chunk_ranking, custom_agg_reciprocal_rank, page_contributors,
        l2_normalize_vectors, index_positions, late_precomputed_guard, maxsim_topk_pages, maxsim_candidate_cap,
        maxsim_columns, hash_encoder_text_search,
    )
}
