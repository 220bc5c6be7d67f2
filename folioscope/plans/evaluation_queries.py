"""Evaluation of the supplied run against the supplied judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.identity import qrels_identity as identity_of_qrels
from folioscope.functions.identity import query_set_identity
from folioscope.operators import checks, evaluation, retrieval
from folioscope.session import read_table
from folioscope.sources import subset


def clean_run(spark: SparkSession, sf_dir: str, top_k: int = 100) -> DataFrame:
    """The run without null or NaN scores and repeated pages, ranked anew."""
    rows = read_table(spark, sf_dir, "retrieved_pages").select("query_id", "page_id", "score")
    best = rows.where("score is not null and not isnan(score)").groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    return retrieval.rank_pages(best, top_k)


def _values(spark: SparkSession, sf_dir: str, families=evaluation.FAMILIES) -> DataFrame:
    return evaluation.metric_values(clean_run(spark, sf_dir), read_table(spark, sf_dir, "qrels"), families)


def _family(family: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _values(spark, sf_dir, [family]).select("query_id", "k", F.round("value", 6).alias("value"))

    query.__name__ = f"eval_{family.lower()}"
    return query


def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.per_query(_values(spark, sf_dir))
    cells = F.transform(F.map_entries("metrics"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.4f", e["value"])))
    return rows.select("query_id", F.array_join(cells, " ").alias("metrics"))


def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aggregate_metrics(_values(spark, sf_dir)).select("family", "k", F.round("value", 6).alias("value"))


def eval_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metric_table(_values(spark, sf_dir))


def qrels_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluated_qrels(read_table(spark, sf_dir, "qrels"), clean_run(spark, sf_dir))


def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to rank one run side by side: by score, and by the contributors' mean score."""
    qrels = read_table(spark, sf_dir, "qrels")
    rows = read_table(spark, sf_dir, "retrieved_pages").where("score is not null and not isnan(score)")
    mean = F.aggregate("chunks", F.lit(0.0), lambda acc, c: acc + F.coalesce(F.nanvl(c["score"], F.lit(0.0)), F.lit(0.0))) / F.greatest(F.size("chunks"), F.lit(1))
    other = rows.groupBy("query_id", "page_id").agg(F.round(F.max(F.coalesce(mean, F.lit(0.0))), 6).alias("score"))
    runs = {"by score": clean_run(spark, sf_dir), "by mean": retrieval.rank_pages(other, 100)}
    out = None
    for label, run in runs.items():
        means = evaluation.aggregate_metrics(evaluation.metric_values(run, qrels))
        part = means.select(F.lit(label).alias("label"), F.concat_ws("@", "family", "k").alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    labels = [f"{f}@{k}" for f in evaluation.FAMILIES for k in (1, 5, 10)]
    return out.groupBy("label").pivot("metric", labels).agg(F.round(F.first("value"), 6))


def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = retrieval.rank_pages(clean_run(spark, sf_dir).drop("rank"), 10)
    return evaluation.hits(run, read_table(spark, sf_dir, "qrels")).select(
        "query_id", "page_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"), "hit"
    )


def best_chunk_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_chunk_per_page(read_table(spark, sf_dir, "retrieved_pages"))


def qrels_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_of_qrels(read_table(spark, sf_dir, "qrels"))


def query_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_set_identity(read_table(spark, sf_dir, "queries"))


def qrels_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments per document through its pages."""
    pages = read_table(spark, sf_dir, "corpus").select("page_id", "doc_id").distinct()
    return read_table(spark, sf_dir, "qrels").join(pages, "page_id").groupBy("doc_id").agg(
        F.count("*").alias("judgments"), F.countDistinct("query_id").alias("queries")
    )


def retrieval_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = retrieval.rank_pages(clean_run(spark, sf_dir).drop("rank"), 5).select("query_id", "page_id", "rank")
    return retrieval.retrieval_payload(read_table(spark, sf_dir, "queries"), run)


def check_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read_table(spark, sf_dir, "queries").select("query_id", "text")
    # faults are put in: blank texts under known ids, and texts without id
    blank = queries.where("query_id % 7 = 0").select("query_id", F.lit(" ").alias("text"))
    unnamed = queries.where("query_id % 11 = 0").select(F.lit(None).cast("long").alias("query_id"), "text")
    return checks.query_conflicts(queries.unionByName(blank).unionByName(unnamed))


def subset_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgments of all report-type documents, with queries and pages numbered anew."""
    pages = read_table(spark, sf_dir, "corpus").select("page_id", "doc_id", "page_number").distinct()
    queries = read_table(spark, sf_dir, "queries").select("query_id", "text").distinct()
    chosen = read_table(spark, sf_dir, "documents_metadata").where("doc_type = 'report'")
    qrels = read_table(spark, sf_dir, "qrels").where("score is not null").select("query_id", "page_id", "score").distinct()
    return subset.select_documents(pages, queries, qrels, chosen).qrels.select("query_id", "page_id", "score")


_RUN = """
best as (select query_id, page_id, max(score) score from retrieved_pages where score is not null and not isnan(score) group by all),
run as (select * from (select *, row_number() over (partition by query_id order by score desc, page_id) rank from best) where rank <= 100)"""
_VALUES = """
judged as (select q.query_id, q.page_id, max(q.score) grade from qrels q
  where q.score is not null and q.query_id in (select query_id from run) group by all),
ks as (select unnest([1, 5, 10]) k),
ideal as (select query_id, grade, row_number() over (partition by query_id order by grade desc, page_id) place from judged where grade > 0),
best_gain as (select query_id, k, sum(grade / log2(place + 1)) filter (place <= k) idcg, count(*) relevant from ideal, ks group by all),
found as (select query_id, k, sum(grade / log2(rank + 1)) filter (rank <= k) dcg, count(*) filter (rank <= k) hits, min(rank) filter (rank <= k) first_hit
  from run join judged using (query_id, page_id), ks where grade > 0 group by all),
base as (select distinct query_id, k from judged, ks),
vals as (
  select query_id, k, unnest(['nDCG', 'Recall', 'Success', 'RR']) family,
    unnest([case when idcg > 0 then coalesce(dcg, 0) / idcg else 0 end, case when relevant > 0 then coalesce(hits, 0) / relevant else 0 end,
      case when hits > 0 then 1.0 else 0.0 end, coalesce(1.0 / first_hit, 0)]) as value, unnest([0, 1, 2, 3]) fo
  from base left join best_gain using (query_id, k) left join found using (query_id, k))"""
_PIVOT = ", ".join(
    f"round(max(value) filter (family = '{f}' and k = {k}), 6) as \"{f}@{k}\"" for f in evaluation.FAMILIES for k in (1, 5, 10)
)
_OTHER = _RUN.replace(
    "max(score) score",
    "round(max(coalesce(list_sum(list_transform(chunks, lambda c: coalesce(case when isnan(c.score) then 0 else c.score end, 0))), 0)"
    " / greatest(len(chunks), 1)), 6) score",
)


def _identity(table: str, *columns: str) -> str:
    cells = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns)
    return f"""
with h as (select distinct sha256({cells}) h from {table}),
g as (select left(h, 3) g, sha256(string_agg(h, '' order by h)) h from h group by 1)
select sha256(string_agg(h, '' order by g)) as identity from g"""


ORACLES = {
    "qrels_identity": _identity("qrels", "query_id", "page_id", "score"),
    "query_set_hash": _identity("queries", "query_id", "text"),
    **{
        f"eval_{f.lower()}": f"with {_RUN}, {_VALUES} select query_id, k, round(value, 6) as value from vals where family = '{f}'"
        for f in evaluation.FAMILIES
    },
    "eval_per_query": f"with {_RUN}, {_VALUES} select query_id, string_agg(family || '@' || k || '=' || printf('%.4f', value), ' ' order by fo, k) metrics from vals group by all",
    "eval_aggregate": f"with {_RUN}, {_VALUES} select family, k, round(avg(value), 6) as value from vals group by all",
    "eval_report_pivot": f"with {_RUN}, {_VALUES} select k, "
    + ", ".join(f"round(avg(value) filter (family = '{f}'), 6) as \"{f}\"" for f in evaluation.FAMILIES)
    + " from vals group by all",
    "qrels_semi_join": f"with {_RUN}, {_VALUES} select * from judged",
    "benchmark_compare": f"""
with a as (with {_RUN}, {_VALUES} select 'by score' as label, family, k, avg(value) as value from vals group by all),
b as (with {_OTHER}, {_VALUES} select 'by mean' as label, family, k, avg(value) as value from vals group by all)
select label, {_PIVOT} from (from a union all from b) group by all""",
    "retrieval_hits": f"""with {_RUN}, g as (select query_id, page_id, max(score) grade from qrels where score is not null group by all)
select query_id, page_id, cast(rank as int) rank, coalesce(grade, 0) grade, coalesce(grade > 0, false) hit from run left join g using (query_id, page_id) where rank <= 10""",
    "best_chunk_per_page": """
select query_id, page_id, arg_min(c.chunk_id, {'r': c.rank, 'i': c.chunk_id}) chunk_id
from (select query_id, page_id, unnest(chunks) c from retrieved_pages) group by all""",
    "retrieval_results_json": f"""with {_RUN}
select query_id, coalesce('[' || string_agg(printf('{{"rank":%d,"page_id":%d}}', rank, page_id), ',' order by rank) || ']', '[]') payload
from (select distinct query_id from queries) left join (select * from run where rank <= 5) using (query_id) group by all""",
    "check_queries": r"""
with asked as (select query_id, text from queries union all select query_id, ' ' from queries where query_id % 7 = 0
  union all select null, text from queries where query_id % 11 = 0)
select 'no id' as rule, text detail from asked where query_id is null
union all select 'blank text', query_id::varchar from asked where text is null or not regexp_matches(text, '\S')
union all select 'id twice', query_id::varchar from (select query_id from asked group by all having count(*) > 1)""",
    "subset_judgments": """
with p as (select distinct page_id, doc_id, page_number from corpus where doc_id in (select doc_id from documents_metadata where doc_type = 'report')),
pn as (select page_id, row_number() over (order by page_id) - 1 new_page from (select distinct page_id from p)),
j as (select distinct query_id, page_id, score from qrels where score is not null and page_id in (select page_id from p) and query_id in (select query_id from queries)),
qn as (select query_id, row_number() over (order by query_id) - 1 new_query from (select distinct query_id from j))
select new_query query_id, new_page page_id, score from j join pn using (page_id) join qn using (query_id)""",
    "qrels_of_documents": """
select doc_id, count(*) judgments, count(distinct query_id) queries
from qrels join (select distinct page_id, doc_id from corpus) using (page_id) group by all""",
}
QUERIES = {
    f.__name__: f
    for f in (
        *(_family(x) for x in evaluation.FAMILIES), eval_per_query, eval_aggregate, eval_report_pivot, qrels_semi_join,
        benchmark_compare, retrieval_hits, best_chunk_per_page, qrels_identity, query_set_hash, qrels_of_documents,
        retrieval_results_json, check_queries, subset_judgments,
    )
}
