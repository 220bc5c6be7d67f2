"""Queries on dangling references of the supplied tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.orphans import ForeignKey, find_orphans, orphan_report
from folioscope.session import read_table

KEYS = (
    ForeignKey("qrels", "page_id", "judged_at", "corpus", "page_id"),
    ForeignKey("qrels", "query_id", "judged_at", "queries", "query_id"),
    ForeignKey("corpus", "doc_id", "loaded_at", "documents_metadata", "doc_id"),
)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("qrels", "corpus", "queries", "documents_metadata")
    return find_orphans({n: read_table(spark, sf_dir, n) for n in names}, KEYS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _orphans(spark, sf_dir)
        .where("kind = 'direct'")
        .select("ref_table", "ref_column", "ref_value", "period", "reason")
        .distinct()
    )


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _orphans(spark, sf_dir)
        .where("kind = 'inherited'")
        .select("ref_table", "ref_column", "ref_value", "period")
        .distinct()
    )


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


_REFS = """
refs as (
  select 'qrels' ref_table, 'page_id' ref_column, cast(page_id as varchar) v, judged_at t from qrels
  union select 'qrels', 'query_id', cast(query_id as varchar), judged_at from qrels
  union select 'corpus', 'doc_id', doc_id, loaded_at from corpus),
targets as (
  select 'qrels' ref_table, 'page_id' ref_column, cast(page_id as varchar) k, loaded_at l, deleted_at d,
         doc_id owner from corpus
  union all select 'qrels', 'query_id', cast(query_id as varchar), loaded_at, deleted_at, null from queries
  union all select 'corpus', 'doc_id', doc_id, loaded_at, deleted_at, null from documents_metadata),
judged as (
  select r.ref_table, r.ref_column, r.v, r.t, count(g.k) n, min(g.l) first_l,
         coalesce(bool_or(g.l <= r.t and (g.d is null or g.d > r.t)), false) live
  from refs r left join targets g on g.ref_table = r.ref_table and g.ref_column = r.ref_column and g.k = r.v
  where r.v is not null and r.t is not null group by all),
direct as (
  select *, case when n = 0 then 'missing' when first_l > t then 'late' else 'deleted' end reason
  from judged where not live),
inherited as (
  select j.ref_table, j.ref_column, j.v, j.t from judged j where j.live and j.ref_column = 'page_id' and not exists (
    select 1 from targets g where g.ref_column = 'page_id' and g.k = j.v and g.l <= j.t and (g.d is null or g.d > j.t)
    and not exists (select 1 from direct x where x.ref_table = 'corpus' and x.v = g.owner and x.t = g.l)))
"""

ORACLES = {
    "p4_found": f"with {_REFS} select distinct ref_table, ref_column, v ref_value, strftime(t, '%Y-%m') period, reason from direct",
    "p4_cascade": f"with {_REFS} select distinct ref_table, ref_column, v ref_value, strftime(t, '%Y-%m') period from inherited",
    "p4_report": f"""with {_REFS}, both_kinds as (
  select ref_table, ref_column, strftime(t, '%Y-%m') period, reason from direct
  union all select ref_table, ref_column, strftime(t, '%Y-%m'), 'inherited' from inherited)
select ref_table, ref_column, period, count(*) filter (reason <> 'inherited') direct_refs,
  count(*) filter (reason = 'inherited') inherited_refs, count(*) filter (reason = 'missing') missing_refs,
  count(*) filter (reason = 'late') late_refs, count(*) filter (reason = 'deleted') deleted_refs
from both_kinds group by all""",
}
QUERIES = {"p4_found": p4_found, "p4_cascade": p4_cascade, "p4_report": p4_report}
