"""Pages, documents, chunks and rules over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import first_language, normalize_language, page_status
from folioscope.operators import checks, chunking, documents, parsing
from folioscope.operators.encoders import HashEncoder, HashTokenEncoder
from folioscope.session import read_table
from folioscope.sources.collection import create_corpus


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "parsed_pages")


def document_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.reconstruct(_parsed(spark, sf_dir))
    return docs.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"), F.size("page_ranges").alias("pages"))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.page_offsets(_parsed(spark, sf_dir)).select("doc_id", "page_id", "start", "end")


def _chunks(name: str, strategy: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = chunking.chunk(_parsed(spark, sf_dir), chunking.ChunkingConfig(strategy, options))
        pages = F.array_join(F.transform("page_ids", lambda p: p.cast("string")), ",")
        return rows.select("chunk_id", "doc_id", pages.alias("page_ids"), "start", "end", F.md5("content").alias("digest"))

    query.__name__ = name
    return query


def _paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n\n") if p]


if "paragraph" not in chunking._REGISTRY:
    chunking.register_chunker("paragraph")(_paragraphs)


def _marked_windows(text: str) -> list[dict]:
    parts = [text[a : a + 700] for a in range(0, len(text), 700)]
    return [{"content": t, "start": 700 * k, "end": 700 * k + len(t), "metadata": {"letters": sum(c.isalpha() for c in t)}} for k, t in enumerate(parts)]


if "marked_windows" not in chunking._REGISTRY:
    chunking.register_chunker("marked_windows")(_marked_windows)


def chunk_span_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a function that returns mappings with places and metadata."""
    rows = chunking.chunk(_parsed(spark, sf_dir), chunking.ChunkingConfig("marked_windows"))
    pages = F.array_join(F.transform("page_ids", lambda p: p.cast("string")), ",")
    return rows.select(
        "chunk_id", "doc_id", pages.alias("page_ids"), "start", "end", F.md5("content").alias("digest"), F.col("metadata")["letters"].cast("int").alias("letters")
    )


def chunk_late_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = HashTokenEncoder(dimension=16, most_tokens=10_000_000)
    config = chunking.ChunkingConfig("late", {"encoder": encoder, "embedding_model": "hash", "chunk_size": 1024}, cache_key="hash-16")
    rows = chunking.chunk(_parsed(spark, sf_dir), config)
    return rows.select("chunk_id", "doc_id", "start", "end", F.size("embedding").alias("width"))


def chunk_span_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied chunks that are not the slice of their document that they claim to be; every fifth start is given a wrong end."""
    docs = documents.reconstruct(_parsed(spark, sf_dir)).select("doc_id", "text")
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "content", F.col("char_start").alias("start"), F.when(F.col("char_start") % 5 == 0, F.col("char_end") + 1).otherwise(F.col("char_end")).alias("end"))
    return checks.span_conflicts(chunks.join(docs, "doc_id")).select("chunk_id", "start", "end").distinct()


def chunk_page_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that each supplied chunk overlaps, from offsets alone."""
    spans = read_table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")).distinct()
    return documents.overlap_join(spans, documents.page_offsets(_parsed(spark, sf_dir))).select("chunk_id", "page_id").distinct()


def multi_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "page_ids").distinct()
    return chunks.groupBy((F.size("page_ids") > 1).alias("several_pages")).agg(F.count("*").alias("chunks"))


def chunk_span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "char_start", "char_end").distinct()
    size = F.col("char_end") - F.col("char_start")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.sum(size).alias("chars")
    )


def page_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.status_counts(_parsed(spark, sf_dir), "content_format")


def page_status_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the content itself implies."""
    return _parsed(spark, sf_dir).select("page_id", page_status(F.col("content")).alias("derived")).distinct()


def parse_missing_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "corpus").select("page_id", "doc_id", "page_number").distinct()
    return parsing.missing_pages(pages, _parsed(spark, sf_dir), retry_failed=True)


def parse_merge_prefer_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success pages written over by a marked form, the rest from the cache."""
    cache = _parsed(spark, sf_dir)
    fresh = cache.where("status = 'success'").withColumn("content", F.concat(F.lit("new "), "content"))
    return parsing.merge_pages(cache, fresh).select("page_id", "status", F.md5(F.coalesce("content", F.lit("-"))).alias("digest"))


def parse_paginated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' paragraphs laid out as paginated Markdown and cut into pages again."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    marked = F.array_join(F.transform(F.split("text", "\n\n"), lambda p, i: F.concat(F.lit("{"), i.cast("string"), F.lit("}" + parsing.SENTINEL + "\n"), p)), "\n")
    return parsing.split_paginated(docs.select("doc_id", marked.alias("marked")), "marked").select(
        "doc_id", "page_number", F.length("page_text").alias("chars")
    )


def language_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents_metadata").select("doc_id", "doc_language").distinct()
    return rows.select("doc_id", "doc_language", normalize_language(first_language(F.col("doc_language"))).alias("code"))


def corpus_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents_metadata").groupBy("file_name", "doc_id").agg(F.max("page_number").alias("page_number"))
    return create_corpus(rows)


def check_contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.not_contiguous(read_table(spark, sf_dir, "corpus"), "page_id")


def check_fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels, corpus, queries = (read_table(spark, sf_dir, t) for t in ("qrels", "corpus", "queries"))
    a = checks.missing_targets(qrels, "page_id", corpus, "page_id").select(F.lit("page").alias("rule"), F.col("value").cast("string").alias("value"))
    b = checks.missing_targets(qrels, "query_id", queries, "query_id").select(F.lit("query").alias("rule"), F.col("value").cast("string").alias("value"))
    return a.unionByName(b)


def check_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(read_table(spark, sf_dir, "qrels"), "query_id", "page_id")


def check_page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents_metadata").select("doc_id", "page_number").distinct()
    pages = read_table(spark, sf_dir, "corpus").select("doc_id", "page_number").distinct()
    return checks.page_coverage(pages, docs).select("doc_id", "declared", "pages")


def check_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents_metadata").select("doc_id", "page_number").distinct()
    # faults are put in: every 13th page number is far too high
    wrong = F.when(F.col("page_id") % 13 == 0, F.col("page_number") + 1000).otherwise(F.col("page_number"))
    pages = read_table(spark, sf_dir, "corpus").select("page_id", "doc_id", wrong.alias("page_number")).distinct()
    return checks.pages_out_of_range(pages, docs).select("page_id", "doc_id")


def check_status_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    # faults are put in: every ninth page claims to be empty
    wrong = F.when(F.col("page_id") % 9 == 0, "empty").otherwise(F.col("status"))
    return checks.status_conflicts(_parsed(spark, sf_dir).withColumn("status", wrong)).select("page_id", "status")


def check_parser_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "corpus").select("page_id", "doc_id", "page_number").distinct()
    return checks.parser_output_conflicts(pages, _parsed(spark, sf_dir)).select("page_id")


def check_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # faults are put in: no text, no id, a page twice
    chunks = read_table(spark, sf_dir, "chunks").select(
        F.when(F.col("char_start") % 7 != 1, F.col("chunk_id")).alias("chunk_id"),
        "doc_id",
        F.when(F.col("char_start") % 11 != 1, F.col("content")).alias("content"),
        F.when(F.col("char_start") % 13 == 1, F.concat("page_ids", "page_ids")).otherwise(F.col("page_ids")).alias("page_ids"),
    )
    return checks.chunk_conflicts(chunks).select("chunk_id")


def check_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.contributor_conflicts(read_table(spark, sf_dir, "retrieved_pages")).groupBy("query_id").agg(F.count("*").alias("rows"))


def check_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, queries, pages = (read_table(spark, sf_dir, t) for t in ("retrieved_pages", "queries", "corpus"))
    return checks.run_conflicts(run, queries, pages).groupBy("rule").agg(F.count("*").alias("conflicts"))


_USABLE = """usable as (select distinct page_id, doc_id, page_number, content from parsed_pages
  where status = 'success' and content is not null and content <> ''),
offsets as (select *, coalesce(sum(length(content) + 1) over (partition by doc_id order by page_number, page_id
  rows between unbounded preceding and 1 preceding), 0) s from usable)"""
_DOCS = f"{_USABLE}, docs as (select doc_id, string_agg(content, chr(10) order by page_number, page_id) txt, count(*) pages from usable group by all)"
_ON = """select c.chunk_id, c.doc_id, string_agg(page_id::varchar, ',' order by o.s) page_ids, c.start, c."end", c.digest
from named c join offsets o on o.doc_id = c.doc_id and c.start < o.s + length(o.content) and c."end" > o.s group by all"""
_PLACED = """placed as (select s.*, string_agg(page_id::varchar, ',' order by o.s) page_ids from spans s join offsets o
  on o.doc_id = s.doc_id and s.start < o.s + length(o.content) and s."end" > o.s group by all),
named as (select *, printf('%s:%08d', doc_id, row_number() over (partition by doc_id order by place) - 1) chunk_id from placed)"""

ORACLES = {
    "document_reconstruct": f"with {_DOCS} select doc_id, length(txt) chars, md5(txt) digest, pages from docs",
    "page_offsets": f'with {_USABLE} select doc_id, page_id, s start, s + length(content) "end" from offsets',
    "chunk_page": """
with usable as (select distinct page_id, doc_id, page_number, content from parsed_pages where status = 'success' and content is not null and content <> '')
select printf('%s:%08d', doc_id, row_number() over (partition by doc_id order by page_number, page_id) - 1) chunk_id, doc_id,
  page_id::varchar page_ids, 0 start, length(content) "end", md5(content) digest from usable""",
    "chunk_token_window": f"""
with {_DOCS}, w as (select doc_id, txt, unnest(range(0, greatest(length(txt) - 64, 1), 448)) start from docs),
named as (select printf('%s:%08d', doc_id, row_number() over (partition by doc_id order by start) - 1) chunk_id, doc_id, start,
  least(start + 512, length(txt)) "end", md5(substr(txt, start + 1, 512)) digest from w) {_ON}""",
    "chunk_function_paragraph": f"""
with {_DOCS}, parts as (select doc_id, unnest(string_split(txt, chr(10) || chr(10))) part, unnest(range(len(string_split(txt, chr(10) || chr(10))))) place from docs),
spans as (select doc_id, place, cast(sum(length(part) + 2) over (partition by doc_id order by place) - length(part) - 2 as int) start,
  cast(sum(length(part) + 2) over (partition by doc_id order by place) - 2 as int) "end", md5(part) digest from parts qualify part <> ''),
{_PLACED} select chunk_id, doc_id, page_ids, start, "end", digest from named""",
    "chunk_span_mapping": f"""
with {_DOCS}, w as (select doc_id, txt, unnest(range(0, length(txt), 700)) start from docs),
spans as (select doc_id, start place, cast(start as int) start, cast(least(start + 700, length(txt)) as int) "end", md5(substr(txt, start + 1, 700)) digest,
  length(regexp_replace(substr(txt, start + 1, 700), '[^\\p{{L}}]', '', 'g')) letters from w),
{_PLACED} select chunk_id, doc_id, page_ids, start, "end", digest, cast(letters as int) letters from named""",
    "chunk_page_provenance": f"""
with {_USABLE} select distinct chunk_id, page_id from chunks c join offsets o on o.doc_id = c.doc_id
and c.char_start < o.s + length(o.content) and c.char_end > o.s""",
    "chunk_span_check": f"""
with {_DOCS}, shifted as (select * replace (case when char_start % 5 = 0 then char_end + 1 else char_end end as char_end) from chunks)
select distinct chunk_id, char_start start, char_end "end" from shifted join docs using (doc_id)
where length(content) = 0 or char_start < 0 or char_start >= char_end or char_end > length(txt)
or substr(txt, char_start + 1, char_end - char_start) <> content""",
    "multi_page_chunks": "select len(page_ids) > 1 several_pages, count(*) chunks from (select distinct chunk_id, page_ids from chunks) group by all",
    "chunk_span_stats": """
select doc_id, count(*) chunks, min(char_end - char_start) shortest, max(char_end - char_start) longest, sum(char_end - char_start) chars
from (select distinct chunk_id, doc_id, char_start, char_end from chunks) group by all""",
    "page_status_counts": "select content_format, status, count(*) pages from parsed_pages group by all",
    "page_status_derived": r"select distinct page_id, case when content is null then 'failed' when not regexp_matches(content, '\S') then 'empty' else 'success' end derived from parsed_pages",
    "parse_missing_anti_join": """
select distinct page_id, doc_id, page_number from corpus c
where not exists (select 1 from parsed_pages p where p.page_id = c.page_id and p.status <> 'failed')""",
    "parse_merge_prefer_new": """
select page_id, status, md5(coalesce(case when status = 'success' then 'new ' || content else content end, '-')) digest
from (select distinct page_id, status, content from parsed_pages)""",
    "parse_paginated_text": """
select doc_id, cast(i - 1 as int) page_number, length(trim(p[i], chr(10) || ' ' || chr(9) || chr(13) || chr(160))) chars
from (select doc_id, string_split(text, chr(10) || chr(10)) p, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) i from documents where text is not null)""",
    "language_normalize": """
with t as (select distinct doc_id, doc_language from documents_metadata),
b as (select *, lower(coalesce(nullif(trim(doc_language), ''), 'en')) l from t)
select doc_id, doc_language, case when l in ('en', 'eng', 'english') then 'en' when l in ('fr', 'fra', 'fre', 'french') then 'fr'
  when l in ('de', 'deu', 'ger', 'german') then 'de' when l in ('lb', 'ltz', 'luxembourgish') then 'lb' else l end code from b""",
    "corpus_numbering": """
with d as (select file_name, doc_id, max(page_number) n from documents_metadata group by all),
o as (select *, coalesce(sum(n) over (order by lower(file_name), file_name rows between unbounded preceding and 1 preceding), 0) b from d)
select cast(b + i as bigint) page_id, doc_id, cast(i as int) page_number from (select *, unnest(range(n)) i from o)""",
    "check_contiguous_ids": """
select * from (select count(page_id) n, count(distinct page_id) distinct_ids, min(page_id) low, max(page_id) high from corpus)
where n > 0 and (n <> distinct_ids or low <> 0 or high <> n - 1)""",
    "check_fk_violations": """
select distinct 'page' as rule, page_id::varchar as value from qrels where page_id not in (select page_id from corpus)
union all select distinct 'query', query_id::varchar from qrels where query_id not in (select query_id from queries)""",
    "check_duplicates": "select query_id, page_id, count(*) n from qrels group by all having count(*) > 1",
    "check_page_coverage": """
with d as (select distinct doc_id, page_number declared from documents_metadata),
p as (select doc_id, count(*) pages, min(page_number) low, max(page_number) high from (select distinct doc_id, page_number from corpus) group by all)
select doc_id, declared, pages from d left join p using (doc_id) where pages is null or pages <> declared or low <> 0 or high <> declared - 1""",
    "check_page_range": """
select page_id, doc_id from (select distinct page_id, doc_id, case when page_id % 13 = 0 then page_number + 1000 else page_number end page_number from corpus) c
join (select distinct doc_id, page_number declared from documents_metadata) d using (doc_id) where page_number < 0 or page_number >= declared""",
    "check_status_content": r"""
select page_id, status from (select page_id, content, case when page_id % 9 = 0 then 'empty' else status end status from parsed_pages) where not coalesce(case status when 'success' then content is not null and regexp_matches(content, '\S')
  when 'empty' then content = '' when 'failed' then content is null else false end, false) or page_id < 0""",
    "check_parser_output": """
with w as (select distinct page_id, doc_id, page_number from corpus), h as (select page_id, count(*) n_rows, min(doc_id) d, min(page_number) n from parsed_pages group by all)
select page_id from w full join h using (page_id) where doc_id is null or d is null or n_rows <> 1 or doc_id <> d or page_number is distinct from n""",
    "check_chunks": """
select case when char_start % 7 <> 1 then chunk_id end chunk_id from (select * replace (
  case when char_start % 11 <> 1 then content end as content,
  case when char_start % 13 = 1 then list_concat(page_ids, page_ids) else page_ids end as page_ids) from chunks)
where char_start % 7 = 1 or doc_id = '' or coalesce(content, '') = '' or coalesce(len(page_ids), 0) = 0
or len(list_distinct(page_ids)) <> len(page_ids)""",
    "check_contributors": """
select query_id, count(*) as rows from retrieved_pages
where rank < 1 or coalesce(len(chunks), 0) = 0 or not coalesce(list_bool_and(list_transform(chunks, lambda c: list_contains(c.page_ids, page_id))), true) group by all""",
    "check_run": """
with v as (
  select 'unknown query' as rule from (select distinct query_id from retrieved_pages where query_id not in (select query_id from queries))
  union all select 'unknown page' from (select distinct page_id from retrieved_pages where page_id not in (select page_id from corpus))
  union all select 'page twice' from (select query_id, page_id from retrieved_pages group by all having count(*) > 1)
  union all select 'rank twice' from (select query_id, rank from retrieved_pages group by all having count(*) > 1))
select rule, count(*) conflicts from v group by all""",
}
QUERIES = {
    f.__name__: f
    for f in (
        document_reconstruct, page_offsets, _chunks("chunk_page", "page"),
        _chunks("chunk_token_window", "token", chunk_size=512, chunk_overlap=64), _chunks("chunk_sentence", "sentence", chunk_size=1024, chunk_overlap=128),
        _chunks("chunk_recursive", "recursive", chunk_size=1024), _chunks("chunk_fast", "fast", chunk_size=1024),
        _chunks("chunk_semantic", "semantic", encoder=HashEncoder(64), threshold=0.5, chunk_size=2048), chunk_late_pool,
        _chunks("chunk_function_paragraph", "paragraph"), chunk_span_mapping, chunk_span_check, chunk_page_provenance, multi_page_chunks, chunk_span_stats,
        page_status_counts, page_status_derived, parse_missing_anti_join, parse_merge_prefer_new, parse_paginated_text, language_normalize,
        corpus_numbering, check_contiguous_ids, check_fk_violations, check_duplicates, check_page_coverage, check_page_range,
        check_status_content, check_parser_output, check_chunks, check_contributors, check_run,
    )
}
