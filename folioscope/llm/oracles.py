"""SQL twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from folioscope.llm import truncation

_RANKED = """
with best as (select query_id, page_id, max(score) score from retrieved_pages
  where query_id is not null and page_id is not null and score is not null and not isnan(score) group by all),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, page_id) as int) rank from best)
"""

_LINES = r"""
with lines as (
  select page_id, doc_id, unnest(string_split(content, chr(10))) line,
         unnest(range(len(string_split(content, chr(10))))) line_no
  from (select distinct page_id, doc_id, content from parsed_pages where content is not null)),
keyed as (
  select page_id, doc_id, cast(line_no as int) line_no,
    regexp_replace(trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')), '\p{N}+', '0', 'g') k from lines),
owned as (
  select k.*, m.publisher from keyed k join (select distinct doc_id, publisher from documents_metadata) m using (doc_id)
  where length(replace(replace(k, ' ', ''), '0', '')) >= 20),
sizes as (select publisher, count(distinct doc_id) of_source from documents_metadata group by all),
repeated as (
  select publisher, k, count(distinct doc_id) n_docs, of_source from owned join sizes using (publisher) group by publisher, k, of_source
  having count(distinct doc_id) >= 4 and count(distinct doc_id) >= of_source * 0.2)
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind() -> str:
    """The kind of an ending, from the fixed patterns; SQL has no look-ahead, so years are asked for by themselves."""
    (notes, notes_form), *forms = truncation._FORMS
    cases = [f"when regexp_matches(line, {_quoted(notes_form)}) then '{notes}'"]
    cases += [
        f"""when regexp_matches(bare, {_quoted(truncation._SENTENCE)}) and not (regexp_matches(bare, '(^|\\s)\\d[\\d.,]*\\.$')
            and not regexp_matches(bare, '(^|\\s)(19|20)\\d\\d\\.([\\d.,]*\\.)?$')) then 'sentence'""",
        "when bare <> line then 'open'",
    ]
    cases += [f"when regexp_matches(line, {_quoted(form)}) then '{name}'" for name, form in forms]
    return "case when trim(line) = '' then 'none' " + " ".join(cases) + " else 'open' end"


_SHAPE = r"""regexp_replace(regexp_replace(regexp_replace(line, '^\s*#{1,6}\s+', ''), '\p{Lu}\p{Ll}{4,}', 'N', 'g'), '[\d.,]*\d', '0', 'g')"""
_ENDINGS = f"""
with texts as (select doc_id, source, text, length(text) chars, strlen(text) bytes,
    list_extract(string_split(rtrim(text, {_quoted(truncation._BLANK)}), chr(10)), -1) line from documents where text is not null),
endings as (select *, {_kind()} ending, {_SHAPE} shape
  from (select *, regexp_replace(line, {_quoted(truncation._MARK)}, '') bare from texts)),
counts as (select source, unit, size, count(*) n from (
    select source, 'chars' unit, chars size from endings union all select source, 'bytes', bytes from endings) group by all),
risks as (select *, sum(n) over (partition by source, unit order by size desc rows unbounded preceding) at_risk from counts),
near as (select *, sum(n) over (partition by source, unit order by size range between 64 preceding and 64 following) - n near_n,
    max(at_risk) over (partition by source, unit order by size range between 64 preceding and 64 following) * 128.0 near_risk from risks),
tested as (select *, case when n > expected then exp(n - expected + n * ln(expected / n)) else 1.0 end p
  from (select *, (near_n + 1.0) / near_risk * at_risk expected from near)),
ranked as (select *, rank() over (partition by source, unit order by p) place, count(*) over (partition by source, unit) tests from tested),
limits as (select source, unit, size, n from (
    select *, max(case when p <= 0.001 * place / tests then place end) over (partition by source, unit) furthest from ranked)
  where place <= furthest)
"""
_CUT = _ENDINGS + f""",
inside as (select {_SHAPE} shape, count(*) inside from (
    select rtrim(line, {_quoted(truncation._BLANK)}) line from (
      select unnest(list_slice(string_split(text, chr(10)), 1, -2)) line from texts where contains(text, chr(10))))
  where length(line) > 0 and right(line, 1) not in ('.', '!', '?') group by all),
at_ends as (select shape, count(*) at_end from endings where ending in ('open', 'list', 'heading', 'table') group by all),
whole as (select shape from inside join at_ends using (shape) where inside >= 0.6 * (inside + at_end + 1)),
placed as (select e.*, exists (select 1 from limits l where l.source is not distinct from e.source
    and (l.unit = 'chars' and l.size = e.chars or l.unit = 'bytes' and l.size = e.bytes)) at_limit,
    shape in (select shape from whole) known from endings e),
judged as (select *, case when at_limit then ending = 'open' or ending in ('list', 'heading', 'table') and not known
    else ending = 'open' and not known end cut from placed)
"""

ORACLES = {
    "p10_limits": _ENDINGS + "select source, unit, cast(size as int) size, cast(n as bigint) n from limits",
    "p10_found": _CUT + "select distinct doc_id from judged where cut",
    "p10_sources": _CUT + """
select source, count(*) texts, count(*) filter (cut) cut, round(count(*) filter (cut) / count(*), 6) share,
  count(*) filter (cut and at_limit) cut_at_limit, count(*) filter (cut and not at_limit) cut_in_transfer
from judged group by source""",
    "p1_found": r"""
with words as (
  select distinct chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w from chunks
  where content is not null and chunk_id is not null),
grams as (
  select distinct chunk_id, hash(w) t, array_to_string(w[i:i+2], ' ') g
  from (select chunk_id, w, unnest(range(1, len(w) - 1)) i from words)),
sizes as (select chunk_id, t, count(*) n from grams group by all),
shared as (
  select a.chunk_id ca, a.t ta, b.chunk_id cb, b.t tb, count(*) o
  from grams a join grams b on a.g = b.g and a.chunk_id < b.chunk_id group by all)
select distinct ca chunk_id_a, cb chunk_id_b
from shared join sizes x on x.chunk_id = ca and x.t = ta join sizes y on y.chunk_id = cb and y.t = tb
where o * 5 >= (x.n + y.n - o) * 3""",
    "p1_classes": r"""
with recursive words as (
  select distinct chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w from chunks
  where content is not null and chunk_id is not null),
texts as (select w, hash(w) t, min(chunk_id) name from words where len(w) >= 3 group by w),
grams as (select distinct name, array_to_string(w[i:i+2], ' ') g from (select name, w, unnest(range(1, len(w) - 1)) i from texts)),
sizes as (select name, count(*) n from grams group by all),
shared as (select a.name x, b.name y, count(*) o from grams a join grams b on a.g = b.g and a.name <> b.name group by all),
edges as (select x, y from shared join sizes p on p.name = x join sizes q on q.name = y where o * 5 >= (p.n + q.n - o) * 3),
reach as (select name x, name y from texts union select r.x, e.y from reach r join edges e on r.y = e.x),
classes as (select x, min(y) class_id from reach group by all)
select chunk_id, class_id, (select count(*) from edges e where e.x = name) links
from words join texts using (w) join classes on x = name""",
    "p5_found": _RANKED + "select query_id, page_id from ranked where rank <= 10",
    "p5_ranked": _RANKED + "select query_id, page_id, score, rank from ranked where rank <= 10",
    "p6_found": """
select distinct 'page' item_kind, cast(page_id as varchar) item_key from parsed_pages
where status = 'success' and length(content) > (select max_size from size_limits where purpose = 'page')
union select 'chunk', chunk_id from chunks
where length(content) > (select max_size from size_limits where purpose = 'chunk')""",
    "p6_rules": """
with items as (select 'page' item_kind, cast(page_id as varchar) item_key, content from parsed_pages where status = 'success'
  union select 'chunk', chunk_id, content from chunks)
select item_kind, count(*) items, cast(0 as bigint) too_long, cast(0 as bigint) wrong_overlap, cast(0 as bigint) not_joined
from items join size_limits on purpose = item_kind and unit = 'characters' and length(content) > max_size group by item_kind""",
    "p7_found": _LINES + "select distinct page_id, line_no from owned join repeated using (publisher, k)",
    "p7_lines": _LINES + "select publisher, k as line, n_docs, of_source from repeated",
    "p7_clean_pages": _LINES + """, hit as (select distinct page_id, line_no from owned join repeated using (publisher, k)),
texts as (select distinct page_id, content from parsed_pages where content is not null and page_id in (select page_id from hit)),
kept as (select t.page_id, t.content full_text, line, i from (select page_id, content, unnest(string_split(content, chr(10))) line,
    unnest(range(len(string_split(content, chr(10))))) i from texts) t
  where not exists (select 1 from hit h where h.page_id = t.page_id and h.line_no = t.i))
select page_id, coalesce(string_agg(line, chr(10) order by i), '') content,
  cast((select count(*) from hit h where h.page_id = texts.page_id) as int) removed
from texts left join kept using (page_id) group by page_id, texts.content""",
    "p8_rules": """
select max_size capacity, (select count(distinct doc_id) from documents where text <> '') texts, true as within, cast(0 as bigint) broken
from (select distinct max_size from size_limits where purpose = 'pack' and unit = 'tokens')""",
    "p9_items": r"""
with item_words as (
  select distinct item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
doc_words as (
  select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
item_runs as (
  select item_id, i, array_to_string(w[i:i+11], ' ') run from (select item_id, w, unnest(range(1, len(w) - 10)) i from item_words)),
doc_runs as (
  select doc_id, hash(w) t, i, array_to_string(w[i:i+11], ' ') run from (select doc_id, w, unnest(range(1, len(w) - 10)) i from doc_words)),
met as (select distinct doc_id, t, item_id, d.i from doc_runs d join item_runs r using (run)),
islands as (select *, i - row_number() over (partition by doc_id, t, item_id order by i) island from met)
select item_id, count(distinct doc_id) documents, max(n) longest_words
from (select doc_id, item_id, cast(count(*) + 11 as int) n from islands group by doc_id, t, item_id, island) group by item_id""",
    "p9_found": r"""
with item_words as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
doc_words as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
item_runs as (
  select distinct item_id, array_to_string(w[i:i+11], ' ') run
  from (select item_id, w, unnest(range(1, len(w) - 10)) i from item_words)),
doc_runs as (
  select distinct doc_id, array_to_string(w[i:i+11], ' ') run
  from (select doc_id, w, unnest(range(1, len(w) - 10)) i from doc_words))
select distinct doc_id, item_id from doc_runs join item_runs using (run)""",
}
