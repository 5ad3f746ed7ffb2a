"""SQL twins of the registered queries, for DuckDB over the same tables.

They are written against the rules, not against the Spark code: texts are put
together where Spark sums up parts, requests and fragments are paired up where
Spark joins on tokens, positions come from one window where Spark counts in
blocks.
"""

from __future__ import annotations

from doclake.functions import fixed_values as fv
from doclake.plans import views


def _view(text: str) -> str:
    return text.format(**views.DUCKDB)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        f"lambda r: concat(upper(r[1]), lower(r[2:]))), '')"
    )


def _stem(x: str) -> str:
    return f"regexp_replace({x}, '(?s)^(.+)\\.[^.]+$', '\\1')"


def _suffix(x: str) -> str:
    return f"lower(regexp_extract({x}, '(?s)^.+(\\.[^.]+)$', 1))"


def _humanize(x: str) -> str:
    return f"coalesce(nullif({_title(f'trim(translate({x}, chr(95) || chr(45), chr(32) || chr(32)))')}, ''), 'Documento')"


def _ascii(x: str) -> str:
    return f"regexp_replace(strip_accents(replace(replace({x}, 'º', 'o'), 'ª', 'a')), '[^\\x00-\\x7F]', '', 'g')"


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({_ascii(x)}, '[^a-zA-Z0-9._-]', '_', 'g'), '_{{2,}}', '_', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<br\\s*/?>|&lt;br\\s*/?&gt;', ' ', 'gi')"
    out = f"regexp_replace({out}, '(?s)```.*?```', ' ', 'g')"
    out = f"regexp_replace({out}, '`([^`]*)`', '\\1', 'g')"
    out = f"regexp_replace({out}, '!\\[.*?\\]\\(.*?\\)', ' ', 'g')"
    out = f"regexp_replace({out}, '\\[(.*?)\\]\\(.*?\\)', '\\1', 'g')"
    out = f"regexp_replace({out}, '(?m)^#{{1,6}}\\s*', '', 'g')"
    out = f"regexp_replace({out}, '[*_~>#-]', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{2,}}', chr(10), 'g')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    return _strip(out)


# --- documents and fragments ----------------------------------------------

PAGE_DOCS = f"""
  page_texts as ({_view(views.PAGE_TEXTS)}),
  page_docs as (
    select document_id, concat(document_id, '.md') as file_name,
           string_agg(concat(chr(10), chr(10), '## Página ', page_no, chr(10), chr(10),
                      case when regexp_matches(page_text, '\\S') then page_text
                           else concat('*[Página sin texto legible extraíble]*', chr(10)) end),
                      '' order by page_no) as markdown
    from page_texts group by document_id)"""

LOOSE_DOCS = f"""
  loose as ({_view(views.LOOSE_PAGES)}),
  md as (
    select document_id, concat(document_id, '.md') as file_name,
           string_agg(concat(chr(10), chr(10), '## Página ', page_no, chr(10), chr(10),
                      case when regexp_matches(page_text, '\\S') then page_text
                           else concat('*[Página sin texto legible extraíble]*', chr(10)) end),
                      '' order by page_no) as markdown
    from loose where document_id is not null and page_no is not null group by document_id)"""

MARKUP_DOCS = f"markup_docs as ({_view(views.MARKUP_DOCS)})"

ALL_DOCS = f"""{PAGE_DOCS}, {MARKUP_DOCS},
  md as (select document_id, file_name, markdown from page_docs
         union all select document_id, file_name, markdown from markup_docs)"""

ONLY_PAGE_DOCS = f"{PAGE_DOCS}, md as (select document_id, file_name, markdown from page_docs)"

UPLOADED_DOCS = ONLY_PAGE_DOCS.replace("from page_texts group by", "from page_texts where page_no % 4 <> 0 group by")
TWICE_DOCS = ONLY_PAGE_DOCS.replace(
    "from page_texts group by",
    "from (select * from page_texts union all select * from page_texts where page_no % 3 = 1 and page_no < 9) p group by",
)

SECTIONS = f"""
  lines as (
    select document_id, unnest(ls) as l, generate_subscripts(ls, 1) as pos
    from (select document_id, string_split_regex(regexp_replace(markdown, '\\n$', ''), '\\r\\n|[\\n\\r\\v\\f]') as ls from md)),
  headed as (select *, regexp_matches(l, '^#{{1,6}}\\s+.*$') as h from lines),
  numbered as (select *, sum(case when h then 1 else 0 end) over (partition by document_id order by pos) as s from headed),
  sections as (
    select document_id, cast(s as bigint) as s,
           coalesce(max(trim(regexp_extract(l, '^#{{1,6}}\\s+(.*)$', 1))) filter (where h), 'Inicio') as section,
           {_strip("string_agg(l, chr(10) order by pos)")} as content
    from numbered group by document_id, s)"""

PIECES = f"""
  para as (
    select document_id, s, section, unnest(ps) as p, generate_subscripts(ps, 1) as pp
    from (select *, string_split(content, chr(10) || chr(10)) as ps from sections where length(content) > 2000)),
  para2 as (select * replace ({_strip("p")} as p) from para),
  un as (
    select document_id, s, section, pp, 0 as lp, p as u, 2 as j from para2 where p <> '' and length(p) <= 2000
    union all
    select document_id, s, section, pp, lp, u, 1
    from (select document_id, s, section, pp, generate_subscripts(ls, 1) as lp, {_strip("unnest(ls)")} as u
          from (select *, string_split(p, chr(10)) as ls from para2 where length(p) > 2000)) where u <> ''),
  unit as materialized (select *, row_number() over (partition by document_id, s order by pp, lp) as n from un),
  fold as (
    select document_id, s, n, 1 as part, cast(length(u) + j as bigint) as len from unit where n = 1
    union all
    select x.document_id, x.s, x.n, f.part + case when f.len + length(u) > 2000 then 1 else 0 end,
           case when f.len + length(u) > 2000 then 0 else f.len end + length(u) + x.j
    from fold f join unit x on x.document_id = f.document_id and x.s = f.s and x.n = f.n + 1),
  grouped as (
    select document_id, s, section, part, list(u order by n) as us, arg_min(j, n) as j1,
           max(part) over (partition by document_id, s) as mp
    from fold join unit using (document_id, s, n) group by document_id, s, section, part),
  joined as (select *, lead(j1, 1, 2) over (partition by document_id, s order by part) as jj from grouped),
  pieces as (
    select document_id, s, 0 as part, section, content from sections where length(content) <= 2000
    union all
    select document_id, s, part, case when mp > 1 then concat(section, ' (Parte ', part, ')') else section end,
           case when jj = 1 then array_to_string(us, chr(10)) else array_to_string(us, chr(10) || chr(10)) end
    from joined),
  fragments as (
    select concat(document_id, '-fragment-', chunk_number) as id, document_id,
           {_title("translate(document_id, chr(95) || chr(45), chr(32) || chr(32))")} as title,
           section, cast(chunk_number as integer) as chunk_number, concat(document_id, '.md') as source,
           content as content_markdown, {_plain("content")} as content_text
    from (select *, row_number() over (partition by document_id order by s, part) as chunk_number from pieces)
    where content <> '')"""


def _from_fragments(select: str, docs: str = ONLY_PAGE_DOCS, extra: str = "") -> str:
    return f"with recursive {docs}, {SECTIONS}, {PIECES}{extra} {select}"


# --- search ---------------------------------------------------------------

REQUESTS = f"requests as ({_view(views.SEARCH_REQUESTS)})"
LONG_REQUESTS = f"""long_requests as (
    {_view(views.LONG_REQUESTS)} union all select query_id, query from ({_view(views.SEARCH_REQUESTS)}))"""


def _terms(requests: str, name: str = "terms", highlight: bool = False) -> str:
    """CTEs from ``requests(query_id, query)`` to one row per term."""
    stop = _list(fv.STOP_WORDS)
    part = "trim(p)" if highlight else "p"
    if highlight:
        # The first occurrence only: split once at the mark.
        cut = (
            "case when strpos(t, concat('\"', p, '\"')) > 0 then concat(left(t, strpos(t, concat('\"', p, '\"')) - 1), ' ', "
            "substr(t, strpos(t, concat('\"', p, '\"')) + length(p) + 2)) else t end"
        )
        quoted_counts = f"list_filter(quoted, lambda p: len(list_filter(string_split(p, ' '), lambda w: not list_contains({stop}, w))) > 0)"
    else:
        cut = "replace(t, concat('\"', p, '\"'), ' ')"
        quoted_counts = f"list_filter(quoted, lambda w: not list_contains({stop}, w))"
    return f"""
  {name}_q as (select *, regexp_replace(lower({_strip("query")}), '\\s+', ' ', 'g') as q from {requests}),
  {name}_quoted as (
    select *, list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda p: {part}) as quoted from {name}_q),
  {name}_words as (
    select *, list_filter(string_split(list_reduce(list_concat([q], quoted), lambda t, p: {cut}), ' '), lambda w: w <> '') as words
    from {name}_quoted),
  {name}_sig as (
    select *, len(list_filter(words, lambda w: not list_contains({stop}, w))) + len({quoted_counts}) > 0 as sig from {name}_words),
  {name}_lists as (
    select *, list_filter(list_transform(quoted, lambda p: trim(p)), lambda p: p <> '') as phrases,
           list_filter(words, lambda w: not (sig and list_contains({stop}, w))) as kept,
           case when len(quoted) = 0 and len(words) > 1 then [q] else [] end as whole
    from {name}_sig),
  {name} as (
    select query_id, cast(unnest(range(len(list_concat(phrases, kept, whole)))) as integer) as pos,
           unnest(list_concat(phrases, kept, whole)) as text,
           unnest(list_concat(list_transform(phrases, lambda p: true), list_transform(kept, lambda p: false),
                              list_transform(whole, lambda p: true))) as is_phrase,
           unnest(list_concat(list_transform(phrases, lambda p: true), list_transform(kept, lambda p: true),
                              list_transform(whole, lambda p: false))) as required,
           unnest(list_concat(list_transform(phrases, lambda p: 1000), list_transform(kept, lambda p: 10),
                              list_transform(whole, lambda p: 1000))) as weight
    from {name}_lists)"""


HITS = f""",
  indexed as (
    select id, document_id, title, section, chunk_number, source, content_text,
           lower(concat(title, ' ', section, ' ', content_text)) as haystack from fragments),
  {REQUESTS},
  {_terms("requests")},
  words as (select query_id, text from terms where not is_phrase),
  phrases as (select query_id, arg_min(text, pos) as phrase from terms where is_phrase group by query_id),
  needed as (
    select query_id, request_limit, (select count(*) from words w where w.query_id = r.query_id) as n_words,
           (select phrase from phrases p where p.query_id = r.query_id) as phrase
    from requests r),
  word_hits as (
    select query_id, id, count(*) as matched,
           sum(least((length(haystack) - length(replace(haystack, text, ''))) // length(text), 5) * 10 + 10000) as points
    from words join indexed on contains(haystack, text) group by query_id, id),
  phrase_hits as (
    select query_id, id, (length(haystack) - length(replace(haystack, phrase, ''))) // length(phrase) * 50000 as points
    from phrases join indexed on contains(haystack, phrase)),
  scored as (
    select n.query_id, n.request_limit, w.id, w.points + coalesce(p.points, 0) as score
    from needed n join word_hits w on w.query_id = n.query_id and w.matched = n.n_words
    left join phrase_hits p on p.query_id = n.query_id and p.id = w.id
    where n.n_words > 0
    union all
    select n.query_id, n.request_limit, p.id, p.points
    from needed n join phrase_hits p on p.query_id = n.query_id where n.n_words = 0),
  ranked as (
    select s.query_id, s.request_limit, i.id, i.document_id, i.title, i.section, i.chunk_number, i.source,
           i.content_text, cast(s.score as bigint) as score,
           cast(row_number() over (partition by s.query_id
             order by s.score desc, i.chunk_number, i.document_id, i.id) as integer) as rank
    from scored s join indexed i on i.id = s.id),
  hits as (select * exclude (request_limit), '' as content_markdown from ranked where rank <= request_limit)"""

SEARCH_HITS = _from_fragments(
    "select query_id, rank, id, document_id, title, section, chunk_number, source, content_markdown, content_text, score from hits",
    extra=HITS,
)

LIVE = """,
  live as (
    select * replace (case when starts_with(document_id, 'ORD_') then concat('v2 ', section) else section end as section)
    from fragments
    where not (starts_with(document_id, 'ORD_') and chunk_number > 5)
      and not (starts_with(document_id, 'RES_') and not ends_with(document_id, '1')))"""

LIVE_HITS = _from_fragments(
    "select query_id, rank, id, document_id, title, section, chunk_number, source, content_markdown, content_text, score from hits",
    extra=LIVE + HITS.replace("from fragments", "from live"),
)

VIEWED = f""",
  view_requests as ({_view(views.VIEW_REQUESTS)}),
  view_queries as (select request_id as query_id, query from view_requests),
  {_terms("view_queries", "vterms")},
  in_document as (
    select r.request_id, r.page, r.page_size, f.id, f.chunk_number, f.section,
           lower(concat(f.section, ' ', f.content_text)) as haystack
    from view_requests r join fragments f on f.document_id = r.document_id),
  judged as (
    select d.request_id, d.id,
           coalesce(bool_and(not t.required or contains(d.haystack, t.text)), true) as ok,
           coalesce(sum(case when t.text is null or not contains(d.haystack, t.text) then 0
                    when t.is_phrase then (length(d.haystack) - length(replace(d.haystack, t.text, ''))) // length(t.text) * 50000
                    else least((length(d.haystack) - length(replace(d.haystack, t.text, ''))) // length(t.text), 5) * 10 + 10000 end), 0) as score
    from in_document d left join vterms t on t.query_id = d.request_id group by d.request_id, d.id),
  found as (
    select d.request_id, d.page, d.page_size, d.id, d.chunk_number, d.section, cast(j.score as bigint) as score
    from in_document d join judged j on j.request_id = d.request_id and j.id = d.id where j.ok),
  placed as (
    select *, row_number() over (partition by request_id order by score desc, chunk_number, id) as position,
           count(*) over (partition by request_id) as total from found),
  paged as (
    select *, cast(greatest(1, ceil(total / page_size)) as integer) as total_pages from placed)"""


# --- library --------------------------------------------------------------

LIBRARY = f"""
  library_files as ({_view(views.LIBRARY_FILES)}),
  files as (select *, {_stem("file_name")} as stem from library_files)"""


def _noise(text: str, integer: str = "integer") -> str:
    return f"""cast(length({text}) as {integer}) as total_len,
      cast(length({text}) - length(regexp_replace({text}, '[-_=|]{{4,}}', '', 'g')) as {integer}) as noise_len,
      cast(len(regexp_extract_all({text}, '[a-zA-ZáéíóúÁÉÍÓÚñÑ]{{2,}}')) as {integer}) as words,
      regexp_matches({text}, '\\S') as has_text"""


NOISY = """case when not has_text or total_len < 50 then true
      when noise_len / total_len > 0.2 then true
      else words < 15 and total_len > 80 end"""


def _document_noise(source: str) -> str:
    return f"""
  whole as (select document_id, string_agg(' ' || content_text, '') as t from {source} group by document_id),
  measured as (select document_id, {_noise("t", "bigint")} from whole),
  document_noise as (select *, {NOISY} as is_noisy from measured)"""


CATALOG = f"""{LIBRARY},
  library_texts as (select {_stem("file_name")} as document_id, text as content_text from ({_view(views.LIBRARY_TEXTS)}) t),
  {_document_noise("library_texts")},
  catalog as (
    select stem as id, {_humanize("regexp_replace(stem, '^[0-9a-fA-F]{32}_', '')")} as title, file_name as filename,
           regexp_replace(file_name, '^[0-9a-fA-F]{{32}}_', '') as original_filename,
           stem in (select stem from files where size_bytes % 3000 <> 0) as converted,
           stem in (select document_id from document_noise where is_noisy) as is_scanned,
           case when upper(stem) like 'ORD\\_%' escape '\\' then 'Ordenanzas'
                when upper(stem) like 'RES\\_RC%' escape '\\' then 'Resoluciones de Concejo'
                when upper(stem) like 'RES\\_RA%' escape '\\' then 'Resoluciones de Alcaldía'
                when contains(upper(stem), 'CONCEJO') or contains(upper(stem), 'RC') then 'Resoluciones de Concejo'
                else 'Resoluciones de Alcaldía' end as category
    from files)"""

DUPLICATES = f"""{LIBRARY},
  candidates as (
    select key, file_name,
           trim(replace(translate(regexp_replace(lower(file_name), '(\\.(pdf|docx|doc|md|json))+$', ''), '- ', '__'), '__', '_'), '_') as duplicate_key,
           cast(case when contains(lower(file_name), '.pdf.pdf') then 20 else 0 end
              + case when length(file_name) > 4 and contains(left(lower(file_name), length(file_name) - 4), '.pdf') then 10 else 0 end
              + case when ends_with(file_name, '.PDF') then 2 else 0 end as integer) as penalty
    from library_files),
  ordered as (
    select *, row_number() over (partition by duplicate_key order by penalty, length(file_name), key) as r,
           count(*) over (partition by duplicate_key) as n from candidates),
  doomed as (select key, {_stem("file_name")} as stem from ordered where n > 1 and r > 1)"""

SUPPORTED = f"{_suffix('file_name')} in ('.pdf', '.doc', '.docx')"

STORED = f"stored as (select {_clean('file_name')} as name from library_files where size_bytes % 7000 = 0)"

CURRENT = """,
  cur as (select id, document_id, section, chunk_number from fragments),
  incoming as (
    select id, document_id, concat('v2 ', section) as section, chunk_number from cur where starts_with(document_id, 'ORD_')
    union all
    select concat('N-', id), concat('N-', document_id), section, chunk_number from cur where starts_with(document_id, 'RES_'))"""

CLIENT_ERRORS = f"""
with reports as ({_view(views.CLIENT_REPORTS)})
select epoch_us(ts) / 1e6 as "timestamp", message, source, lineno, colno, stack from reports"""

MARK_SPACE = "(?:\\s+|<br\\s*/?>|&lt;br\\s*/?&gt;)+"


def _escape_html(x: str) -> str:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;"))
    for char, entity in pairs:
        x = f"replace({x}, '{char}', '{entity}')"
    return x


HIGHLIGHT = f"""{HITS},
  {_terms("requests", "hterms", highlight=True)},
  patterns as (
    select query_id, concat('(?i)(', string_agg(
             replace(regexp_replace(text, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), ' ', '{MARK_SPACE}'),
             '|' order by length(text) desc, pos), ')') as pattern
    from hterms group by query_id),
  shown as (select h.query_id, h.rank, h.id, concat(left(h.content_text, 300), '...') as snippet, p.pattern
            from hits h join patterns p on p.query_id = h.query_id)"""


ORACLES: dict[str, str] = {
    "markdown_listing": f"""with {MARKUP_DOCS}
        select {_stem("file_name")} as id, {_humanize(_stem("file_name"))} as title, file_name as filename from markup_docs""",
    "catalog_documents": f"with {CATALOG} select * from catalog",
    "catalog_status_tags": f"""with {CATALOG} select id, filename,
        case when is_scanned then 'PDF Original' when not converted then 'Pendiente' else 'Markdown' end as status_tag from catalog""",
    "category_counts": f"""with {CATALOG}
        select c.category, count(k.id) as n_documents from (select unnest({_list(fv.CATEGORIES)}) as category) c
        left join catalog k on k.category = c.category group by c.category""",
    "category_filter": f"""with {CATALOG} select id, title, filename from catalog
        where category = 'Resoluciones de Alcaldía'
          and (contains(lower(title), 'acta') or contains(lower(original_filename), 'acta'))""",
    "title_search": f"""with {CATALOG} select id, title, filename from catalog
        where contains(lower(title), 'res 1') or contains(lower(original_filename), 'res 1')""",
    "sanitize_names": f"select doc_id, {_clean('text')} as clean_name from documents",
    "sanitize_upload_names": f"""with {LIBRARY} select key,
        concat(md5(key), '_', regexp_replace(file_name, '[^a-zA-Z0-9._-]', '_', 'g')) as upload_name from files""",
    "payload_titles": f"""with {LIBRARY} select key, stem,
        {_title("translate(stem, chr(95) || chr(45), chr(32) || chr(32))")} as title from files""",
    "duplicate_groups": f"""with {DUPLICATES} select duplicate_key, n as n_files, n - 1 as n_delete, key as keep_key
        from ordered where n > 1 and r = 1""",
    "duplicate_summary": f"""with {DUPLICATES}
        select count(distinct duplicate_key) as n_groups, cast(count_if(r > 1) as bigint) as n_delete from ordered where n > 1""",
    "duplicate_keep": f"""with {DUPLICATES} select duplicate_key, key, file_name, penalty,
        case when r = 1 then 'keep' else 'delete' end as decision from ordered where n > 1""",
    "duplicate_delete_plan": f"""with {DUPLICATES} select stem as document_id,
        unnest([key, concat('markdown/', stem, '.md'), concat('json/', stem, '.json')]) as object_key from doomed""",
    "purge_duplicates": f"""with {DUPLICATES} select * from (
          select {_stem("file_name")} as document_id, text as content_text from ({_view(views.LIBRARY_TEXTS)}) t) x
        where document_id not in (select stem from doomed)""",
    "pending_files": f"""with {LIBRARY}, {STORED} select key, {_clean("file_name")} as clean_name, size_bytes from files
        where {SUPPORTED} and {_clean("file_name")} not in (select name from stored)""",
    "pending_outputs": f"""with {LIBRARY},
        named as (select *, {_stem(_clean("file_name"))} as id from files where {SUPPORTED}),
        flagged as (select key, file_name, id,
          id in (select stem from files where size_bytes % 3000 <> 0) as has_markdown,
          id in (select {_stem(_clean("file_name"))} from files where size_bytes % 5000 <> 0) as has_json from named)
        select * from flagged where not has_markdown or not has_json""",
    "rejected_files": f"""with {LIBRARY} select file_name as filename, 'error' as status,
        concat('Formato no soportado: ', {_suffix("file_name")}) as error from files where not {SUPPORTED}""",
    "ingest_plan": f"""with {LIBRARY}, {STORED}, {MARKUP_DOCS},
        sources as (select 'RES' as prefix, file_name, size_bytes from library_files
          union all select 'ORD', concat(document_id, '.pdf'), cast(length(markdown) * 1000 as bigint) from markup_docs),
        planned as (select *, concat(prefix, '_', {_clean("file_name")}) as target_name from sources where {SUPPORTED})
        select prefix, file_name, size_bytes, target_name,
          case when target_name in (select concat('RES_', name) from stored) then 'skip'
               when {_suffix("file_name")} = '.pdf' and size_bytes / 1048576.0 > 2.0 then 'compress' else 'copy' end as action
        from planned""",
    "ingest_results": _from_fragments(
        f"""select file_name as source_file, concat('markdown/', stem, '.md') as markdown_path,
          concat('json/', stem, '.json') as json_path, coalesce(n, 0) as documents_created
        from (select file_name, {_stem("file_name")} as stem from (
                select concat(document_id, '.pdf') as file_name from markup_docs
                union all select file_name from ({_view(views.LIBRARY_FILES)}))) f
        left join (select document_id, count(*) as n from fragments group by document_id) c on c.document_id = f.stem""",
        f"{MARKUP_DOCS}, md as (select document_id, file_name, markdown from markup_docs)",
    ),
    "ingest_report": f"""with {LIBRARY}, results as ({_view(views.COPY_RESULTS)})
        select cast(count_if(status = 'compressed') as bigint) as compressed, cast(count_if(status in ('copied', 'timeout')) as bigint) as copied,
          cast(count_if(status = 'timeout') as bigint) as timeouts, cast(count_if(status = 'error') as bigint) as errors, cast(count_if(status = 'skipped') as bigint) as skipped,
          cast(sum(case status when 'error' then 0 when 'compressed' then comp_size when 'skipped' then comp_size
                   else orig_size end) as bigint) as total_bytes from results""",
    "copy_savings": f"""with {LIBRARY}, results as ({_view(views.COPY_RESULTS)})
        select *, case when status = 'compressed' and orig_size <> 0
                       then round((orig_size - comp_size) * 100.0::double / orig_size, 1) end as saved_percent from results""",
    "run_summary": f"""with {LIBRARY}, results as ({_view(views.RUN_RESULTS)})
        select cast(count_if(status = 'success') as bigint) as processed, cast(count_if(status = 'error') as bigint) as errors,
          cast(sum(case when status = 'success' then docs_created else 0 end) as bigint) as total_fragments,
          round(sum(seconds), 3) as total_seconds from results""",
    "ingest_errors": f"""with {LIBRARY}, loose as ({_view(views.LOOSE_PAGES)})
        select file_name as filename, 'error' as status, concat('Formato no soportado: ', {_suffix("file_name")}) as error
        from files where not {SUPPORTED}
        union all
        select coalesce(document_id, ''), 'error',
          case when document_id is null then 'Página sin documento' else 'Página sin número' end
        from loose where document_id is null or page_no is null""",
    "rejected_requests": f"""with odd as ({_view(views.ODD_REQUESTS)})
        select request_id, 'limit' as field, cast(request_limit as bigint) as value from odd where request_limit not between 1 and 100
        union all select request_id, 'page', page from odd where page < 1
        union all select request_id, 'page_size', page_size from odd where page_size not between 1 and 20""",
    "assemble_pages": f"with {PAGE_DOCS} select document_id, file_name, markdown from page_docs",
    "vector_heavy": f"""with {PAGE_DOCS}
        select document_id, count_if(page_no <= 10 and drawings > 150) > 0 as is_vector_heavy from page_texts group by document_id""",
    "select_extraction": f"""with {PAGE_DOCS},
        heavy as (select distinct document_id from page_texts where page_no <= 10 and drawings > 150),
        candidates as (
          select document_id, markdown as fallback,
            case when document_id in (select document_id from heavy) then ''
                 when cast(right(document_id, 6) as integer) % 4 = 0
                 then concat('# Acta', chr(10), '==> picture [1 x 1] intentionally omitted <==') else markdown end as structured
          from page_docs),
        cleaned as (
          select *, string_split_regex(replace(replace(replace(replace(structured, 'intentionally omitted', ''), 'picture', ''),
                    '==>', ''), '<==', ''), '\\r\\n|[\\n\\r\\v\\f]') as ls from candidates),
        sized as (
          select *, length({_strip("array_to_string(list_filter(ls, lambda l: regexp_matches(l, '\\S') and not regexp_matches(l, '^\\s*#')), '')")}) as n
          from cleaned)
        select document_id, n < 150 and length({_strip("fallback")}) > 300 as used_fallback,
          case when n < 150 and length({_strip("fallback")}) > 300 then fallback else structured end as markdown from sized""",
    "plain_texts": f"with {MARKUP_DOCS} select document_id, {_plain('markdown')} as content_text from markup_docs",
    "split_sections": f"""with {ALL_DOCS}, {SECTIONS}
        select document_id, cast(row_number() over (partition by document_id order by s) as integer) as sec_no, section, content
        from sections""",
    "fragments_of_markdown": _from_fragments("select * from fragments", ALL_DOCS),
    "fragments_of_pages": _from_fragments("select * from fragments"),
    "fragments_json_roundtrip": _from_fragments("select * from fragments"),
    "fragment_table_roundtrip": _from_fragments("select * from fragments"),
    "fragments_of_loose_pages": _from_fragments("select id, section, content_text from fragments", LOOSE_DOCS),
    "slim_index": _from_fragments("select * exclude (content_markdown) from fragments"),
    "search_haystacks": _from_fragments(
        """select id, md5(haystack) as haystack_md5, unnest(list_distinct(list_filter(string_split_regex(haystack, '\\s+'), lambda w: w <> ''))) as token
        from (select id, lower(concat(title, ' ', section, ' ', content_text)) as haystack from fragments)"""
    ),
    "viewer_fragments": _from_fragments(
        """select id, document_id, chunk_number, section, content_markdown, content_text,
        cast(length(content_markdown) as integer) as char_count from fragments"""
    ),
    "fragments_per_document": _from_fragments(
        "select document_id, count(*) as documents_created from fragments group by document_id", ALL_DOCS
    ),
    "noise_metrics": f"""with noisy as ({_view(views.NOISY_TEXTS)}),
        measured as (select document_id, part, {_noise("content_text")} from noisy)
        select *, {NOISY} as is_noisy from measured""",
    "document_noise": f"with noisy as ({_view(views.NOISY_TEXTS)}), {_document_noise('noisy')} select * from document_noise",
    "scanned_documents": f"""with noisy as ({_view(views.NOISY_TEXTS)}), {_document_noise('noisy')}
        select document_id from document_noise where is_noisy""",
    "scanned_markdown": f"""with noisy as ({_view(views.NOISY_TEXTS)}),
        measured as (select document_id, part, {_noise("content_text")} from noisy)
        select concat(document_id, '-', part) as document_id from measured where {NOISY}""",
    "search_terms": f"with {LONG_REQUESTS}, {_terms('long_requests')} select * from terms",
    "highlight_term_list": f"""with {LONG_REQUESTS}, {_terms('long_requests', highlight=True)}
        select query_id, pos, text, is_phrase from terms""",
    "search_global": SEARCH_HITS,
    "search_global_postings": SEARCH_HITS,
    "search_phrases": SEARCH_HITS.replace(_view(views.SEARCH_REQUESTS), _view(views.PHRASE_REQUESTS)),
    "live_index": _from_fragments("select id, document_id, section, chunk_number, content_text from live", extra=LIVE),
    "live_index_search": LIVE_HITS,
    "merged_index_search": LIVE_HITS,
    "search_single": _from_fragments(
        """select id, document_id, title, section, chunk_number, source, content_text, score from (
          select *, (least(n1, 5) + least(n2, 5)) * 10 + 20000 + n3 * 50000 as score from (
            select *, (length(h) - length(replace(h, 'of', ''))) // 2 as n1, (length(h) - length(replace(h, 'the', ''))) // 3 as n2,
              (length(h) - length(replace(h, 'of the', ''))) // 6 as n3
            from (select *, lower(concat(title, ' ', section, ' ', content_text)) as h from fragments)
            where contains(h, 'of') and contains(h, 'the')))
        order by score desc, chunk_number, document_id, id limit 100"""
    ),
    "search_filtered": _from_fragments(
        """select id, document_id, title, section, chunk_number, source, content_text,
            least((length(h) - length(replace(h, 'the', ''))) // 3, 5) * 10 + 10000 as score
        from (select *, lower(concat(title, ' ', section, ' ', content_text)) as h from fragments)
        where source = 'ORD_000005.md' and contains(h, 'the') order by score desc, chunk_number, document_id, id limit 100"""
    ),
    "search_document": _from_fragments("select request_id, id, chunk_number, section, score from found", extra=VIEWED),
    "fragment_page": _from_fragments(
        """select request_id, id, score, position, least(page, total_pages) as page, page_size, total, total_pages from paged
        where position > (least(page, total_pages) - 1) * page_size and position <= least(page, total_pages) * page_size""",
        extra=VIEWED,
    ),
    "page_totals": _from_fragments(
        """select r.request_id, least(r.page, greatest(1, cast(ceil(count(f.id) / r.page_size) as integer))) as page, r.page_size,
          count(f.id) as total, greatest(1, cast(ceil(count(f.id) / r.page_size) as integer)) as total_pages
        from view_requests r left join found f on f.request_id = r.request_id group by r.request_id, r.page, r.page_size""",
        extra=VIEWED,
    ),
    "fragment_page_of": _from_fragments(
        "select id, cast(greatest(1, ceil(chunk_number / 5)) as integer) as page from fragments"
    ),
    "hits_with_metadata": _from_fragments(
        """select query_id, rank, h.id, coalesce(k.title, nullif(h.title, ''), h.document_id) as display_title,
          coalesce(k.original_filename, h.source, '') as display_file
        from hits h left join (select id, min((title, original_filename)) as e, e[1] as title, e[2] as original_filename
                               from catalog group by id) k on k.id = h.document_id""",
        extra=f"{HITS}, {CATALOG}",
    ),
    "highlight_hits": _from_fragments(
        f"""select query_id, rank, id, case when regexp_matches(snippet, pattern)
              then regexp_replace({_escape_html("snippet")}, pattern, '<mark>\\1</mark>', 'g')
              else {_escape_html("snippet")} end as highlighted from shown""",
        extra=HIGHLIGHT,
    ),
    "highlight_fragments": _from_fragments(
        f"""select id, regexp_replace({_escape_html("content_text")}, '(?i)(of{MARK_SPACE}the|the|of)', '<mark>\\1</mark>', 'g')
            as highlighted from fragments"""
    ),
    "snippets": _from_fragments(
        f"""select id, concat(left(content_text, 300), '...') as snippet,
          concat({_strip("left(content_text, 140)")}, case when length(content_text) > 140 then '...' else '' end) as preview
        from fragments"""
    ),
    "upsert_fragments": _from_fragments(
        "select * from cur where id not in (select id from incoming) union all select * from incoming", extra=CURRENT
    ),
    "replace_documents": _from_fragments(
        """select * from cur where document_id not in (select document_id from incoming where chunk_number <= 5)
        union all select * from incoming where chunk_number <= 5""",
        extra=CURRENT,
    ),
    "client_errors": CLIENT_ERRORS,
    "stream_ingest": _from_fragments("select * from fragments"),
    "stream_ingest_pages": _from_fragments("select * from fragments"),
    "stream_uploads": _from_fragments(
        "select id, document_id, chunk_number, section, content_text from fragments", UPLOADED_DOCS
    ),
    "repeated_pages": _from_fragments(
        "select document_id, count(*) as n_fragments, count(distinct id) as n_ids, max(chunk_number) as last_number "
        "from fragments group by document_id",
        TWICE_DOCS,
    ),
    "repeated_bodies": f"""with {MARKUP_DOCS}
        select document_id as filename, 'error' as status, 'Documento repetido: 2' as error
        from markup_docs where document_id like '%_x'""",
    "stream_client_errors": CLIENT_ERRORS,
}
