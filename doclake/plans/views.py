"""Inputs of the registered queries, as views over the given tables.

Each view is one SQL text for both engines; ``{div}`` and ``{str}`` stand for
what they spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"div": "div", "str": "string"}
DUCKDB = {"div": "//", "str": "varchar"}

# Ten rows of ``documents`` are the pages of one document.
PAGE_TEXTS = """
select concat(case cast(doc_id {div} 10 as int) % 5 when 0 then 'ORD_' when 1 then 'RES_RC_'
              when 2 then 'RES_RA_' when 3 then 'ACTA_CONCEJO_' else 'CIRCULAR-' end,
              lpad(cast(doc_id {div} 10 as {str}), 6, '0')) as document_id,
       cast(doc_id % 10 as int) + 1 as page_no,
       case when doc_id % 7 = 0 then ''
            when doc_id % 2 = 0 then replace(text, chr(10), concat(chr(10), chr(10)))
            else text end as page_text,
       cast((doc_id * 37) % 160 as int) as drawings
from documents
union all
-- One document with three pages for every row: thousands of pages.
select 'CIRCULAR-999999' as document_id, cast(doc_id * 3 + k + 1 as int) as page_no,
       concat(source, ' ', lang, ' ', cast(n_chars as {str}), case when k = 1 then concat(chr(10), chr(10), '# Anexo ', source) else '' end) as page_text,
       0 as drawings
from documents cross join (values (0), (1), (2)) t(k)
"""

# One document per row, with headers of all levels and every kind of markup.
MARKUP_DOCS = """
select document_id, concat(document_id, '.md') as file_name, markdown from (
select concat('MARCO-', cast(doc_id as {str}), case when doc_id % 3 = 0 then '_rc.001a' else '_x' end) as document_id,
       concat('Intro ', source, chr(10), repeat('#', cast(doc_id % 7 as int) + 1), ' ', lang, ' *', source, '*', chr(10),
              text, chr(10), '```', chr(10), '# in a fence ', lang, chr(10), '```', chr(10),
              '`', source, '` [', lang, '](http://x/', cast(doc_id as {str}), ') ![i](p', cast(doc_id as {str}),
              ') **a**<BR/>b &lt;br&gt;c', chr(10), '##', chr(10), '## ', chr(10), '### Fin  ', chr(10), chr(10), chr(10),
              chr(9), '- x~y_z ORD-001', chr(13), chr(10),
              case when doc_id % 2 = 0 then replace(text, '. ', concat('.', chr(10), chr(10))) else text end) as markdown
from documents) d
"""

# Files named in several ways; pairs of rows share a name up to spelling.
LIBRARY_FILES = """
select concat('uploads/', name) as key, name as file_name, n_chars * 1000 as size_bytes from (
  select n_chars, concat(
    case when doc_id % 11 = 0 then concat(md5(cast(doc_id as {str})), '_') else '' end,
    case when doc_id % 2 = 0 then concat('Res-', cast(doc_id {div} 2 as {str}), '.pdf')
         when doc_id % 8 = 1 then concat('res_', cast(doc_id {div} 2 as {str}), '.PDF')
         when doc_id % 8 = 3 then concat('Res-', cast(doc_id {div} 2 as {str}), '.pdf.pdf')
         when doc_id % 8 = 5 then concat('RES ', cast(doc_id {div} 2 as {str}), '.docx')
         when doc_id % 16 = 7 then concat('notas ', cast(doc_id as {str}), '.txt')
         else concat('Acta Nº ', cast(doc_id as {str}), ' Resolución.pdf') end) as name
  from documents) x
union all
select concat('uploads/', document_id, '.pdf') as key, concat(document_id, '.pdf') as file_name,
       cast(count(*) * 700000 as bigint) as size_bytes
from (""" + PAGE_TEXTS + """) p group by document_id
"""

# The texts of these files; all pages of a document are its text.
LIBRARY_TEXTS = """
select file_name, text from (
  select text, concat(
    case when doc_id % 11 = 0 then concat(md5(cast(doc_id as {str})), '_') else '' end,
    case when doc_id % 2 = 0 then concat('Res-', cast(doc_id {div} 2 as {str}), '.pdf')
         when doc_id % 8 = 1 then concat('res_', cast(doc_id {div} 2 as {str}), '.PDF')
         when doc_id % 8 = 3 then concat('Res-', cast(doc_id {div} 2 as {str}), '.pdf.pdf')
         when doc_id % 8 = 5 then concat('RES ', cast(doc_id {div} 2 as {str}), '.docx')
         when doc_id % 16 = 7 then concat('notas ', cast(doc_id as {str}), '.txt')
         else concat('Acta Nº ', cast(doc_id as {str}), ' Resolución.pdf') end) as file_name
  from documents) x
union all
select concat(document_id, '.pdf') as file_name, page_text as text from (""" + PAGE_TEXTS + """) p
"""

# Pages as they may come in: some without a number, some without a document.
LOOSE_PAGES = """
select case when n % 17 = 0 then cast(null as {str}) else document_id end as document_id,
       case when n % 13 = 0 then cast(null as int) else page_no end as page_no, page_text, drawings
from (select *, cast(length(page_text) as int) as n from (""" + PAGE_TEXTS + """) p) q
"""

# Requests with legal and illegal limits, pages and page sizes.
ODD_REQUESTS = """
select conv_id * 1000 + turn as request_id, text as query,
       case cast(turn % 5 as int) when 0 then 0 when 1 then 101 when 2 then 500 when 3 then cast(null as int) else 10 end as request_limit,
       case cast(conv_id % 3 as int) when 0 then 0 when 1 then cast(null as int) else 4 end as page,
       case cast((conv_id + turn) % 4 as int) when 0 then 0 when 1 then 21 when 2 then 20 else cast(null as int) end as page_size
from conversations
"""

# Texts with rulings and scraps mixed in; several rows make one document.
NOISY_TEXTS = """
select concat('DOC-', cast(doc_id {div} 3 as {str})) as document_id, cast(doc_id % 3 as int) as part,
       case cast(doc_id % 5 as int)
            when 0 then text
            when 1 then concat(repeat('=', cast(doc_id % 97 as int)), ' ', text)
            when 2 then concat('| ', repeat('-_', cast(n_chars as int)), chr(10), text)
            when 3 then repeat('- ', cast(doc_id % 60 as int))
            else '  ' end as content_text
from documents
"""

# One view request per document.
VIEW_REQUESTS = """
select document_id as request_id, document_id,
       case n % 8 when 0 then 'the' when 1 then 'of the' when 2 then '"of the"' when 3 then 'de la'
            when 4 then '"de la" tion' when 5 then '' when 6 then '"of the" "and the"' else 'página 3' end as query,
       n % 4 + 1 as page, 5 as page_size
from (select distinct document_id, cast(right(document_id, 6) as int) as n from (""" + PAGE_TEXTS + """) p) d
"""

# Search strings: a list that covers the rules, and some out of every item of ``benchmark``.
SEARCH_REQUESTS = """
select cast(query_id as bigint) as query_id, query, 10 as request_limit from (values
  (1, 'the'), (2, 'of the'), (3, '"of the"'), (4, 'de la'), (5, 'que tion'), (6, '"de la" tion'),
  (7, '"of the" "and the"'), (8, 'THE  the'), (9, '"the'), (10, 'página 3'), (11, '   '), (12, '" " de la')
) v(query_id, query)
union all
select 1000 + item_id as query_id,
       case cast(item_id % 5 as int)
            when 0 then a
            when 1 then concat(a, ' ', b)
            when 2 then concat('"', a, ' ', b, '"')
            when 3 then concat('"', b, '" ', a, ' de ', a)
            else concat('THE ', b, '   la') end as query,
       cast(item_id % 20 + 1 as int) as request_limit
from (select item_id, regexp_extract(text, '^([a-zA-Z]+)', 1) as a,
             regexp_extract(text, '^[^ ]+ ([^ ]+)', 1) as b from benchmark) x
"""

# Quoted parts of every item of ``benchmark`` that begin and end inside a word, and the first words of each turn.
PHRASE_REQUESTS = """
select item_id as query_id, concat('"', right(a, 2), ' ', b, ' ', left(c, 2), '"') as query, 20 as request_limit
from (select item_id, regexp_extract(text, '^([a-zA-Z]+) ', 1) as a, regexp_extract(text, '^[a-zA-Z]+ ([a-zA-Z]+) ', 1) as b,
             regexp_extract(text, '^[a-zA-Z]+ [a-zA-Z]+ ([a-zA-Z]+)', 1) as c from benchmark) x
union all
select 100000 + conv_id * 1000 + turn as query_id, concat('"', right(a, 1), ' ', left(b, 2), '"') as query, 5 as request_limit
from (select conv_id, turn, regexp_extract(text, '([a-zA-Z]+) [a-zA-Z]+', 1) as a,
             regexp_extract(text, '[a-zA-Z]+ ([a-zA-Z]+)', 1) as b from conversations) x
"""

# Long search strings: every turn of every conversation.
LONG_REQUESTS = """
select conv_id * 1000 + turn as query_id,
       case cast(turn % 4 as int)
            when 0 then text
            when 1 then concat('"', text, '" ', role, ' de')
            when 2 then concat('  ÁRBOL  DE ', replace(text, ' de ', ' "De  la" '), ' "')
            else replace(text, ', ', ' " " ') end as query
from conversations
"""

# Results of an ingest run and of a copy run over the library.
RUN_RESULTS = """
select file_name as filename,
       case when size_bytes % 13000 = 0 then 'error' else 'success' end as status,
       cast(size_bytes % 9000 as double) / 1000 as seconds,
       size_bytes % 17 as docs_created
from library_files
"""

COPY_RESULTS = """
select file_name as filename,
       case cast((size_bytes {div} 1000) % 7 as int) when 0 then 'error' when 1 then 'timeout' when 2 then 'skipped'
            when 3 then 'copied' else 'compressed' end as status,
       size_bytes as orig_size, size_bytes {div} 2 + 1 as comp_size
from library_files
"""

CLIENT_REPORTS = """
select concat('user ', cast(user_id as {str})) as message, event_type as source,
       cast(event_id % 1000 as int) as lineno, 0 as colno, props as stack, ts
from events where event_type = 'error'
"""

TABLES = ["documents", "benchmark", "conversations", "events"]


class Views:
    """The views for one session and one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **named: DataFrame) -> DataFrame:
        text = text.format(**SPARK)
        inputs = {name: self.table(name) for name in TABLES if name in text} | named
        for name in inputs:
            text = text.replace(f"from {name}", f"from {{{name}}}")
        return self.spark.sql(text, **inputs)

    def documents(self) -> DataFrame:
        return self.table("documents")

    def page_texts(self) -> DataFrame:
        return self._sql(PAGE_TEXTS)

    def markup_docs(self) -> DataFrame:
        return self._sql(MARKUP_DOCS)

    def library_files(self) -> DataFrame:
        return self._sql(LIBRARY_FILES)

    def library_texts(self) -> DataFrame:
        return self._sql(LIBRARY_TEXTS)

    def loose_pages(self) -> DataFrame:
        return self._sql(LOOSE_PAGES)

    def odd_requests(self) -> DataFrame:
        return self._sql(ODD_REQUESTS)

    def noisy_texts(self) -> DataFrame:
        return self._sql(NOISY_TEXTS)

    def view_requests(self) -> DataFrame:
        return self._sql(VIEW_REQUESTS)

    def search_requests(self) -> DataFrame:
        return self._sql(SEARCH_REQUESTS).withColumnRenamed("request_limit", "limit")

    def phrase_requests(self) -> DataFrame:
        return self._sql(PHRASE_REQUESTS).withColumnRenamed("request_limit", "limit")

    def long_requests(self) -> DataFrame:
        return self._sql(LONG_REQUESTS)

    def run_results(self) -> DataFrame:
        return self._sql(RUN_RESULTS, library_files=self.library_files())

    def copy_results(self) -> DataFrame:
        return self._sql(COPY_RESULTS, library_files=self.library_files())

    def client_reports(self) -> DataFrame:
        return self._sql(CLIENT_REPORTS)
