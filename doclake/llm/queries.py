"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import (
    collocations,
    conversation_repair,
    decontamination,
    jaccard_join,
    line_dedup,
    maxscore,
    piece_transducer,
    projection_dedup,
    secrets,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
)
from doclake.llm.common import table
from doclake.session import new_shared_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

END_ID = 2


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[build.__name__] = build
    return build


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    files = token_files.read_tokens(spark, path)
    offsets = token_files.shard_offsets(files)
    found = token_files.checksums(files)
    return token_files.with_offsets(found, offsets).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = new_shared_path(spark, "ledger")
    docs = table(spark, sf_dir, "documents")
    secrets.scan(docs, ledger, path_col="doc_id")
    found = secrets.findings_by_path(docs, ledger, path_col="doc_id")
    # The ledger adds no spans of its own, so the spans are the base ones.
    return found.select(
        F.col("path").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
    )


_ASSIGN = "".join(
    (
        "(",
        "|".join(
            "_?".join("".join(f"[{c.upper()}{c}]" for c in part) for part in word.split("_?"))
            for word in ("password", "passwd", "secret", "token", "api_?key")
        ),
        ")",
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    )
)
_BASE_RULES = ((0, "assign", _ASSIGN, 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24))

LLM_ORACLES["op3_secret_scan"] = (
    "with docs as (select doc_id, coalesce(text, '') as text from documents), matches as ("
    + " union all ".join(
        f"""
  select doc_id, {n} as kind_no, '{kind}' as kind, {least} as least, string_split_regex(text, '{pattern}') as gaps,
         regexp_extract_all(text, '{pattern}') as hits, regexp_extract_all(text, '{pattern}', {group}) as parts
  from docs"""
        for n, kind, pattern, group, least in _BASE_RULES
    )
    + """),
pieces as (
  select doc_id, kind_no, kind, least, unnest(gaps[1:len(hits)]) as gap, unnest(hits) as hit, unnest(parts) as part,
         unnest(range(1, len(hits) + 1)) as n
  from matches),
placed as (
  select doc_id, kind_no, kind, hit, length(part) >= least as kept,
         sum(length(gap) + length(hit)) over (partition by doc_id, kind_no order by n) as stop
  from pieces),
spans as (
  select doc_id, kind_no, stop - length(hit) as start, concat(kind, ':', stop - length(hit), ':', stop) as span
  from placed where kept),
joined as (
  select doc_id, count(*) filter (where kind_no = 0) as n_assign, count(*) filter (where kind_no = 1) as n_access,
         count(*) filter (where kind_no = 2) as n_hex, string_agg(span, ',' order by start, kind_no) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join joined j on d.doc_id = j.doc_id
"""
)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc_version")


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract states the queries: every id that 20 divides, against all rows.
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


LLM_ORACLES["op5_top_k"] = """
with fit as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from fit q join fit c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


LLM_ORACLES["op9_line_dedup"] = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
rows as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as n from docs),
pairs as (
  select doc_id, n, line as a, lead(line) over (partition by doc_id order by n) as b from rows),
marked as (
  select doc_id, n, row_number() over (partition by a, b order by doc_id, n) > 1 as later
  from pairs where b is not null and (regexp_matches(a, '\S') or regexp_matches(b, '\S'))),
passages as (
  select doc_id, n, row_number() over (partition by line order by doc_id, n) > 1 as later
  from rows where len(regexp_extract_all(line, '\S+')) >= 50),
gone as (
  select r.doc_id, r.n, r.line, coalesce(x.later, false) or coalesce(y.later, false) or coalesce(p.later, false) as gone
  from rows r left join marked x on r.doc_id = x.doc_id and r.n = x.n
  left join marked y on r.doc_id = y.doc_id and r.n = y.n + 1
  left join passages p on r.doc_id = p.doc_id and r.n = p.n),
runs as (
  select *, n - row_number() over (partition by doc_id, gone order by n) as run from gone),
lengths as (select doc_id, run, count(*) as length from runs where gone group by doc_id, run),
per_doc as (select doc_id, count(*) as n_runs, max(length) as longest_run from lengths group by doc_id)
select g.doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, any_value(coalesce(p.n_runs, 0)) as n_runs,
       any_value(coalesce(p.longest_run, 0)) as longest_run,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from gone g left join per_doc p on g.doc_id = p.doc_id group by g.doc_id
"""


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.groups(table(spark, sf_dir, "documents"), size=3, threshold=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.byte_report(table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


LLM_ORACLES["op11_collocations"] = r"""
with docs as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from docs),
worded as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
placed as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from worded),
ones as (select lang, ws[i] as x, count(*) as n from placed group by all),
twos as (select lang, ws[i] as x, ws[i + 1] as y, count(*) as n from placed where i + 1 <= len(ws) group by all having count(*) >= 10),
threes as (
  select lang, ws[i] as x, ws[i + 1] as y, ws[i + 2] as z, count(*) as n from placed where i + 2 <= len(ws)
  group by all having count(*) >= 10),
total as (select lang, sum(n) as n from ones group by lang),
short as (
  select t.lang, concat(t.x, ' ', t.y) as phrase, t.n as a, l.n as l, r.n as r,
         cast(cast(1000000 as hugeint) * t.n * t.n // (cast(l.n as hugeint) * r.n) as bigint) as score
  from twos t join ones l on t.lang = l.lang and t.x = l.x join ones r on t.lang = r.lang and t.y = r.x
  where not exists (
    select 1 from threes h where h.lang = t.lang and 100 * h.n >= 50 * t.n
      and ((h.x = t.x and h.y = t.y) or (h.y = t.x and h.z = t.y)))),
cuts as (
  select t.lang, concat(t.x, ' ', t.y, ' ', t.z) as phrase, t.n as a, 1 as k, l.n as l, r.n as r
  from threes t join ones l on t.lang = l.lang and t.x = l.x
  join twos r on t.lang = r.lang and t.y = r.x and t.z = r.y
  union all
  select t.lang, concat(t.x, ' ', t.y, ' ', t.z), t.n, 2, l.n, r.n
  from threes t join twos l on t.lang = l.lang and t.x = l.x and t.y = l.y
  join ones r on t.lang = r.lang and t.z = r.x),
graded as (
  select *, cast(cast(1000000 as hugeint) * a * a // (cast(l as hugeint) * r) as bigint) as score from cuts),
long as (
  select lang, phrase, a, l, r, score from graded
  qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from (select * from short union all select * from long))
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, cast(t.n as bigint) as n, r.score
from ranked r join total t on r.lang = t.lang where r.rank <= 2000
"""


@query
def op12_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_copies(table(spark, sf_dir, "embeddings"))


# All pairs of a label: right at any size, and feasible on small tables only.
LLM_ORACLES["op12_projection_dedup"] = """
with recursive rows as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
fit as (
  select * from rows
  where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
lowest as (select x, min(y) as y from reach group by x),
degree as (select x, count(*) as n from links group by x)
select r.vec_id, coalesce(d.n, 0) as n_links, least(r.vec_id, coalesce(w.y, r.vec_id)) as component_id,
       r.vec_id = least(r.vec_id, coalesce(w.y, r.vec_id)) as kept
from rows r left join lowest w on r.vec_id = w.x left join degree d on r.vec_id = d.x
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
