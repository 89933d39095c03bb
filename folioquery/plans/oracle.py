"""SQL that must give the rows of the core's queries, for an engine with the
tables as views."""

from __future__ import annotations

from folioquery.functions.text import BULLETS, DESCRIBED, DROPPED, QUERY_KINDS, REPLACED, STOP_WORDS, SUGGESTED
from folioquery.operators.chunking import ABBREVIATIONS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
BLOCKS = """
b as (
  select * from content_blocks where document_id is not null and block_id is not null
  qualify row_number() over (partition by document_id, block_id order by block_key desc) = 1)"""
POSTS = """
p as (
  select term, document_id, block_id, max(positions) as positions, max(term_frequency) as tf from search_terms
  where term is not null and term <> '' and document_id is not null and block_id is not null group by all)"""
STATS = """
s as (
  select document_id, max(total_terms) as total_terms, max(unique_terms) as unique_terms, max(avg_block_length) as avg_block_length
  from document_stats where document_id is not null group by 1)"""
CORPUS = """
c as (
  select count(*) as total_documents, avg(total_terms) as avg_doc_length, coalesce(avg(case when avg_block_length > 0 then avg_block_length end), 100e0) as avg_block_length from s)"""
EMBEDDABLE = "type in ('text', 'heading', 'custom') and trim(coalesce(content, '')) <> ''"
KEYS = "k as (select distinct document_id, block_id from vectors where vector is not null and document_id is not null)"


def tokens(text: str, stop: bool = True) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 2)"
    return f"list_filter({kept}, lambda w: w not in ({STOP}))" if stop else kept


def estimate(text: str) -> str:
    spaces = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    n = lambda p: f"len(regexp_extract_all({text}, '{p}'))"
    raw = f"(strlen({text}) / 4e0 - {n(spaces)} * 0.125e0 + {n('\\p{P}')} * 0.3e0 - {n('\\p{Nd}')} * 0.05e0)"
    return f"(case when coalesce({text}, '') = '' then 0 when {raw} < 1 then 1 else floor({raw} + 0.5e0) end)::int"


def bm25(queries: str, times: str = "count(*)") -> str:
    return f"""
{POSTS}, {STATS}, {CORPUS},
t as (select query_id, term, {times} as times from (select query_id, unnest({tokens('query_text')}) as term from {queries}) group by all),
df as (select term, count(distinct document_id) as df from p group by 1),
w as (
  select term, p.document_id, p.block_id, coalesce(tf, 0) as tf, coalesce(len(positions), 0) as n, df, total_documents,
    case when s.avg_block_length > 0 then s.avg_block_length when c.avg_block_length > 0 then c.avg_block_length else avg_doc_length / 10 end as avg
  from p join s using (document_id) join df using (term), c),
x as (select *, case when tf > 0 then n / tf else n end as size from w),
m as (
  select query_id, document_id, block_id, round(sum(times * ln((total_documents - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * size / avg))), 9) as score
  from t join x using (term) group by all)"""


def top(rows: str, n: int, by: str = "score", extra: str = "") -> str:
    return f"select query_id, document_id, block_id, round({by}, 6) as score, r as rank{extra} from (select *, row_number() over (partition by query_id order by {by} desc, document_id, block_id) as r from {rows}) where r <= {n}"


def kind() -> str:
    q = "lower(trim(coalesce(query_text, '')))"
    cases = []
    for k, patterns in QUERY_KINDS.items():
        hit = " or ".join(f"regexp_matches({q}, '{p}')" for p in patterns)
        cases.append(f"when {hit} then '{k}'")
    return f"case {' '.join(cases)} else 'unknown' end"


def stem(w: str) -> str:
    rules = [tuple(r.split(":")) for r in REPLACED.split()] + [(s, "") for s in DROPPED.split()]
    cases = " ".join(f"when suffix({w}, '{e}') and strlen({w}) >= {len(e) + 2} then left({w}, length({w}) - {len(e)}) || '{to}'" for e, to in rules)
    return f"case when strlen({w}) <= 3 then {w} {cases} else {w} end"


def mapped(table: dict[str, str], key: str) -> str:
    return f"case {' '.join(f"when {key} = '{k}' then '{v}'" for k, v in table.items())} end"


HITS = """
best as (
  select query_id, branch, document_id, block_id, max(score) as score from search_hits
  where score is not null and not isnan(score) and not isinf(score) group by all),
kw as (select * from best where branch = 'keyword'), ve as (select * from best where branch = 'vector')"""
FUSED = f"""
{HITS},
k as (select *, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from kw),
v as (select *, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from ve),
j as (
  select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.document_id, v.document_id) as document_id, coalesce(k.block_id, v.block_id) as block_id,
    k.score as ks, v.score as vs, k.r as kr, v.r as vr
  from k full join v on k.query_id = v.query_id and k.document_id = v.document_id and k.block_id = v.block_id),
f as (
  select *, coalesce(kr, count(kr) over (partition by query_id) + 1) as keyword_rank, coalesce(vr, count(vr) over (partition by query_id) + 1) as vector_rank from j)"""
CUT = FUSED.replace("from kw)", "from kw qualify r <= 20)").replace("from ve)", "from ve qualify r <= 20)")
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+'), lambda w: w <> '')"


def embedded(rows: str, keys: str, text: str) -> str:
    """Signed counts of hashed words by dimension, and their length."""
    hashed = f"select {keys}, md5_number_upper(w) as h from (select {keys}, unnest({WORDS.format(text)}) as w from {rows})"
    return f"select *, sqrt(sum(v * v) over (partition by {keys})) as norm from (select {keys}, (h % 64)::int as dim, sum(case when h >= 9223372036854775808 then 1 else -1 end)::double as v from ({hashed}) group by all)"


def whole(limit: int, kept: str = "true", mode: str = "hybrid") -> str:
    """f: the hits of both branches in the documents kept, fused; raw is their sum."""
    near = f"""
bd as ({embedded(f"(select * from b where {EMBEDDABLE})", "document_id, block_id, block_key", "content")}),
qd as ({embedded("(select * from search_queries where trim(coalesce(query_text, '')) <> '')", "query_id", "query_text")}),
z as (
  select query_id, document_id, block_id, block_key, round(sum(q.v * x.v) / any_value(q.norm * x.norm), 9) as score
  from qd q join bd x using (dim) where q.norm > 0 and x.norm > 0 group by all having {kept}),
ve as (select * from z where score >= 1e-6 qualify row_number() over (partition by query_id order by score desc, block_key) <= {2 * limit})"""
    return f"""{bm25('search_queries')}, {BLOCKS}, {near},
k as (select *, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from m where {kept} qualify r <= {2 * limit}),
v as (select query_id, document_id, block_id, score, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from ve),
j as (
  select coalesce(k.query_id, v.query_id) as query_id, coalesce(k.document_id, v.document_id) as document_id, coalesce(k.block_id, v.block_id) as block_id, k.r as kr, v.r as vr
  from k full join v on k.query_id = v.query_id and k.document_id = v.document_id and k.block_id = v.block_id),
f as (
  select query_id, document_id, block_id, 0.5e0 / (60 + coalesce(kr, count(kr) over (partition by query_id) + 1)) + 0.5e0 / (60 + coalesce(vr, count(vr) over (partition by query_id) + 1)) as raw from j),
n as (select query_id, document_id, block_id, round(raw / max(raw) over (partition by query_id), 9) as score from f)"""


AROUND = """
o as (select *, row_number() over (partition by document_id order by sequence, block_id) as at from b),
ar as (select x.document_id, x.block_id, string_agg(y.block_id, ',' order by y.at) as context, sum({0})::bigint as near from o x join o y on x.document_id = y.document_id and y.at between x.at - 1 and x.at + 1 group by all)"""
STATUS = f"""
{BLOCKS}, {KEYS},
st as (
  select document_id, count(*) filter ({EMBEDDABLE}) as embeddable, count(*) filter (({EMBEDDABLE}) and k.block_id is not null) as embedded
  from b left join k using (document_id, block_id) group by 1)"""
USABLE = """
u as (
  select distinct on (vec_id) vec_id, document_id, model, vector::double[] as vector from vectors
  where vec_id is not null and vector is not null and ((model = 'quill-embed-96' and len(vector) = 96) or (model = 'quill-embed-64' and len(vector) = 64))
    and list_bool_and(list_transform(vector, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(vector, lambda x: x <> 0)))"""


def nearest(pool: str, k: int, least: float = -1.0) -> str:
    return f"""
with {USABLE},
z as (
  select a.vec_id as query_id, v.vec_id, round(list_cosine_similarity(a.vector, v.vector), 9) as sim
  from u a join {pool} v on a.model = v.model and a.vec_id <> v.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from z where sim >= {least}e0)
select query_id, vec_id, round(sim, 6) as similarity, rank from r where rank <= {k}"""


NORM = "trim(translate(regexp_replace(lower({0}), '\\s+', ' ', 'g'), '.,!?;:\"''()[]{{}}', ''))"
NUMBERED = r"^(\d+[.)]\s|[(]\d+[)]\s|[a-z][.)]\s)"
IN_SOURCES = "(source in ('crm_notes', 'wiki_export') or format in ('crm_notes', 'wiki_export'))"
TAGS = "tags as (select document_id, unnest([{'k': 'lang', 'v': lang}, {'k': 'format', 'v': format}, {'k': 'batch', 'v': batch_no::varchar}]) as t from documents)"

AGAIN = "coalesce(batch_no, 0) = 0 and doc_id % 10 = 0"

P5 = """
with c as (select source, max(cutoff_at) as cutoff from import_runs where status = 'success' group by 1),
d as (
  select doc_id, text, d.source, cutoff, greatest(imported_at, updated_at) as t,
    case when external_id is null or external_id = '' then 'd:' || doc_id else 'e:' || external_id end as record
  from documents d left join c on d.source = c.source),
o as (select *, t is null or cutoff is null or t > cutoff as open from d),
r as (select *, row_number() over (partition by source, record, open order by (t is null) desc, t desc, doc_id desc) as r from o)
select a.doc_id from r a left join r b on a.source is not distinct from b.source and a.record = b.record and b.r = 1 and not b.open
where a.r = 1 and a.open and not (b.doc_id is not null and a.text is not distinct from b.text)"""

CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(128, 160))
WS = "[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]"
INK = WS.replace("[", "[^", 1)


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def windows(begin: str, stop: str, after: str) -> str:
    """Chunks of every text by a step: from ``at``, where one stops, and where the
    next begins."""
    return f"""
with recursive t as (select doc_id, text, length(text) as n from documents where regexp_matches(text, '{INK}')),
w as (
  select doc_id, text, n, fr, {stop} as stop from (select *, {begin} as fr from t)
  union all
  select doc_id, text, n, fr, {stop} as stop from (select doc_id, text, n, {after} as fr from w where stop < n))"""


def last_of(pattern: str, part: str) -> str:
    """Characters of a part before the last place of a pattern; null without one."""
    return f"case when regexp_matches({part}, '{pattern}') then length(regexp_extract({part}, '(?s)^(.*)({pattern})', 1)) end"


def cut_before(end: str) -> str:
    part = f"substr(text, greatest(fr, {end} - 500) + 1, {end} - greatest(fr, {end} - 500))"
    marks = {r"\n\n": 2, r"\. ": 2, r"\.\n": 2, r"\n": 1, " ": 1}
    return f"greatest(fr, {end} - 500) + coalesce({', '.join(f'{last_of(m, part)} + {k}' for m, k in marks.items())})"


def greedy(rows: str, keys: list[str], order: str, limit: int, alone: bool) -> str:
    """g: rows with the number of their greedy group."""
    big = f"o.tokens > {limit}" if alone else "false"
    same = " and ".join(f"o.{k} is not distinct from g.{k}" for k in keys)
    return f"""
o as (select *, row_number() over (partition by {', '.join(keys)} order by {order}) as i from {rows}),
g as (
  select o.*, 0::bigint as chunk, case when {big} then {limit + 1} else o.tokens end as used from o where i = 1
  union all
  select o.*, case when {big} or g.used + o.tokens > {limit} then g.chunk + 1 else g.chunk end, case when {big} then {limit + 1} when g.used + o.tokens > {limit} then o.tokens else g.used + o.tokens end
  from g join o on {same} and o.i = g.i + 1)"""


def tail(text: str, size: int) -> str:
    e = f"right({text}, {size})"
    word = f"length(regexp_extract({e}, '^({INK}+){WS}', 1))"
    whole = f"length({text}) <= {size} or {word} = 0 or 2 * {word} >= length({e}) - length({e}) % 2"
    return f"case when {whole} then {e} else {strip(f'substr({e}, {word} + 1)')} end"


def merged(units: str, limit: int, lap: int) -> str:
    """Chunks of units ``q`` (doc_id, text, pi, ui, u), joined greedily with an overlap."""
    return f"""
with recursive {units},
o as (select doc_id, text, {strip('u')} as u, {estimate(strip('u'))} as n, row_number() over (partition by doc_id order by pi, ui) as i from q where regexp_matches(u, '{INK}')),
g as (
  select doc_id, text, i, u as held, strpos(text, u) - 1 as bg, strpos(text, u) - 1 + length(u) as ed, null::varchar as body, 0::bigint as b0, 0::bigint as b1 from o where i = 1
  union all
  select doc_id, text, i, case when full_ then case when lap <> '' then lap || '  ' || u else u end else held || ' ' || u end as held,
    case when not full_ then bg when lap <> '' or found = 0 then ed else ed + found - 1 end as bg, case when found > 0 then ed + found - 1 + length(u) else ed end as ed,
    case when full_ then {strip('held')} end as body, bg as b0, ed as b1
  from (
    select g.doc_id, g.text, o.i, o.u, g.held, g.bg, g.ed, {estimate('g.held')} + o.n > {limit} as full_, {tail(strip('g.held'), 4 * lap)} as lap, strpos(substr(g.text, g.ed + 1), o.u) as found
    from g join o on o.doc_id = g.doc_id and o.i = g.i + 1)),
e as (
  select doc_id, i, body, b0, b1 from g where body is not null
  union all select doc_id, i + 1, {strip('held')}, bg, ed from g where i = (select max(i) from o where o.doc_id = g.doc_id))
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_idx, body as content, b0::int as start_idx, b1::int as end_idx, {estimate('body')} as token_count from e"""


PARAGRAPHS = f"""
p as (select doc_id, text, unnest(regexp_split_to_array(text, E'\\n\\n')) as p, generate_subscripts(regexp_split_to_array(text, E'\\n\\n'), 1) as pi from documents where regexp_matches(text, '{INK}')),
s as (select doc_id, text, pi, case when {estimate(strip('p'))} > 200 then regexp_split_to_array({strip('p')}, E'\\n') else [{strip('p')}] end as l from p),
q as (select doc_id, text, pi, unnest(l) as u, generate_subscripts(l, 1) as ui from s)"""
ABBREVIATED = "(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")$"
SENTENCES = f"""
ch as (select doc_id, text, unnest(generate_series(1, length(text))) as i from documents where regexp_matches(text, '{INK}')),
cut as (
  select doc_id, text, i from ch where contains('.!?', text[i]) and (i = length(text) or not (regexp_matches(text[i + 1], '\\p{{L}}')
    or (text[i] = '.' and regexp_matches(lower({strip('substr(text, greatest(i - 8, 1), i - greatest(i - 8, 1) + 1)')}), '{ABBREVIATED}')))) union select doc_id, text, length(text) from ch),
q as (select doc_id, text, i as pi, 0 as ui, substr(text, coalesce(lag(i) over w, 0) + 1, i - coalesce(lag(i) over w, 0)) as u from cut window w as (partition by doc_id order by i))"""


SQL = {
    "block_split": """
with l as (select doc_id, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '[^\\s\\p{Z}]')) as l from documents where text is not null),
e as (select doc_id, unnest(l) as content, generate_subscripts(l, 1) - 1 as sequence from l)
select doc_id, sequence, printf('blk_%05d', sequence + 1) as block_id, regexp_replace(content, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as content from e""",
    "tokenize": f"""
with {BLOCKS}, t as (select document_id, block_id, {tokens('content')} as l from b where coalesce(type, 'text') <> 'image')
select document_id, block_id, generate_subscripts(l, 1) - 1 as position, unnest(l) as token from t""",
    "stem_vocab": f"""
with {BLOCKS}, t as (select distinct unnest({tokens('content', False)}) as word from b where coalesce(type, 'text') <> 'image')
select word, {stem('word')} as stem from t""",
    "postings": f"""
with {BLOCKS}, t as (select document_id, block_id, {tokens('content')} as l from b where coalesce(type, 'text') <> 'image'),
e as (select document_id, block_id, len(l) as n, generate_subscripts(l, 1) - 1 as position, unnest(l) as term from t)
select term, document_id, block_id, string_agg(position::varchar, ',' order by position) as positions, round(count(*)::double / any_value(n), 6) as tf from e group by term, document_id, block_id""",
    "postings_stemmed": f"""
with {BLOCKS}, t as (select document_id, block_id, {tokens('content')} as l from b where coalesce(type, 'text') <> 'image'),
e as (select document_id, block_id, len(l) as n, generate_subscripts(l, 1) - 1 as position, unnest(l) as w from t), s as (select *, {stem('w')} as term from e)
select term, document_id, block_id, string_agg(position::varchar, ',' order by position) as positions, round(count(*)::double / any_value(n), 6) as tf from s group by term, document_id, block_id""",
    "relative_position": f"""
with {BLOCKS} select document_id, block_id, round(100e0 * (row_number() over (partition by document_id order by sequence, block_id) - 1) / count(*) over (partition by document_id), 6) as percent from b""",
    "doc_stats": f"""
with {BLOCKS}, t as (select document_id, unnest({tokens('content')}) as term from b where coalesce(type, 'text') <> 'image'),
g as (select document_id, count(*) as n, count(distinct term) as u from t group by 1), a as (select document_id, count(*) as blocks from b group by 1)
select document_id, coalesce(n, 0) as total_terms, coalesce(u, 0) as unique_terms, round(coalesce(n, 0)::double / blocks, 6) as avg_block_length from a left join g using (document_id)""",
    "corpus_stats": f"with {STATS}, {CORPUS} select total_documents, round(avg_doc_length, 6) as avg_doc_length, round(avg_block_length, 6) as avg_block_length from c",
    "doc_frequency": f"with {POSTS} select term, count(distinct document_id) as df from p group by 1",
    "keywords_topn": f"""
with {BLOCKS}, t as (select document_id, unnest(list_filter({tokens('content')}, lambda w: strlen(w) >= 3)) as keyword from b),
g as (select document_id, keyword, count(*) as n from t group by all)
select document_id, keyword, n, row_number() over (partition by document_id order by n desc, keyword) as rank from g qualify rank <= 5""",
    "section_propagation": f"""
with {BLOCKS} select document_id, block_id, case when coalesce(is_heading, false) then null else
  last_value(case when coalesce(is_heading, false) then content end ignore nulls) over (partition by document_id order by sequence, block_id rows between unbounded preceding and 1 preceding) end as section from b""",
    "keyword_scope": f"""
with {BLOCKS}, h as (select *, max(coalesce(is_heading, false)::int) over (partition by document_id order by sequence, block_id rows between 5 preceding and 1 preceding) as near from b)
select document_id, block_id, case when coalesce(is_heading, false) then 'document' when near = 1 then 'own' end as scope from h""",
    "page_estimate": """
with l as (select doc_id, greatest(coalesce(page_count, 1), 1) as pages, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '[^\\s\\p{Z}]')) as l from documents where text is not null),
e as (select doc_id, pages, len(l) as total, generate_subscripts(l, 1) - 1 as sequence from l)
select doc_id, sequence, least(sequence // greatest(total // pages, 1) + 1, pages)::int as page, 720e0 - (sequence % 46) * 14e0 as y from e""",
    "heading_detect": f"""
with {BLOCKS}, x as (select *, trim(coalesce(content, '')) as t, strlen(trim(coalesce(content, ''))) as n from b)
select document_id, block_id,
  n > 0 and (coalesce(font.size, 0) >= 14 or (coalesce(font.bold, false) and n < 200) or (regexp_matches(t, '^[\\d.]+\\s+[A-Z]') and n < 150)
    or (n < 100 and n > 3 and regexp_matches(t, '\\p{{L}}') and upper(t) = t) or regexp_matches(t, '^(Chapter|Section|Part|CHAPTER|SECTION|PART)\\s+\\d+')) as heading,
  n > 0 and (coalesce(font.size, 0) > 14 or contains(lower(coalesce(font.name, '')), 'bold') or (n > 3 and n < 100 and upper(t) = t)) as page_heading from x""",
    "heading_level": f"""
with {BLOCKS}, x as (select *, coalesce(font.size, 0) as z, lower(coalesce(font.name, '')) as f from b)
select document_id, block_id, case when z >= 24 then 1 when z >= 20 then 2 when z >= 16 then 3 when z >= 14 then 4 when z >= 12 and regexp_matches(f, 'bold|black|heavy') then 5 else 6 end as level,
  regexp_matches(f, 'italic|oblique') as italic from x""",
    "list_detect": f"""
with {BLOCKS}, x as (select *, trim(coalesce(content, '')) as t from b)
select document_id, block_id, t <> '' and (contains('{BULLETS}', left(t, 1)) or regexp_matches(t, '{NUMBERED}')) as item from x""",
    "query_type": f"with q as (select query_id, {kind()} as kind from search_queries) select query_id, kind, {mapped(SUGGESTED, 'kind')} as mode, {mapped(DESCRIBED, 'kind')} as description from q",
    "snippets": f"""
with {BLOCKS}, x as (select *, strpos(lower(content), 'the') as pos, length(content) as n from b), y as (select *, greatest(pos - 50, 1) as s, least(pos + 103, n + 1) as e from x)
select document_id, block_id, case when pos > 0 then regexp_replace((case when s > 1 then '...' else '' end) || substr(content, s, e - s) || (case when e <= n then '...' else '' end), '(the)', '<b>\\1</b>', 'gi')
  when n > 200 then left(content, 200) || '...' else content end as snippet from y""",
    "highlights": "select doc_id, regexp_replace(case when length(text) > 200 then left(text, 200) || '...' else text end, '(contract|annual|report)', '<b>\\1</b>', 'gi') as snippet from documents",
    "normalize_text": f"with {BLOCKS} select document_id, block_id, {NORM.format('content')} as text from b",
    "token_estimate": f"select doc_id, {estimate('text')} as tokens from documents",
    "token_truncate": f"""
with e as (select doc_id, text, {estimate('text')} as est from documents), c as (select *, left(text, floor(length(text) * (40e0 / nullif(est, 0)) * 0.95e0)::int) as cut from e),
w as (select *, regexp_replace(cut, '\\s\\S*$', '') as whole from c)
select doc_id, case when est <= 40 then text else trim(case when length(whole) > floor(length(text) * (40e0 / nullif(est, 0)) * 0.95e0)::int // 2 then whole else cut end) || '...' end as text from w""",
    "token_budget": f"""
with {BLOCKS}, x as (select document_id, block_id, sequence, {estimate('content')} + {estimate('section')} as tokens from b)
select document_id, block_id, (sum(tokens) over w)::bigint as used, (sum(tokens) over w) <= 60 as kept from x window w as (partition by document_id order by sequence, block_id rows unbounded preceding)""",
    "text_hash": f"with {BLOCKS} select document_id, block_id, left(sha256(content), 16) as text_hash from b",
    "word_excerpt": f"""
with {BLOCKS}, x as (select document_id, block_id, regexp_split_to_array(trim(content), '\\s+') as w from b)
select document_id, block_id, '...' || array_to_string(w[2:6], ' ') || (case when len(w) > 6 then '...' else '' end) as excerpt from x""",
    "file_formats": """
select doc_id, case when regexp_matches(lower(coalesce(original_path, name)), '\\.(pdf|docx)$') then regexp_extract(lower(coalesce(original_path, name)), '\\.(pdf|docx)$', 1) end as kind,
  coalesce(nullif(external_id, ''), 'none') as external, null::varchar as image from documents""",
    "filter_sources": "select doc_id from documents where source in ('crm_notes', 'pdf') or format in ('crm_notes', 'pdf')",
    "filter_tags_and": "select doc_id from documents where lang = 'en' and format = 'pdf'",
    "filter_tags_negated": "select doc_id from documents where (lang is null or lang <> 'en') and format = 'pdf'",
    "filter_dsl": "select doc_id from documents where format in ('pdf', 'docx') and created_at >= '2025-06-01' and created_at <= '2026-03-01' and page_count between 2 and 40",
    "filter_has_embeddings": "select doc_id from documents d where exists (select 1 from vectors v where v.document_id = d.document_id)",
    "block_filters": f"with {BLOCKS} select document_id, block_id from b where page between 1 and 2 and type in ('text', 'list')",
    "search_filtered": f"with {bm25('search_queries')}, f as (select m.* from m where document_id in (select document_id from documents where {IN_SOURCES})) {top('f', 5)}",
    "bm25_topk": f"with one as (select 0::bigint as query_id, 'the annual report and the legal contract' as query_text), {bm25('one')} {top('m', 20)}",
    "bm25_batch": f"with {bm25('search_queries')} {top('m', 10)}",
    "bm25_heading_boost": f"with {bm25('search_queries')}, {BLOCKS}, h as (select m.query_id, m.document_id, m.block_id, round(m.score * case when coalesce(is_heading, false) then 1.5e0 else 1 end, 9) as score from m join b using (document_id, block_id)) {top('h', 10)}",
    "bm25_min_score": f"with {bm25('search_queries')}, {BLOCKS}, h as (select m.query_id, m.document_id, m.block_id, round(m.score * case when coalesce(is_heading, false) then 1.5e0 else 1 end, 9) as score from m join b using (document_id, block_id) where m.score >= 1) {top('h', 10)}",
    "boolean_search": f"""
with {POSTS} select document_id, block_id from p group by 1, 2
having bool_or(term = 'sheet') and bool_or(term = 'copy') and not bool_or(term = 'manual')""",
    "phrase_search": f"""
with {POSTS} select distinct x.document_id, x.block_id from p x join p y using (document_id, block_id)
where x.term = 'belongs' and y.term = 'to' and len(list_intersect(list_transform(x.positions, lambda i: i + 1), y.positions)) > 0""",
    "knn_batch": nearest("u", 5),
    "knn_min_similarity": nearest("u", 10, 0.8),
    "knn_filtered": nearest(f"(select * from u where document_id in (select document_id from documents where {IN_SOURCES}))", 5),
    "rrf_fusion": f"with {FUSED} select query_id, document_id, block_id, keyword_rank, vector_rank, round(0.5e0 / (60 + keyword_rank) + 0.5e0 / (60 + vector_rank), 9) as score from f",
    "weighted_fusion": f"with {FUSED} select query_id, document_id, block_id, round(0.3e0 * coalesce(ks, 0) + 0.7e0 * coalesce(vs, 0), 6) as score from f",
    "fused_lists": f"""
with {CUT}, s as (select *, 0.5e0 / (60 + keyword_rank) + 0.5e0 / (60 + vector_rank) as raw from f),
n as (select query_id, document_id, block_id, round(raw / max(raw) over (partition by query_id), 9) as score from s), c as (select * from n where score >= 0.2e0) {top('c', 10)}""",
    "score_normalize": f"with {HITS} select branch, query_id, document_id, block_id, round(case when max(score) over (partition by query_id, branch) > 0 then score / max(score) over (partition by query_id, branch) else score end, 6) as score from best",
    "diversify": f"""
with {HITS}, k as (select *, row_number() over (partition by query_id, branch order by score desc, document_id, block_id) as rank from best)
select branch, query_id, document_id, block_id, rank from k qualify row_number() over (partition by query_id, branch, document_id order by score desc, block_id) <= 2""",
    "citations": f"""
with {HITS} select branch, query_id, document_id, block_id, '[' || row_number() over (partition by query_id, branch order by score desc, document_id, block_id) || ']' as citation from best""",
    "hybrid_search": f"""
with {whole(10)}, {AROUND.format('0')},
h as (select *, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from n where score >= 0.2e0 qualify r <= 10),
h2 as (select * from h qualify row_number() over (partition by query_id, document_id order by score desc, block_id) <= 2),
i as (select document_id, section, string_agg(distinct 'images/' || document_id || '_' || block_id || '.png', ',' order by 'images/' || document_id || '_' || block_id || '.png') as images from b where type = 'image' and section <> '' group by all),
hx as (
  select h2.*, b.content, b.page, b.section, q.query_text as t, strpos(lower(b.content), lower(q.query_text)) as pos, length(b.content) as len, d.source, d.lang, ar.context, coalesce(i.images, '') as images
  from h2 join b using (document_id, block_id) join (select query_id, min(query_text) as query_text from search_queries group by 1) q using (query_id) join ar using (document_id, block_id)
  left join documents d using (document_id) left join i on i.document_id = h2.document_id and i.section = b.section),
y as (select *, greatest(pos - 50, 1) as s, least(pos + length(t) + 100, len + 1) as e from hx)
select query_id, document_id, block_id, round(score, 6) as score, r as rank, page, section, source, lang, context, images,
  case when pos > 0 and t <> '' then (case when s > 1 then '...' else '' end) || substr(content, s, e - s) || (case when e <= len then '...' else '' end)
    when len > 200 then left(content, 200) || '...' else content end as snippet from y""",
    "agent_search": f"""
with {whole(5)}, {AROUND.format(estimate('y.content'))},
h as (select *, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from n qualify r <= 5),
q as (select query_id, {kind()} as kind from (select query_id, min(query_text) as query_text from search_queries group by 1)),
hx as (select h.*, q.kind, {estimate('b.content')} + ar.near as tokens from h join b using (document_id, block_id) join ar using (document_id, block_id) join q using (query_id))
select query_id, kind, {mapped(SUGGESTED, 'kind')} as mode, '[' || r || ']' as citation, document_id, block_id, tokens::int as tokens, (sum(tokens) over (partition by query_id))::bigint as total_tokens from hx""",
    "search_in_document": f"with {whole(3, 'document_id = (select min(document_id) from b)')} {top('n', 3)}",
    "semantic_search": f"with {whole(5)} {top('(select query_id, document_id, block_id, score / max(score) over (partition by query_id) as score from ve)', 5)}",
    "search_diagnostics": f"""
with {whole(10)}, l as (select *, row_number() over (partition by query_id order by score desc, document_id, block_id) as r from n),
al as (select query_id, count(*) filter (r <= 10) as n_all from l group by 1), g as (select query_id, least(count(*), 10) as returned from n where score >= 0.6e0 group by 1)
select q.query_id, coalesce((select count(*) from k where k.query_id = q.query_id), 0)::bigint as keyword_results, coalesce((select count(*) from v where v.query_id = q.query_id), 0)::bigint as vector_results,
  coalesce(g.returned, 0)::bigint as returned, (coalesce(n_all, 0) - coalesce(g.returned, 0))::bigint as filtered_by_score
from (select distinct query_id from search_queries) q left join al on al.query_id = q.query_id left join g on g.query_id = q.query_id""",
    "context_window": f"""
with {BLOCKS} select document_id, block_id, coalesce(string_agg(block_id, ',') over (w rows between 2 preceding and 1 preceding), '') as before, coalesce(string_agg(block_id, ',') over (w rows between 1 following and 2 following), '') as after
from b window w as (partition by document_id order by sequence, block_id)""",
    "metadata_join": f"""
with {HITS} select branch, query_id, best.document_id, block_id, d.name as document_name, d.source, d.external_id, d.lang from best left join documents d on d.document_id = best.document_id""",
    "image_blocks": f"with {BLOCKS} select document_id, block_id, 'images/' || document_id || '_' || block_id || '.png' as images from b where type = 'image' and section is not null",
    "chunk_tokens": f"""{windows('0', "case when fr + 512 >= n then n else coalesce(fr + 257 + " + last_of(WS, 'substr(text, fr + 258, 256)') + ", fr + 512) end", 'case when stop - 64 > fr then stop - 64 else stop end')},
c as (select *, {strip('substr(text, fr + 1, stop - fr)')} as content from w)
select doc_id, (row_number() over (partition by doc_id order by fr) - 1)::int as chunk_idx, content, fr::int as start_idx, stop::int as end_idx, {estimate('content')} as token_count from c where content <> ''""",
    "chunk_text": f"""{windows('0', f"case when fr + 1000 >= n then n else coalesce(nullif(greatest({cut_before('(fr + 1000)')}, fr), fr), fr + 1000) end", 'case when stop - 100 > fr then stop - 100 else stop end').replace(f"where regexp_matches(text, '{INK}')", "where text <> ''")},
c as (select *, substr(text, fr + 1, stop - fr) as content from w)
select doc_id, (row_number() over (partition by doc_id order by fr) - 1)::int as chunk_idx, content, fr::int as start_idx, stop::int as end_idx, {estimate('content')} as token_count from c""",
    "chunk_blocks": f"""
with recursive {BLOCKS}, r as (select document_id, sequence, block_id, {estimate('content')} + {estimate('section')} as tokens from b), {greedy('r', ['document_id'], 'sequence, block_id', 64, True)}
select document_id, sequence, block_id, tokens, chunk from g""",
    "chunk_hits": f"""
with recursive {BLOCKS}, {HITS}, k as (select *, row_number() over (partition by query_id, branch order by score desc, document_id, block_id) as rank from best),
r as (select k.branch, query_id, rank, {estimate('b.content')} as tokens from k join b on k.document_id = b.document_id and k.block_id = b.block_id), {greedy('r', ['branch', 'query_id'], 'rank', 64, False)}
select branch, query_id, rank, tokens, chunk from g""",
    "chunk_paragraph": merged(PARAGRAPHS, 128, 50),
    "chunk_sentence": merged(SENTENCES, 128, 16),
    "combine_blocks": f"""
with {BLOCKS} select document_id, sequence // 5 as part, string_agg(trim(content), E'\\n\\n' order by sequence, trim(content)) as text from b where trim(content) <> '' group by 1, 2""",
    "vector_index": "select true as enough",
    "content_hash": f"""
with {BLOCKS}, x as (select document_id, {NORM.format('content')} as x from b where coalesce(type, '') <> 'image')
select document_id, sha256(string_agg(x, E'\\n' order by x)) as content_hash from x where x <> '' group by 1""",
    "dedup_checksum": """
with f as (select checksum, min(document_id) as duplicate_of from documents where checksum is not null and checksum <> '' group by 1 having count(*) > 1)
select document_id, duplicate_of, 'checksum' as method, 1e0 as similarity from documents join f using (checksum) where document_id <> duplicate_of""",
    "dedup_content": f"""
with l as (select document_id, unnest(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]'))) as x from documents where text is not null),
x as (select document_id, {NORM.format("regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')")} as x from l),
h as (select document_id, sha256(string_agg(x, E'\\n' order by x)) as h from x where x <> '' group by 1), f as (select h, min(document_id) as duplicate_of from h group by 1 having count(*) > 1)
select document_id, duplicate_of, 'content_hash' as method, 1e0 as similarity from h join f using (h) where document_id <> duplicate_of""",
    "similar_documents": """
with w as (select document_id as wanted_id, name, size_bytes, page_count from documents where doc_id % 20 = 0)
select wanted_id, d.document_id, row_number() over (partition by wanted_id order by d.document_id) as rank from w join documents d on wanted_id <> d.document_id
  and (w.name = d.name or (w.size_bytes = d.size_bytes and w.page_count = d.page_count) or d.size_bytes between w.size_bytes * 95 // 100 and w.size_bytes * 105 // 100) qualify rank <= 10""",
    "pending_documents": f"with {KEYS} select document_id from documents d where not exists (select 1 from k where k.document_id = d.document_id)",
    "incomplete_embeddings": f"with {STATUS} select document_id, embeddable, embedded from st where embedded > 0 and embedded < embeddable",
    "missing_block_embeddings": f"with {STATUS} select document_id, embeddable, embedded from st where embedded < embeddable",
    "embedding_status": f"with {STATUS} select document_id, embeddable, embedded, embedded >= embeddable as complete, round(case when embeddable = 0 then 100 else 100e0 * embedded / embeddable end, 6) as progress from st",
    "unembedded_blocks": f"with {BLOCKS}, {KEYS} select document_id, block_id from b where {EMBEDDABLE} and not exists (select 1 from k where k.document_id = b.document_id and k.block_id = b.block_id)",
    "needs_reembedding": f"""
with {BLOCKS}, x as (select document_id, block_id, left(sha256(content), 16) as text_hash from b where {EMBEDDABLE})
select * from x where not exists (select 1 from vectors v where v.vector is not null and v.document_id = x.document_id and v.block_id = x.block_id and v.text_hash = x.text_hash)""",
    "source_stats": f"""
with {STATUS} select source, count(*) as documents, sum(coalesce(embeddable, 0))::bigint as blocks, sum(coalesce(embedded, 0))::bigint as embedded,
  count(*) filter (coalesce(embedded, 0) < coalesce(embeddable, 0)) as with_issues, sum(coalesce(embeddable, 0) - coalesce(embedded, 0))::bigint as missing from documents left join st using (document_id) group by 1""",
    "vector_info": "select count(*) as vectors, coalesce(max(model), '') as model, coalesce(max(dimension), 0) as dimension, max(created_at) as last_created from vectors",
    "last_import": "select source, max(imported_at) as last_imported from documents group by 1",
    "store_stats": f"""
with {BLOCKS}, {KEYS} select 'documents' as what, count(*) as n from documents union all select 'blocks', count(*) from b union all select 'images', count(*) from b where type = 'image'
union all select 'terms', count(distinct term) from search_terms where term <> '' union all select 'embedded_blocks', count(*) from k""",
    "health": f"""
with {STATUS}, a as (select count(*) as embedded_blocks from k), o as (select count(*) as orphans from k where not exists (select 1 from b where b.document_id = k.document_id and b.block_id = k.block_id)),
i as (select count(*) as incomplete from st where embedded > 0 and embedded < embeddable), w as (select count(*) as pending from documents d where not exists (select 1 from k where k.document_id = d.document_id))
select embedded_blocks, orphans, incomplete, pending, orphans = 0 and incomplete = 0 as healthy from a, o, i, w""",
    "upsert_latest": """
with r as (select document_id, source, external_id, created_at, case when external_id is null or external_id = '' then 'd:' || document_id else 'e:' || external_id end as record, (batch_no > 0)::int as turn,
  coalesce(imported_at, timestamp '1970-01-01') as t from documents where batch_no is not null),
x as (select *, min(created_at) over (partition by source, record) as first, row_number() over (partition by source, record order by turn desc, t desc, document_id desc) as n from r)
select document_id, source, external_id, first as created_at from x where n = 1""",
    "token_totals": f"with {BLOCKS} select document_id, sum({estimate('content')})::bigint as tokens from b group by 1",
    "store_documents": f"select document_id, case when {AGAIN} then 'renamed ' || doc_id else name end as name, source, external_id, page_count, created_at from documents where document_id is not null",
    "store_deleted": f"""
with {BLOCKS}, {TAGS}, x as (select document_id from documents where source <> 'wiki_export' or source is null), kept as (select * from b where document_id in (select * from x)),
t as (select document_id, block_id, {tokens('content')} as l from kept where coalesce(type, 'text') <> 'image')
select 'documents' as what, count(*) as n from x union all select 'blocks', count(*) from kept union all select 'tags', count(*) from tags where t.v is not null and document_id in (select * from x)
union all select 'postings', count(*) from (select distinct document_id, block_id, unnest(l) from t) union all select 'stats', count(distinct document_id) from kept
union all select 'vectors', count(*) from vectors where document_id is not null and document_id not in (select document_id from documents where source = 'wiki_export')""",
    "store_tags": f"""
with {TAGS} select document_id, t.k as tag_key, t.v as tag_value from tags where t.v is not null and document_id not in (select document_id from documents where format = 'pdf')
union all select document_id, 'kind', 'file' from documents where format = 'pdf'""",
    "store_touched": "select document_id, case when content_hash is null then 'new:' || document_id else content_hash end as content_hash, source from documents",
    "embed_pending": f"""
with {BLOCKS}, x as (select document_id, block_id, left(sha256(content), 16) as text_hash from b where {EMBEDDABLE} and document_id in (select document_id from documents))
select document_id, block_id, 0 as chunk_idx, text_hash, 64 as dimension from x where not exists (select 1 from vectors v where v.vector is not null and v.document_id = x.document_id and v.block_id = x.block_id and v.text_hash = x.text_hash)""",
    "embed_repaired": "select 0::bigint as waiting, 0::bigint as orphans, 0::bigint as incomplete",
    "pending_first": f"with {KEYS} select document_id from documents d where not exists (select 1 from k where k.document_id = d.document_id) order by 1 limit 25",
    "paged_blocks": f"with {BLOCKS} select document_id, block_id, row_number() over (order by document_id, sequence, block_id) as position from b qualify position between 101 and 150",
    "lookups": """
with o as (select document_id, source, external_id, content_hash from documents where external_id <> '' and content_hash <> '' and source is not null order by doc_id limit 1)
select 'id' as how, document_id from o union all select 'external', d.document_id from documents d join o on d.source = o.source and d.external_id = o.external_id
union all select 'hash', d.document_id from documents d join o on d.content_hash = o.content_hash""",
    "ordered_documents": "select document_id, row_number() over (order by updated_at desc, document_id) as position from documents where updated_at is not null qualify position <= 100",
    "delete_cascade": f"""
with {BLOCKS}, {POSTS}, g as (select document_id from documents where source = 'wiki_export')
select 'documents' as what, count(*) as n from documents where document_id not in (select * from g) union all select 'blocks', count(*) from b where document_id not in (select * from g)
union all select 'postings', count(*) from p where document_id not in (select * from g)""",
    "parsed_texts": f"""
with t as (
  select 'doc_' || doc_id || (case when doc_id % 2 <> 0 then '.pdf' else '.docx' end) as path, doc_id % 2 <> 0 as pdf,
    regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from documents where text is not null),
e as (select path, pdf, generate_subscripts(l, 1) as i, unnest(l) as x from t),
x as (select path, i, case when pdf then regexp_replace(regexp_replace({strip('x')}, '[^\\x00-\\x7f\\x{{a0}}-\\x{{ff}}{CP1252}]', '?', 'g'), '[\\x00-\\x1f]', '', 'g')
  else regexp_replace({strip('x')}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g') end as x from e where regexp_matches(x, '{INK}')),
c as (select path, i, {strip('x')} as content from x where regexp_matches(x, '{INK}'))
select path, (row_number() over (partition by path order by i) - 1)::int as sequence, content, null::varchar as error from c
union all select distinct path, null::int, null, null from t where path not in (select path from c)""",
    "stream_last_event": "select event_type, max(ts) as last from events group by 1",
    "p5_found": P5,
}
