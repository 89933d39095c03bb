"""SQL for the queries that it can express. The others are tested against brute
force, an exact round trip or planted cases in tests/llm."""

FINITE = "score is not null and not isnan(score) and not isinf(score)"

HITS = f"""
best as (
  select query_id, branch, document_id, block_id, max(score) as score from search_hits
  where {FINITE} and branch in ('keyword', 'vector') group by all),
alive as (
  select b.* from best b where exists (
    select 1 from content_blocks c where c.document_id = b.document_id and c.block_id = b.block_id)),
ranked as (
  select *, rank() over (partition by query_id, branch order by score desc) as r from alive),
items as (
  select query_id, document_id, block_id, max(case when branch = 'keyword' then r end) as keyword_rank,
    max(case when branch = 'vector' then r end) as vector_rank from ranked group by all)"""

OCC = "coalesce(len(positions), 0)"

POSTINGS = f"""
once as (
  select term, document_id, block_id, max({OCC}) as occ from search_terms
  where term is not null and term <> '' group by all)"""



def _signs(fold: bool = True) -> str:
    """Every character that has another form, as rows of a table with that form,
    and of all letters the folded ones."""
    from folioquery.llm.lookalike import default_forms

    rows = []
    for c in (*range(1, 0xD800), *range(0xE000, 0x1FFFF), *range(0xE0000, 0xE01F0)):
        x = default_forms().rewrite(chr(c))
        if (x := x.casefold() if fold else x) != chr(c):
            rows.append(f"({c}, '{x.replace(chr(39), chr(39) * 2)}')" if "\x00" not in x else f"({c}, '')")
    return ", ".join(rows)


def copies(columns: str) -> str:
    """p7: c has each document that is a copy, with the first it is a copy of."""
    return f"""
with signs(c, r) as (values {_signs()}),
ch as (select i, t[i] as x, o from (select unnest(generate_series(1, length(t))) as i, t, o from (
  select nfc_normalize(text) as t, (coalesce(batch_no, 262144)::bigint << 44) + doc_id as o from (select distinct doc_id, batch_no, text from documents where text is not null and doc_id is not null)))),
f as (select o, nfc_normalize(string_agg(coalesce(r, x), '' order by i)) as t from ch left join signs on unicode(x) = c group by o),
w as (select o, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) as w from f),
n as (select o, count(*) as n from w group by o having count(*) >= 20),
k as (select o, w, n, row_number() over (partition by o, w) as nth from w join n using (o)),
p as (
  select a.o as a, b.o as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from k a join k b on a.w = b.w and a.nth = b.nth and b.o < a.o and a.n <= 1.1e0 * b.n + 1e-9 and a.n >= 0.9e0 * b.n - 1e-9 group by 1, 2),
c as (select a & 17592186044415 as a, b & 17592186044415 as b, na = nb and na = common as same from p where greatest(na, nb) - common <= 0.1e0 * nb + 1e-9 qualify row_number() over (partition by p.a order by p.b) = 1)
{columns}"""


SQL = {
    "p1_found": f"with {HITS} select query_id, document_id, block_id from items where keyword_rank <= 2 and vector_rank <= 2",
    "p1_ranking": f"""
with {HITS},
sizes as (select query_id, count(*) filter (branch = 'keyword') as nk, count(*) filter (branch = 'vector') as nv from alive group by 1),
q as (select query_id, min_by(keyword_weight, asked_at) as a, min_by(vector_weight, asked_at) as b from search_queries where query_id is not null group by 1),
w as (select query_id, case when a between 0 and 1 and not isnan(a) then a else 0.5e0 end as a, case when b between 0 and 1 and not isnan(b) then b else 0.5e0 end as b from q),
v as (select query_id, case when a + b > 0 then a / (a + b) else 0.5e0 end as wk, case when a + b > 0 then b / (a + b) else 0.5e0 end as wv from w),
f as (
  select query_id, document_id, block_id, keyword_rank, vector_rank,
    round(coalesce(wk, 0.5e0) / (60 + coalesce(keyword_rank, nk + 1)) + coalesce(wv, 0.5e0) / (60 + coalesce(vector_rank, nv + 1)), 12) as s
  from items join sizes using (query_id) left join v using (query_id))
select query_id, document_id, block_id, keyword_rank, vector_rank, round(s, 10) as rrf, rank() over (partition by query_id order by s desc) as position from f""",
    "p2_found": """
with t as (select term, count(distinct document_id) as n from search_terms where term is not null and term <> '' group by 1),
d as (select count(distinct document_id) as n from search_terms where term is not null and term <> '')
select term, case when t.n > d.n * 0.5e0 then 'common' else 'rare' end as verdict from t, d where t.n = 1 or t.n > d.n * 0.5e0""",
    "p2_terms": f"""
with {POSTINGS},
t as (select term, sum(occ)::bigint as occurrences, count(distinct document_id) as documents, count(*) filter (document_id is not null and block_id is not null) as blocks from once group by 1),
d as (select count(distinct document_id) as n from once)
select term, occurrences, documents, blocks, case when documents > n * 0.5e0 then 'common' when documents = 1 then 'rare' end as verdict from t, d""",
    "p3_found": """
with v as (
  select distinct on (vec_id) vec_id, model, vector from vectors
  where vector is not null and ((model = 'quill-embed-96' and len(vector) = 96) or (model = 'quill-embed-64' and len(vector) = 64))
    and list_bool_and(list_transform(vector, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(vector, lambda x: x <> 0))),
s as (
  select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.vector::double[], b.vector::double[]) as sim
  from v a join v b on a.model = b.model and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by a order by sim desc, b) as r from s where sim >= 0.85e0)
select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from r where r <= 5""",
    "p6_found": f"""
with {POSTINGS},
td as (select term, document_id, sum(occ) as tf from once where document_id is not null group by all),
df as (select term, count(*) as df from td group by 1),
s as (select document_id, max(total_terms) as given from document_stats where document_id is not null group by 1),
o as (select document_id, sum(tf) as own from td group by 1),
n as (select document_id, case when given > 0 then given else own end as total from o left join s using (document_id))
select document_id, term from td join df using (term) join n using (document_id) where df between 2 and 5 and tf >= 3 and tf * 50 >= total""",
    "p6_scores": f"""
with {POSTINGS},
td as (select term, document_id, sum(occ)::bigint as tf from once where document_id is not null group by all),
df as (select term, count(*) as df, sum(tf)::bigint as cf from td group by 1 having count(*) >= 2),
a as (select sum(tf)::bigint as n from td),
s as (select document_id, max(total_terms) as given from document_stats where document_id is not null group by 1),
o as (select document_id, sum(tf)::bigint as own from td group by 1),
m as (select document_id, case when given > 0 then given else own end as total from o left join s using (document_id)),
x as (select document_id, term, tf, total, df, cf::double / n as q, (tf + 100e0 * (cf::double / n)) / (total + 100e0) as p from td join df using (term) join m using (document_id), a)
select document_id, term, tf, total, df, round(case when q > 0 then p * ln(p / q) else 0 end, 9) as score from x""",
    "p4_found": f"""
with signs(c, r) as (values {_signs(fold=False)}),
rows as (
  select distinct 'content' as field, document_id || '/' || block_id as key, content as text from content_blocks where content <> '' and document_id is not null and block_id is not null
  union all select distinct 'term', term, term from search_terms where term <> ''),
ch as (select field, key, text, i, nfc_normalize(text)[i] as x from (select field, key, text, unnest(generate_series(1, length(nfc_normalize(text)))) as i from (select field, key, replace(text, chr(13) || chr(10), chr(10)) as text from rows))),
f as (select field, key, text, nfc_normalize(string_agg(coalesce(r, x), '' order by i)) as form from ch left join signs on unicode(x) = c group by field, key, text)
select distinct a.field, least(a.key, b.key) as key_a, greatest(a.key, b.key) as key_b from f a join f b on a.field = b.field and a.form = b.form and a.text <> b.text and a.key <> b.key""",
    "p7_found": copies("select distinct least(a, b) as doc_id_a, greatest(a, b) as doc_id_b from c"),
    "p7_methods": copies("select a as doc_id, b as duplicate_of, case when same then 'exact' else 'near' end as method from c"),
    "p9_check": "select 0::bigint as over, true as filled, 0::bigint as torn, count(distinct doc_id) as documents from documents where text is not null and text <> ''",
}
