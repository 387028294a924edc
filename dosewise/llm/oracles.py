"""SQL of the document queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Upper to lower case, A to Z alone.
_FOLD = "translate(coalesce({0},''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(column: str, pattern: str, fold: bool) -> str:
    return pattern.format((_FOLD if fold else "coalesce({0},'')").format(column))


MIXING = f"""
with d as (select doc_id, coalesce(source, '(none)') as source, cast(len({_words('text', _SPACED, False)}) as bigint) as n_tokens from documents),
src as (select source, sum(n_tokens)::bigint as tokens from d group by source),
tot as (select sum(tokens)::bigint as total from src),
sh as (select source, tokens, tokens::double / total as p, total from src, tot where tokens > 0),
grid as (select unnest(range(0, 2000001)) as k),
met as (select k from grid, sh group by k having ln(sum(pow(p, k/2e6))) - sum(k/2e6 * pow(p, k/2e6) * ln(p)) / sum(pow(p, k/2e6)) >= 0.95 * ln(count(*)) - 1e-12),
best as (select coalesce(max(k), 0) as k from met),
ex as (select case when k % 2 = 1 then (k + 1) / 2 else k / 2 end / 1e6 as a from best),
pw as (select source, tokens, total, pow(p, a) as x from sh, ex),
wt as (select source, tokens, total, round(x / (select sum(x) from pw), 9) as weight from pw
 union all select source, tokens, (select total from tot), 0.0 from src where tokens = 0),
wn as (select *, cast(floor(weight * total) as bigint) as wanted from wt),
ps as (select source, tokens, weight, case when tokens > 0 then wanted // tokens else 0 end as passes,
 case when tokens > 0 then wanted % tokens else 0 end as rest, greatest(ceil(tokens / 1048576.0), 1)::bigint as blocks from wn),
dealt as (select d.doc_id, d.source, d.n_tokens, weight, passes, rest, md5('7-' || coalesce(d.doc_id::varchar, '') || '-' || d.source) as mark,
 cast('0x' || substr(md5('7-' || coalesce(d.doc_id::varchar, '') || '-' || d.source), 1, 8) as bigint) % blocks as block from d join ps using (source)),
bl as (select source, block, sum(n_tokens) as tokens, max(rest) as rest from dealt group by 1, 2),
op as (select source, block, tokens, rest - sum(tokens) over (partition by source order by md5('7-' || source || '-' || block::varchar), block
 rows unbounded preceding) + tokens as room from bl),
rd as (select dealt.*, room, room >= tokens and room > 0 as whole,
 sum(n_tokens) over (partition by source, block order by mark) as upto from dealt join op using (source, block))
select doc_id, source, n_tokens, weight, block, cast(passes + case when whole or (room > 0 and upto <= room) then 1 else 0 end as bigint) as copies from rd
"""

WINNOWING = f"""
with d as (select doc_id, {_words('text', _ALNUM, True)} as ws from documents),
it as (select item_id, ws from (select item_id, {_words('text', _ALNUM, True)} as ws from benchmark where item_id is not null) where len(ws) > 0),
iw as (select distinct item_id, k, array_to_string(ws[i:i+k-1], ' ') as win from
 (select item_id, ws, least(10, len(ws)) as k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from it)),
ks as (select distinct k from iw),
dw as (select doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') as win from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, ks)),
hit as (select distinct doc_id, item_id, i, k from dw join iw using (k, win)),
pos as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + k)) as p from hit)),
np as (select doc_id, count(*) as n from pos group by doc_id),
ni as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(np.n, 0)::bigint as n_hit, coalesce(ni.n, 0)::bigint as n_items,
 sha256(coalesce(ids, '')) as items_sha256, coalesce(np.n, 0) > 0 as contaminated
from d left join np using (doc_id) left join ni using (doc_id)
"""

SUBSTRINGS = f"""
with d as (select doc_id, {_words('text', _SPACED, False)} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i+12], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d)),
src as (select w, min(doc_id) as s from win group by w),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from win join src using (w) where s < doc_id)),
word as (select doc_id, p, ws[p] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from d)),
kept as (select doc_id, string_agg(word, ' ' order by p) as text from word anti join gone using (doc_id, p) group by doc_id),
ng as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (doc_id) left join ng using (doc_id)
"""

JACCARD = f"""
with recursive d as (select doc_id, {_words('text', _SPACED, True)} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i+4], ' ') as x from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from o join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * o >= 75 * (na.n + nb.n - o)),
reach as (select doc_id, doc_id as c from d union select l.b, reach.c from reach join l on reach.doc_id = l.a)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(c) as component_id from d join reach using (doc_id) left join n using (doc_id) group by d.doc_id
"""

VECTORS = """
with recursive v as (select vec_id, x, sqrt(list_inner_product(x, x)) as size from (select vec_id, cast(embedding as double[]) as x from embeddings)
 where x is not null and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and a.size > 0 and b.size > 0 and len(a.x) = len(b.x)
 and list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.95),
n as (select a as vec_id, count(*) as n from l group by a),
reach as (select vec_id, vec_id as c from embeddings union select l.b, reach.c from reach join l on reach.vec_id = l.a)
select vec_id, coalesce(max(n.n), 0)::bigint as n_links, min(c) as component_id, vec_id = min(c) as kept from reach left join n using (vec_id) group by vec_id
"""

#: Base32 by five bits of the hash at a time.
WARC = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, body, octet_length(body) as n, from_hex(sha1(body))::bit::varchar as bits from p),
g as (select *, min(page_id) over (partition by body) as first from d)
select page_id, n::bigint as payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([cast(substr(bits, 5 * i + j + 1, 1) as integer) * (1 << (4 - j)) for j in range(5)])::integer, 1) for i in range(32)], '') as payload_digest,
 case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to from g
"""

PHRASES = f"""
with p as (select coalesce(lang, 'und') as lang, row_number() over () as d, unnest(regexp_split_to_array({_FOLD.format('text')}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
f as (select lang, x, len(x) as m, count(*)::bigint as f from (select lang, unnest([ws[i:i+m-1] for i in range(1, len(ws) - m + 2)]) as x from w, range(1, 6) r(m) where len(ws) >= m) group by lang, x having count(*) >= 100),
inner_ as (select distinct g.lang, unnest([g.x[1:g.m-1], g.x[2:g.m]]) as x, g.f from f g where g.m > 2),
c as (select f.* from f left join (select lang, x, max(f) as most from inner_ group by lang, x) i using (lang, x) where m > 1 and (most is null or 100 * most < 100 * f.f)),
cuts as (select c.lang, c.x, c.f as a, k, l.f as l, r.f as r, n.n, cast((1000::hugeint * c.f * n.n) // (l.f::hugeint * r.f) as bigint) as score from c, range(1, 5) t(k), f l, f r, n
 where k < c.m and l.lang = c.lang and r.lang = c.lang and n.lang = c.lang and l.x = c.x[1:k] and r.x = c.x[k+1:c.m]),
best as (select lang, array_to_string(x, ' ') as phrase, a, l, r, n, score from cuts qualify row_number() over (partition by lang, x order by score, k) = 1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) where rank <= 2000
"""

#: Query -> SQL. The others need the tokenizer, a trained model or Spark's shuffle.
ORACLES = {
    "op2_mixing": MIXING,
    "op3_winnowing": WINNOWING,
    "op5_vector_dedup": VECTORS,
    "op9_substring_dedup": SUBSTRINGS,
    "op10_jaccard_join": JACCARD,
    "op11_warc": WARC,
    "op12_collocations": PHRASES,
}
