"""SQL for DuckDB of the operators that SQL can express, over the whole tables, written from the contract and not from the operators."""

from __future__ import annotations

from .licences import HEADINGS, KNOWN, LONG, SPELLINGS  # the tables of licences and spellings, no patterns

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate({x}, '{_A}', '{_Z}')"


_YEAR = "(19|20)[0-9][0-9]"
_RIGHTS = rf"^[^a-z0-9]*(copyright[ :].*(\(c\)|©|{_YEAR}|[<{{]y(ear|yyy)|\[y(ear|yyy))|copyright[ :]*y(ear|yyy)|copyright(\(c\)|©|y(ear|yyy))|©|\(c\) *[0-9][0-9][0-9][0-9]|all rights reserved)"
_ITEM = r"^[^a-z0-9\x80-\x{10FFFF}]*([0-9]|[0-9][0-9]|[a-z])[.)][ \t]"


def _canonical(x: str) -> str:
    """Line by line, then word by word: each word is looked up, pairs of words are put together."""
    lines = f"list_transform(string_split({_lower(f'coalesce({x},$$$$)')}, chr(10)), lambda l: case when regexp_matches(l, {_q(_RIGHTS)}) then '' else regexp_replace(l, {_q(_ITEM)}, '') end)"
    words = f"list_filter(regexp_split_to_array(array_to_string({lines}, ' '), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w<>'')"
    out = f"chr(1)||array_to_string({words}, chr(1)||chr(1))||chr(1)"
    for said, meant in SPELLINGS:
        mark = lambda t: "'||chr(1)||'" + t.replace(" ", "'||chr(1)||chr(1)||'") + "'||chr(1)||'"
        out = f"replace({out}, '{mark(said)}', '{mark(meant)}')"
    return f"sha256(trim(replace(replace({out}, chr(1)||chr(1), ' '), chr(1), '')))"


_TEXTS = ", ".join(f"({_q(i)}, {_q(t)})" for i, t in [*KNOWN, *((i, f"{h}\n{t}") for i, t in KNOWN for h in HEADINGS.get(i, ()) if len(t) > 200)])
_DIGESTS = ", ".join(f"({_q(i)}, {_q(d)})" for i, d in LONG)
OP1 = f"""with known as (select {_canonical("t")} digest, min(i) license_id from (values {_TEXTS}) k(i,t) group by 1 union all select d, i from (values {_DIGESTS}) l(i,d)),
lines as (select doc_id, unnest(string_split(text, chr(10))) line from documents),
found as (select doc_id, string_agg(distinct license_id, ',' order by license_id) notices from lines join known on digest={_canonical("line")} group by 1)
select d.doc_id, d.digest, license_id, coalesce(notices,'') notices from (select doc_id, {_canonical("text")} digest from documents) d left join known using(digest) left join found using(doc_id)"""

_SPACE = r"[^\x20\x09-\x0D]+"
OP3 = f"""with recursive w as (select doc_id, regexp_extract_all({_lower("coalesce(text,'')")}, {_q(_SPACE)}) w from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(w, i, least(i+4, len(w))), ' ')) h from (select doc_id, w, unnest(range(1, greatest(len(w)-4, 1)+1)) i from w where len(w)>0)),
n as (select doc_id, count(*) n from s group by 1),
link as (select a.doc_id a, b.doc_id b from s a join s b on a.h=b.h and a.doc_id<>b.doc_id join n x on x.doc_id=a.doc_id join n y on y.doc_id=b.doc_id where 100*least(x.n,y.n)>=75*greatest(x.n,y.n) group by a.doc_id, b.doc_id having 100*count(*)>=75*(any_value(x.n)+any_value(y.n)-count(*))),
reach as (select doc_id a, doc_id b from documents union select r.a, l.b from reach r join link l on l.a=r.b)
select d.doc_id, coalesce(n,0) n_shingles, c component_id, d.doc_id=c kept from documents d left join n using(doc_id) join (select a doc_id, min(b) c from reach group by 1) using(doc_id)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5 = f"""with d as (select doc_id, regexp_extract_all({_lower("coalesce(text,'')")}, {_q(_WORD)}) w from documents),
b as (select item_id, regexp_extract_all({_lower("coalesce(text,'')")}, {_q(_WORD)}) w from benchmark),
bw as (select distinct item_id, least(len(w),13) n, array_to_string(list_slice(w, i, least(i+12, len(w))), ' ') k from (select item_id, w, unnest(range(1, greatest(len(w)-12, 1)+1)) i from b where len(w)>0)),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(list_slice(w, i, i+n-1), ' ') k from (select doc_id, w, n, unnest(range(1, len(w)-n+2)) i from d, ns where len(w)>=n)),
m as (select doc_id, item_id, i, dw.n from dw join bw on dw.k=bw.k and dw.n=bw.n),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i+n)) p from m) group by 1),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from m group by 1)
select doc_id, len(w) n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items, sha256(coalesce(ids,'')) items_sha256, coalesce(n_hit,0)>0 and 20*n_hit>=len(w) contaminated from d left join h using(doc_id) left join t using(doc_id)"""

_ESCAPED = "len(text)+len(regexp_replace(text, '[^\\\\<\\[\\]]', '', 'g'))"
OP7 = f"""with c as (select conv_id, turn, role, coalesce(text,'') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' order by turn)) turns_sha256, cast(coalesce(sum(len(text)) filter (role='assistant'),0) as bigint) loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn) filter (role='assistant'),'')) loss_sha256,
 cast(sum({_ESCAPED} + case role when 'assistant' then 4 when 'user' then 10+8 else 11+len(role)+8 end) as bigint) formatted_chars from c group by 1"""

OP8 = """with v as (select vec_id, cast(embedding as double[]) v from embeddings where embedding is not null),
p as (select q.vec_id query_id, c.vec_id, list_reduce(list_transform(list_zip(c.v, q.v), lambda z: z[1]*z[2]), lambda a, b: a+b) score from v q join v c on c.vec_id<>q.vec_id where q.vec_id%20=0)
select query_id, cast(k as int) rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) k from p) where k<=20"""

OP10 = f"""with w as (select doc_id, regexp_extract_all(coalesce(text,''), {_q(_SPACE)}) w from documents),
g as (select doc_id, i, md5(array_to_string(list_slice(w, i, i+19), ' ')) h from (select doc_id, w, unnest(range(1, len(w)-18)) i from w where len(w)>=20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) k from g) where k>1),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(i, i+20)) p from later) group by 1)
select doc_id, len(w) n_words, coalesce(len(ps),0) n_removed, sha256(coalesce(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' '),'')) kept_sha256 from w left join gone using(doc_id)"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0"


def _lloyd(rounds: int) -> str:
    out = f"""with q as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as bigint)) q from embeddings where {_FINITE}),
p as (select vec_id, pos, list_slice(q, pos*w+1, pos*w+w) part from (select vec_id, q, len(q)//16 w, unnest(range(16)) pos from q)),
b0 as (select pos, row_number() over (partition by pos order by vec_id)-1 entry, part c from p qualify entry<64)"""
    for r in range(rounds + 1):
        out += f""",
a{r} as (select vec_id, pos, any_value(part) part, arg_min(entry, (far, entry)) entry, min(far) far from (select vec_id, pos, part, entry, list_sum(list_transform(list_zip(part, c), lambda z: (z[1]-z[2])*(z[1]-z[2]))) far from p join b{r} using(pos)) group by vec_id, pos)"""
        if r < rounds:
            out += f""",
m{r} as (select pos, entry, list((s-((s%n)+n)%n)//n order by j) c from (select pos, entry, j, cast(sum(part[j]) as bigint) s, count(*) n from (select *, unnest(range(1, len(part)+1)) j from a{r}) group by all) group by all),
b{r + 1} as (select pos, entry, coalesce(m{r}.c, b{r}.c) c from b{r} left join m{r} using(pos, entry))"""
    return f"""{out},
e as (select vec_id, string_agg(printf('%02x', entry), '' order by pos) code, cast(sum(far) as bigint) error from a{rounds} group by 1),
k as (select sha256(string_agg(array_to_string(c, ','), ',' order by pos, entry)) codebooks_sha256 from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from e join q using(vec_id), k"""

OP12 = f"""with v as (select vec_id id, case when vec_id%7=0 then (label+1)%10 else label end as l, list_transform(embedding, lambda x: cast(floor(256*cast(x as double)) as bigint)) q from embeddings where label is not null and {_FINITE}),
s as (select a.id a, b.id b, a.l=b.l same, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1]*z[2])) as bigint) s from v a join v b on a.id<>b.id where a.id%50=0),
p as (select a, b positive_id, s positive_score from s where same qualify row_number() over (partition by a order by s desc, b)<=5),
n as (select a, positive_id, positive_score, b, s, row_number() over (partition by a, positive_id order by s desc, b) k from p join s using(a) where not same and 50*positive_score<=100*s and 100*s<=95*positive_score)
select a anchor_id, positive_id, cast(k as int) rank, b negative_id, positive_score, s negative_score from n where k<=3"""


ORACLES = {"op1_license_scan": OP1, "op3_minhash_near_dedup": OP3, "op5_benchmark_decontamination": OP5, "op7_chat_formatting": OP7, "op8_nearest_neighbours": OP8, "op10_substring_dedup": OP10, "op11_vector_codes": _lloyd(2), "op12_hard_negatives": OP12}
