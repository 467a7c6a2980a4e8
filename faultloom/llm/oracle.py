"""DuckDB SQL for the queries that SQL can express."""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op9_benchmark_decontamination"] = rf"""
with d as (
  select doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select item_id, w, least(10, len(w)) as n from (
    select item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
    where text is not null) z where len(w) > 0
), bw as (
  select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from b) z
), dw as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from d, (select distinct n from bw) l where len(w) >= n) z
), hit as (select doc_id, i, n, item_id from dw join bw using (n, g)),
hw as (select doc_id, count(distinct p) as n_hit
       from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit) z) y group by 1),
hi as (select doc_id, count(distinct item_id) as n_items,
              string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
       from hit group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""

SQL["op5_minhash_near_dedup"] = rf"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
  select distinct doc_id, case when len(w) = 1 then w[1] else array_to_string(list_slice(w, i, i + 1), ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from d where len(w) > 0) z
), n as (select doc_id, count(*) as n from s group by 1),
-- texts with equal sets link through the smallest of them
c as (select doc_id, n, min(doc_id) over (partition by gs) as rep
      from (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as gs from s group by 1) z),
r as (select s.doc_id, g, n from s join c using (doc_id) where rep = c.doc_id),
-- a pair over the threshold shares a shingle among the rarest fifth (and one) of its smaller set
f as (select g, count(*) as k from r group by 1),
p as (select doc_id, g, n from (
        select doc_id, g, n, row_number() over (partition by doc_id order by k, g) as rn from r join f using (g)) z
      where rn <= n - cast(ceil(n * 0.8) as bigint) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from p a join p b using (g)
         where a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link as (select a, b from (
           select a, b, na, nb, count(*) as k from cand join r x on x.doc_id = a join r y on y.doc_id = b and y.g = x.g
           group by 1, 2, 3, 4) z where 100 * k >= 80 * (na + nb - k)),
e as (select a, b from link union select b, a from link),
walk as (select doc_id as v, doc_id as u from c where rep = doc_id
         union select walk.v, e.b from walk join e on walk.u = e.a),
root as (select v, min(u) as root from walk group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(root, d.doc_id) as component_id,
       coalesce(root, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join c using (doc_id) left join root on root.v = c.rep
"""

SQL["op7_suffix_array_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, i, md5(substr(x, 2 * i + 1, 200)) as m
      from (select doc_id, x, unnest(range(0, cast(len(x) // 2 as bigint) - 99)) as i from d where len(x) >= 200) z),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by m order by doc_id, i) as rn from w) z
          where rn > 1),
gap as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as opens
        from later),
run as (select doc_id, i, sum(opens) over (partition by doc_id order by i) as r from gap),
span as (select doc_id, min(i) as a, max(i) + 100 as b from run group by doc_id, r),
-- what is kept lies between the spans
cut as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed,
               list(a order by a) as starts, list(b order by a) as ends from span group by doc_id),
j as (select d.doc_id, x, n_spans, n_removed,
             list_concat([cast(0 as bigint)], coalesce(ends, [])) as f,
             list_concat(coalesce(starts, []), [cast(len(x) // 2 as bigint)]) as t
      from d left join cut using (doc_id))
select doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(f) + 1),
              lambda k : substr(x, 2 * f[k] + 1, 2 * (t[k] - f[k]))), ''))) as kept_sha256
from j
"""


def _dealt(depth: int, weight: str) -> str:
    """One level of the budget tree: b{depth} has the budget of every node with depth + 1 names."""
    path = ["domain", "lang", "source"][: depth + 1]
    keys, parent = ", ".join(path), ", ".join(path[:-1]) or "1"
    above = (
        "(select (sum(tokens) * 100) // 100 from leaf)" if depth == 0
        else f"(select budget from b{depth - 1} p where {' and '.join(f'p.{c} = z.{c}' for c in path[:-1])})"
    )
    return f"""
n{depth} as (select *, {above} as pb from (
  select {keys}, sum(tokens) * 2 as c, cast({weight} as bigint) as w from leaf group by {keys}) z),
s{depth} as (select *, sum(c) over (partition by {parent} order by c / w, c rows unbounded preceding) as cu,
  sum(w) over (partition by {parent} order by c / w, c rows unbounded preceding) as wu,
  sum(w) over (partition by {parent}) as wa from n{depth}),
f{depth} as (select *, cu * w + c * (wa - wu) <= pb * w as filled from s{depth}),
b{depth} as (select {keys}, case when filled then c else w * (pb - cf) // wo end as budget from (
  select *, sum(case when filled then c else 0 end) over (partition by {parent}) as cf,
    nullif(sum(case when filled then 0 else w end) over (partition by {parent}), 0) as wo from f{depth}) z)"""


SQL["op10_mixing"] = f"""
with d as (
  select doc_id, coalesce(nullif(lang, ''), 'unknown') as lang, coalesce(nullif(source, ''), 'unknown') as source,
         coalesce(case when right(source, 1) between '0' and '3' then 'web' when right(source, 1) between '4' and '6' then 'reference'
              when right(source, 1) between '7' and '9' then 'forum' end, 'unknown') as domain,
         cast(coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) as bigint) as tokens from documents),
leaf as (select domain, lang, source, sum(tokens) as tokens from d group by all),
{_dealt(0, "case domain when 'web' then 5 when 'reference' then 3 when 'forum' then 2 else 1 end")},
{_dealt(1, "case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 1 else 1 end")},
{_dealt(2, "1")},
plan as (select domain, lang, source, case when tokens > 0 then budget // tokens else 0 end as f,
                case when tokens > 0 then budget % tokens else 0 end as rest
         from leaf join b2 using (domain, lang, source)),
o as (select d.*, f, rest, sum(tokens) over (partition by domain, lang, source
        order by md5(concat_ws(':', '42', cast(f as varchar), cast(doc_id as varchar))), tokens rows unbounded preceding) - tokens as before
      from d join plan using (domain, lang, source))
select doc_id, domain, lang, source, cast(f as integer) as epoch, tokens,
       cast(least(tokens, rest - before) as bigint) as take_tokens from o where before < rest
union all
select doc_id, domain, lang, source, cast(e as integer), tokens, tokens
from (select *, unnest(range(0, cast(f as bigint))) as e from o) z
"""

SQL["op8_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), a as (
  select conv_id, turn, role, text, 24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))
         + len(regexp_extract_all(role, '<\\*\|')) + 5 * (length(role) - length(replace(role, chr(10), ''))) as n from t
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(n) as bigint) as formatted_chars
from a group by conv_id
"""

SQL["op1_warc_revisits"] = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
h as (select page_id, octet_length(body) as n,
             array_to_string(list_transform(range(0, 32), lambda i :
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(1, 6), lambda k :
                 cast(substr(bits, 5 * i + k, 1) as integer) << cast(5 - k as integer))) as bigint), 1)), '') as digest
      from (select page_id, body, array_to_string(list_transform(range(1, 41), lambda i :
              lpad(bin(strpos('0123456789abcdef', substr(x, i, 1)) - 1), 4, '0')), '') as bits
            from (select page_id, body, sha1(body) as x from p) y) z),
f as (select digest, min(page_id) as first from h group by 1)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from h join f using (digest)
"""


SQL["op13_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x : floor(256 * cast(x as double))) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_dot_product(a.x, b.x) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0),
p as (select anchor_id, own, vec_id as positive_id, score as positive_score from s where label = own and vec_id <> anchor_id
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
             cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as integer) as rank
      from p join s on s.anchor_id = p.anchor_id and s.label <> p.own
        and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


def _repair_sql() -> str:
    """Costs and audits go forward row by row, each state's best as one string: cost in twelve digits, then edits."""
    more = lambda k, cost, edit: f"lpad(cast(cast(left({k}, 12) as bigint) + {cost} as varchar), 12, '0') || substr({k}, 13) || '{edit}'"

    def inserted(k: list[str]) -> str:
        third = f"least({k[2]}, {more(k[0], 5, 'I')}, {more(k[1], 5, 'I')}, {more(k[3], 5, 'I')})"
        fourth = f"least({k[3]}, {more(third, 5, 'I')})"
        return f"{k[0]} as s0, {k[1]} as s1, {third} as s2, {fourth} as s3"

    def taken(k: str, initial: str) -> str:
        kept, other = more(k, "x", "K"), more(k, "1 + x", "R")
        return f"case when gone then null when r = '{initial}' then {kept} else {other} end"

    user = ", ".join(taken(k, "u") for k in ("s0", "s1", "s3"))
    start = "'000000000000'"
    return rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
h as (select *, xor(list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i : [ascii(substr(key, i, 1)), 0, 0, 0, 0, 0, 0, 0])),
        lambda a, b : xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295), 4294967295) % 20 as kind
      from k),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
             case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(range(0, case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) as copy from h),
u as (select *, row_number() over () as u from d),
o as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as kept,
             row_number() over (partition by conv_id order by turn nulls first, role, text, u) as i,
             row_number() over (partition by conv_id, role, text order by turn nulls first, u) as seen from u),
f as (select *, left(role, 1) as r, lag(left(role, 1)) over (partition by conv_id order by i) as before,
             case when kept = '' then 'blank' when seen > 1 then 'duplicate' when right(kept, 1) not in ('.', '!', '?') then 'truncated' end as fault
      from o),
t as (select *, coalesce(fault in ('blank', 'duplicate'), false) as gone, case when fault = 'truncated' then 5 else 0 end as x from f),
c as (select distinct conv_id from conversations),
walk as (
  select conv_id, cast(0 as bigint) as i, {inserted([start, "cast(null as varchar)", "cast(null as varchar)", "cast(null as varchar)"])} from c
  union all
  select conv_id, i, {inserted(["n0", "n1", "n2", "n3"])} from (
    select w.conv_id, t.i, {more("s0", 2, "D")} as n0,
      least({more("s1", 2, "D")}, case when not gone and r = 's' then {more("s0", "x", "K")} end) as n1,
      least({more("s2", 2, "D")}, {user}) as n2,
      least({more("s3", 2, "D")}, {taken("s2", "a")}) as n3
    from walk w join t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1) z),
best as (select conv_id, least(s0, s3) as b from walk qualify i = max(i) over (partition by conv_id)),
e as (select conv_id, j, substr(b, 12 + j, 1) as edit, length(replace(substr(b, 13, j), 'I', '')) as i,
             length(replace(substr(b, 13, j), 'D', '')) as place
      from (select conv_id, b, unnest(range(1, length(b) - 11)) as j from best) z),
g as (select e.*, t.role, t.text, t.r from e left join t on t.conv_id is not distinct from e.conv_id and t.i = e.i and edit <> 'I'),
p as (select *, max(case when place = 1 and edit = 'K' and r = 's' then 1 else 0 end) over (partition by conv_id) as led from g where edit <> 'D'),
done as (select conv_id, string_agg(case when edit = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end
                || ':' || case when edit = 'I' then '' else text end, chr(10) order by j) as repaired from p group by conv_id),
n as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank,
             count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
             count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal from t group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(left(b, 12) as bigint) as cost, substr(b, 13) as audit,
       sha256(coalesce(repaired, '')) as repaired_sha256
from c join best on best.conv_id is not distinct from c.conv_id
  left join n on n.conv_id is not distinct from c.conv_id left join done on done.conv_id is not distinct from c.conv_id
"""


SQL["op12_conversation_repair"] = _repair_sql()


def _license_sql() -> str:
    from . import licenses as li

    known = li.known_sentences()
    table = "map {" + ", ".join(f"'{k}': '<{v}>'" for k, v in known.items()) + "}"
    steps, state = [], "seq"
    for i, (name, pattern) in enumerate(li.ordered_rules()):
        last = f"q{i}"
        steps.append(
            f"{last} as (select *, replace({state}, '{pattern}', '|') as r{i}, "
            f"list_resize([]::varchar[], (length({state}) - length(replace({state}, '{pattern}', '|'))) // {len(pattern) - 1}, '{name}') as m{i} "
            f"from {'q' if i == 0 else f'q{i - 1}'})"
        )
        state = f"r{i}"
    every = "flatten([" + ", ".join(f"m{i}" for i in range(len(steps))) + "])"
    return f"""
with s as (
  select doc_id, list_filter(list_transform(
           regexp_split_to_array({_LOWERED}, '\\n+|[.;:!?]+[ \\t]+'),
           lambda x : trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x : x <> '') as s
  from (select doc_id, coalesce(text, '') as text from documents) z),
q as (
  select doc_id, len(s) as n, replace(regexp_replace(array_to_string(list_transform(s, lambda x : coalesce({table}[x], '?')), ''),
         '\\?{{4,}}', '|', 'g'), '?', '') as seq from s),
{", ".join(steps)}
select doc_id, cast(n as bigint) as n_sentences, cast(length(seq) - length(replace(seq, '<', '')) as bigint) as n_known,
       array_to_string(list_sort(list_distinct({every})), ',') as licenses, cast(len({every}) as bigint) as n_matches
from q{len(steps) - 1}
"""


SQL["op6_license_scan"] = _license_sql()
