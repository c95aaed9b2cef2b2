"""DuckDB SQL of the queries that SQL can express."""

CHAT = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked as (
  select *, role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as opens,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) as chars
  from said
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars + case when opens then length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
                        else length('<|im_sep|>') end)::bigint as formatted_chars
from marked group by conv_id
"""

LINES = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place
  from documents
), numbered as (
  select doc_id, place, line, row_number() over (partition by doc_id order by place) - 1 as num
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
), windows as (
  select a.doc_id, a.num, a.line as l1, b.line as l2, c.line as l3
  from numbered a join numbered b on a.doc_id = b.doc_id and b.num = a.num + 1 join numbered c on a.doc_id = c.doc_id and c.num = a.num + 2
), firsts as (
  select l1, l2, l3, min({'d': doc_id, 'n': num}) as f from windows group by all having count(*) > 1
), covered as (
  select distinct w.doc_id, w.num + k as num
  from windows w join firsts on w.l1 = firsts.l1 and w.l2 = firsts.l2 and w.l3 = firsts.l3, (select unnest([0, 1, 2]) as k)
  where not (w.doc_id = f.d and w.num = f.n) and not (w.doc_id = f.d and w.num + k < f.n + 3)
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.place) as text
  from lines l left join numbered n on l.doc_id = n.doc_id and l.place = n.place
       left join covered c on c.doc_id = n.doc_id and c.num = n.num
  where c.num is null group by l.doc_id
)
select d.doc_id, coalesce(n.n, 0) as n_lines, coalesce(r.n, 0) as n_removed,
       case when d.text is null then null else length(coalesce(k.text, '')) end as n_chars,
       case when d.text is null then null else md5(coalesce(k.text, '')) end as text_md5
from documents d left join kept k using (doc_id)
     left join (select doc_id, count(*) as n from numbered group by 1) n using (doc_id)
     left join (select doc_id, count(*) as n from covered group by 1) r using (doc_id)
"""

ORACLE = {"op1_chat_formatting": CHAT, "op5_line_windows": LINES}

TOP_K = r"""
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from vectors q join vectors c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
from scored qualify rank <= 5
"""

CASCADE = r"""
with words as (
  select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, num, w[num] || ' ' || w[num + 1] || ' ' || w[num + 2] as three
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as num from words)
), repeated as (
  select doc_id, count(distinct num + k) as n
  from (select *, count(*) over (partition by doc_id, three) as times from windows), (select unnest([0, 1, 2]) as k)
  where times > 1 group by doc_id
), lines as (
  select doc_id, line, row_number() over (partition by doc_id, line) as nth
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
  where regexp_matches(line, '[^\x20\x09-\x0D]')
), line_counts as (
  select doc_id, count(*) as n_lines, count(*) filter (nth > 1) as n_dup_lines from lines group by doc_id
), counted as (
  select doc_id, len(w) as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g')) as n_marks,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) as n_upper,
         length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) as n_lower
  from words
), joined as (
  select c.*, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from counted c left join line_counts using (doc_id) left join repeated r using (doc_id)
)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
            or 100 * n_symbols > 20 * n_words or 100 * n_marks > 30 * n_words
            or 100 * n_upper > 60 * (n_upper + n_lower)
            or (n_words > 0 and not (word_chars / n_words between 2.0 and 25.0))
            or 100 * n_dup_lines > 50 * n_lines) as kept
from joined
"""

NEAR = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents
), shingles as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                                      else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words
), sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as both
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as materialized (
  select u, v from pairs join sizes x on x.doc_id = u join sizes y on y.doc_id = v
  where 100 * pairs.both >= 80 * (x.n + y.n - pairs.both)
), sym as materialized (select u, v from links union all select v, u from links
), reach(node, root) as (
  select doc_id, doc_id from documents union select sym.v, reach.root from reach join sym on sym.u = reach.node
), least as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join least on node = d.doc_id left join sizes using (doc_id)
"""

ORACLE |= {"op2_mtree_topk": TOP_K, "op4_quality_cascade": CASCADE, "op8_superminhash": NEAR}

COSINES = r"""
with recursive vectors as materialized (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), normed as materialized (
  select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as length from vectors
), links as materialized (
  select a.vec_id as u, b.vec_id as v
  from normed a join normed b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.length * b.length) >= 0.98
), reach(node, root) as (
  select vec_id, vec_id from embeddings union select links.v, reach.root from reach join links on links.u = reach.node
), least as (select node, min(root) as component_id from reach group by node
), counted as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on node = vec_id left join counted on u = vec_id
"""

LEXICAL = r"""
with said as materialized (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), counts as materialized (select doc_id, term, count(*) as tf from said group by 1, 2
), lengths as materialized (select doc_id, sum(tf)::bigint as n from counts group by 1
), whole as materialized (select count(*)::bigint as docs, sum(n)::bigint as total from lengths
), weights as materialized (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counts, whole group by term, docs
), asked as materialized (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score
  from asked join weights using (term) join counts using (term) join lengths using (doc_id), whole group by 1, 2
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

ORACLE |= {"op11_pstable_hashing": COSINES, "op12_norm_buckets": LEXICAL}
