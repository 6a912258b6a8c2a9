"""DuckDB text of the corpus queries that SQL can express."""

SPELLING = r"""
with recursive bits as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as tab
  from range(256) r(i)),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
  from documents),
counted as (select id, run, count(*) as n from runs group by all),
hexed as (select run, n, hex(encode(id || ':' || run)) as h from counted),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) as crc
  from hexed, bits),
words as (
  select case when crc % 97 = 0 then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word, sum(n)::bigint as n
  from hashed group by 1 having sum(n) >= 3),
v as (select word, n from words where length(word) >= 5),
holes as (select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (
  select a.word, b.word as other, b.n as m from holes a join holes b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select a.word, b.word, b.n from holes a join v b on a.head || a.tail = b.word
  union select b.word, a.word, a.n from holes a join v b on a.head || a.tail = b.word),
best as (select word, count(*) as n_near, arg_min(other, row(-m, other)) as other, max(m) as m from near group by word),
forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 2 * v.n then other end as form, case when m >= 2 * v.n then m end as form_n
  from v left join best using (word)),
chain as (
  select word, form as at from forms where form is not null
  union all select c.word, f.form from chain c join forms f on c.at = f.word where f.form is not null),
ends as (select c.word, c.at as root from chain c join forms f on c.at = f.word where f.form is null)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near, f.form_n from forms f left join ends e using (word)
"""

WARC = r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
w as (select h, max(page_id) as m from p group by h)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when page_id is not distinct from m then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from m then m end as refers_to
from p join w using (h)
"""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece
  from documents),
listed as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from listed, (values (1), (2), (3)) s(k) where len(w) >= k),
freq as (select lang, k, phrase, count(*) as a from grams group by all),
total as (select lang, sum(a)::bigint as n from freq where k = 1 group by lang),
cand as (select lang, k, phrase, string_split(phrase, ' ') as w, a from freq where k > 1 and a >= 10),
inner_ as (
  select lang, w[1] || ' ' || w[2] as phrase, a as m from cand where k = 3
  union all select lang, w[2] || ' ' || w[3], a from cand where k = 3),
absorbed as (select lang, phrase, max(m) as m from inner_ group by all),
cuts as (
  select c.lang, c.phrase, c.a, c.w, unnest(range(1, c.k)) as cut from cand c left join absorbed x using (lang, phrase) where x.m is null or 100 * x.m < 50 * c.a),
scored as (
  select c.lang, c.phrase, c.a, c.cut, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as score
  from cuts c join freq l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ')
  join freq r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from weakest)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""
