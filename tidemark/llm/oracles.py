"""DuckDB SQL for the operators whose results SQL can state, over the whole given tables."""

from __future__ import annotations

#: A-Z alone to lower case: DuckDB's own function knows more letters.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Bare base32 of a SHA-1 digest from its hex digits, twenty bits at a time.
BASE32 = """array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({hex}, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::bigint, 1)), '')"""

OP5 = f"""with p as (select page_id, coalesce(html, '') as html from pages), last as (select html, max(page_id) as first from p group by html)
select p.page_id, strlen(p.html)::bigint as payload_bytes, {BASE32.format(hex="sha1(p.html)")} as payload_digest, case when p.page_id = last.first then 'response' else 'revisit' end as record_type,
case when p.page_id <> last.first then last.first end as refers_to from p join last on p.html = last.html"""

OP6 = f"""with recursive lists as (select doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') as words from documents),
shingles as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) end) as s from lists),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b where 100 * shared >= 75 * (x.n + y.n - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, e.b from reach r join edges e on e.a = r.other)
select d.doc_id, coalesce(s.n, 0) as n_shingles, (select min(other) from reach r where r.doc_id = d.doc_id) as component_id from documents d left join sizes s on s.doc_id = d.doc_id"""

#: crc32 of a text's bytes, with the table of its 256 remainders from one subquery.
CRC_TABLE = """select list(r order by b) as t from (select b, list_reduce(list_prepend(b::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as r from range(256) x(b)) y"""
BYTES = "list_transform(range(0, strlen({s})), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::bigint)"
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, {bytes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::bigint)"

OP12 = f"""with recursive crc as ({CRC_TABLE}),
runs as (select doc_id, {LOWER.format("run")} as run, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) x where length(run) >= 7 group by 1, 2),
hashed as (select run, n, {CRC.format(bytes=BYTES.format(s="(coalesce(cast(doc_id as varchar), '') || ':' || run)"), table="t")} as h from runs, crc),
kept as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from kept where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as k from words),
holes as (select word, n, k, substr(word, 1, k - 1) as a, substr(word, k + 1) as b from places),
pairs as (select x.word, x.n, y.word as near, y.n as near_n from holes x join holes y on x.a = y.a and x.b = y.b and x.word <> y.word
union select h.word, h.n, w.word, w.n from holes h join words w on w.word = h.a || h.b union select w.word, w.n, h.word, h.n from holes h join words w on w.word = h.a || h.b),
best as (select word, count(*) as n_near, min_by(near, (-near_n, near)) filter (near_n >= 10 * n) as form, max(near_n) filter (near_n >= 10 * n) as form_n from pairs group by word),
found as (select w.word, w.n, b.form, coalesce(b.n_near, 0) as n_near, b.form_n from words w left join best b on b.word = w.word),
chain as (select word, word as root, 0 as step from found union all select c.word, f.form, c.step + 1 from chain c join found f on f.word = c.root where f.form is not null),
roots as (select word, max_by(root, step) as root from chain group by word)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from found f join roots r on r.word = f.word"""

OP13 = f"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\n\x0b\x0c\r]')) as piece from documents where text is not null),
lists as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as words from pieces),
grams as (select lang, words, unnest(range(1, len(words) + 1)) as i from lists),
counts as (select lang, phrase, size, count(*) as f from (select lang, array_to_string(words[i : i + size - 1], ' ') as phrase, size from grams, range(1, 5) s(size) where i + size - 1 <= len(words)) x group by 1, 2, 3),
totals as (select lang, sum(f)::bigint as n from counts where size = 1 group by lang),
candidates as (select *, string_split(phrase, ' ') as words from counts where size > 1 and f >= 30),
inner_ones as (select lang, f, unnest([array_to_string(words[1 : size - 1], ' '), array_to_string(words[2 : size], ' ')]) as phrase from candidates where size > 2),
taken as (select lang, phrase, max(f) as longer from inner_ones group by 1, 2),
kept as (select c.* from candidates c left join taken t on t.lang = c.lang and t.phrase = c.phrase where t.longer is null or 100 * t.longer < 80 * c.f),
cuts as (select k.lang, k.phrase, k.f as a, c.cut, l.f as l, r.f as r, ((2000000::hugeint * k.f) // (l.f + r.f))::bigint as score from kept k join range(1, 4) c(cut) on c.cut < k.size
join counts l on l.lang = k.lang and l.size = c.cut and l.phrase = array_to_string(k.words[1 : c.cut], ' ') join counts r on r.lang = k.lang and r.size = k.size - c.cut and r.phrase = array_to_string(k.words[c.cut + 1 : k.size], ' ')),
lowest as (select lang, phrase, a, l, r, score from (select *, row_number() over (partition by lang, phrase order by score, cut) as place from cuts) x where place = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join totals t on t.lang = r.lang where r.rank <= 2000"""

ORACLES = {"op5_warc": OP5, "op6_ngram_join": OP6, "op12_spelling_variants": OP12, "op13_collocations": OP13}
