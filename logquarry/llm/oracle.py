"""DuckDB SQL with the rows of those queries that SQL can express."""

LINE_DEDUP = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.line, k.pos, c.key is not null and k.doc_id <> c.keeper as dropped
  from keyed k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

LEXICAL_SEARCH = r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), lengths as (
  select doc_id, count(*) as n from doc_terms group by doc_id
), totals as (
  select count(*) as docs, sum(n)::bigint as terms from lengths
), item_terms as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark)
  group by item_id, term
), postings as (
  select doc_id, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by doc_id, term
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from postings group by term), totals
), scored as (
  select item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
  from item_terms join postings using (term) join weights using (term) join lengths using (doc_id), totals
  group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0
qualify rank <= 10
"""

COLLOCATIONS = r"""
with texts as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words
  from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts)
), spots as (
  select lang, words, unnest(range(1, len(words) + 1)) as pos from pieces
), grams as (
  select lang, k as size, words[pos:pos + k - 1] as words
  from spots, (values (1), (2), (3)) sizes(k) where pos + k - 1 <= len(words)
), counts as (
  select lang, size, words, count(*) as f from grams group by lang, size, words
), totals as (
  select lang, sum(f)::bigint as n from counts where size = 1 group by lang
), candidates as (
  select lang, size, words, f as a from counts where size > 1 and f >= 10
), halves as (
  select lang, size, words, a, k, words[1:k] as head, words[k + 1:size] as tail
  from candidates, (values (1), (2)) cut(k) where k < size
), cuts as (
  select h.lang, size, h.words, a, k, l.f as l, r.f as r,
         ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score
  from halves h
  join (select lang, words, f from counts where f >= 10) l on l.lang = h.lang and l.words = head
  join (select lang, words, f from counts where f >= 10) r on r.lang = h.lang and r.words = tail
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, words order by score, k) = 1
), inside as (
  select distinct c.lang, c.words
  from candidates c
  join (select lang, words[1:2] as part, a from candidates where size = 3
        union all select lang, words[2:3], a from candidates where size = 3) b
    on b.lang = c.lang and b.part = c.words
  where c.size = 2 and 100 * b.a >= 50 * c.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
       phrase, a, l, r, n, score
from (select lang, array_to_string(words, ' ') as phrase, a, l, r, n, score
      from lowest join totals using (lang) anti join inside using (lang, words))
qualify rank <= 2000
"""
