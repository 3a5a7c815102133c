"""SQL that recomputes the text queries that SQL can express, for checking.

The others have no SQL form: XXH64 (op1, op2, op5), a tokenizer (op3) and trained models (op4, op9,
op10, pipeline) are held against brute force or held-out labels in the tests.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
with docs as (
  select doc_id, source, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
         string_split(coalesce(text, ''), chr(10)) as lines
  from documents),
cut as (
  select doc_id, source, body, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs),
counted as (
  select doc_id, source, body, line, place, regexp_extract_all(line, '{WORD}') as own from cut),
keyed as (
  select doc_id, source, body, line, place, len(own) as n,
         translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from counted where len(own) > 0),
dup as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines from keyed group by doc_id),
common as (
  select source, key from keyed group by source, key having count(distinct body) > 10),
lost as (
  select doc_id, sum(n) as lost, count(distinct key) as n_common_lines from keyed join common using (source, key) group by doc_id),
grams as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from docs where len(words) >= 8)),
twice as (
  select doc_id, gram from grams group by doc_id, gram having count(*) > 1),
covered as (
  select doc_id, count(distinct j) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as j from grams join twice using (doc_id, gram)) group by doc_id),
measured as (
  select d.doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(n_common_lines, 0)::bigint as n_common_lines, (len(words) - coalesce(lost, 0))::bigint as words_left
  from docs d left join dup using (doc_id) left join covered using (doc_id) left join lost using (doc_id))
select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and words_left >= 0.3 * n_words as kept
from measured
"""


def _mixing() -> str:
    """The tree of domains, languages and sources, level by level, and then each leaf's prefix."""
    levels = ("domain", "lang", "source")
    out = rf"""
with docs as (
  select doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens,
         'd' || (crc % 4)::bigint as domain,
         (case lang when 'en' then 4 when 'de' then 3 when 'fr' then 2 else 1 end * (crc % 5 + 1))::bigint as weight
  from documents join (select distinct source as s, {_crc32("coalesce(source, '')")} as crc from documents) on source is not distinct from s),
leaves as (
  select domain, lang, source, max(weight) as w, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * 4)::bigint as cap from docs group by all),
given0 as (select cast(floor(sum(tokens) * 0.6) as bigint) as given from leaves)"""
    for n in range(1, len(levels) + 1):
        path, parent = ", ".join(levels[:n]), ", ".join(levels[:n - 1])
        part = f"partition by {parent}" if parent else ""
        join = f"join given{n - 1} using ({parent})" if parent else "cross join given0"
        out += f""",
nodes{n} as (
  select *, coalesce(sum(cap) over ({part} order by cap::double / w, {path} rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over ({part} order by cap::double / w, {path} rows between current row and unbounded following) as remaining
  from (select {path}, sum(cap)::bigint as cap, sum(w)::bigint as w from leaves group by {path}) {join}),
full{n} as (
  select *, min((cap::hugeint * remaining <= greatest(given - before, 0)::hugeint * w)::int)
              over ({part} order by cap::double / w, {path} rows between unbounded preceding and current row) = 1 as is_full from nodes{n}),
taken{n} as (
  select *, coalesce(sum(case when is_full then cap end) over ({part}), 0) as taken,
         coalesce(sum(case when not is_full then w end) over ({part}), 1) as open from full{n}),
given{n} as (
  select {path}, (case when is_full then cap else ((given - taken)::hugeint * w) // open end)::bigint as given from taken{n})"""
    return out + """,
plan as (
  select domain, lang, source, given // greatest(tokens, 1) as whole, given % greatest(tokens, 1) as rest
  from leaves join given3 using (domain, lang, source)),
ordered as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('42:' || whole || ':' || doc_id), doc_id
                                         rows between unbounded preceding and 1 preceding), 0) as begin
  from docs join plan using (domain, lang, source))
select doc_id, domain, lang, source, unnest(range(0, whole + (begin < rest)::int))::int as epoch, n_tokens from ordered
"""


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a short text: bit by bit, as DuckDB has no function for it."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda r, k: case when r % 2 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)"
    each = f"list_transform(range(1, 2 * length({text}), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::bigint)"
    folded = f"list_reduce(list_concat([4294967295::bigint], {each}), lambda c, b: {step})"
    return f"xor({folded}, 4294967295::bigint)"


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Every score, without lists: postings of all documents joined with the terms of all items.
RANKED = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as terms from documents),
sums as (
  select count(*)::bigint as n_docs, sum(len(terms))::bigint as n_all from docs where len(terms) > 0),
postings as (
  select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from docs) group by r, term),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::double))::bigint as w from postings, sums group by term, n_docs),
asked as (
  select q, item_id, term, count(*)::bigint as times
  from (select q, item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
        from (select *, row_number() over () as q from (select distinct item_id, text from benchmark))) group by q, item_id, term),
lengths as (
  select r, doc_id, 75 + (25 * len(terms) * n_docs) // n_all as m from docs, sums where len(terms) > 0),
scores as (
  select q, item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join weights using (term) join postings using (term) join lengths using (r) group by q, item_id, r, doc_id)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scores where score > 0)
where rank <= 20
"""

# All spans of all documents, without fingerprints.
SHARED = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select distinct item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
spans as (
  select distinct item_id, least(len(w), 10) as n,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) as span
  from items where len(w) > 0),
places as (
  select r, w, n, unnest(range(1, (len(w) - n + 2)::bigint)) as i from docs, (select distinct n from spans) where len(w) >= n),
hits as (
  select r, i, n, item_id from (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as span from places) join spans using (n, span)),
hit_words as (
  select r, count(distinct j)::bigint as n_hit from (select r, unnest(range(i, i + n)) as j from hits) group by r),
hit_items as (
  select r, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item_id::varchar as item from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit_words using (r) left join hit_items using (r)
"""

SQL: dict[str, str] = {"op7_mixing": _mixing(), "op8_quality": QUALITY, "op11_best_position": RANKED, "op12_winnowing": SHARED}
