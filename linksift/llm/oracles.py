"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
with texts as (
  select row_number() over () as row_no, doc_id, coalesce(text, '') as text from documents
), measured as (
  select row_no, doc_id, text,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts
), spans as (
  select row_no, unnest(range(1, len(words) - 1)) as pos, words from measured
), windows as (
  select row_no, pos, count(*) over (partition by row_no, words[pos], words[pos + 1], words[pos + 2]) as times
  from spans
), repeated as (
  select row_no, count(distinct pos + shift) as n_repeat_words
  from windows, range(0, 3) as s(shift) where times > 1 group by row_no
), counted as (
  select doc_id, len(words) as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
    length(regexp_replace(text, '[^a-z]', '', 'g')) as n_lower,
    len(lines) as n_lines
  from measured left join repeated using (row_no)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words)
    and not (n_upper > n_lower and n_upper > n_words)
    and not (2 * n_dup_lines > n_lines) and not (word_chars > 20 * n_words) as kept
from judged
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op5_decontaminated"] = rf"""
with docs as (
  select row_number() over () as row_no, doc_id, {_ITEM_WORDS} as words from documents
), items as (
  select item_id, words, least(13, len(words)) as size
  from (select item_id, {_ITEM_WORDS} as words from benchmark) where len(words) > 0
), windows as (
  select distinct item_id, size, array_to_string(words[pos:pos + size - 1], ' ') as phrase
  from (select *, unnest(range(1, len(words) - size + 2)) as pos from items)
), places as (
  select row_no, size, pos, array_to_string(words[pos:pos + size - 1], ' ') as phrase
  from (select row_no, words, size, unnest(range(1, len(words) - size + 2)) as pos
        from docs, (select distinct size from windows))
), hits as (
  select row_no, pos, size, item_id from places join windows using (size, phrase)
), covered as (
  select row_no, count(distinct pos + shift) as n_hit
  from (select row_no, pos, unnest(range(size)) as shift from hits) group by row_no
), named as (
  select row_no, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct row_no, item_id::varchar as item from hits where item_id is not null)
  group by row_no
)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join covered using (row_no) left join named using (row_no)
"""

ORACLES["op7_near_duplicates"] = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as words from documents
), shingles as (
  select distinct doc_id, array_to_string(words[pos:pos + 3], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as pos
        from docs where len(words) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), links as (
  select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * common >= 80 * (a.n + b.n - common)
), reach(doc_id, other) as (
  select x, y from links union select doc_id, y from reach join links on other = x
), lowest as (
  select doc_id, min(other) as other from reach group by doc_id
)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, other) as component_id,
  doc_id = least(doc_id, other) as kept
from docs left join sizes using (doc_id) left join lowest using (doc_id)
"""

ORACLES["op9_similar_lines"] = r"""
with cut as (
  select doc_id, text is null as is_null, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as no
  from documents
), lines as (
  select *, row_number() over (order by doc_id, no) as place,
    list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
  from cut
), words as (
  select place, len(words) as n, unnest(words) as word from lines where len(words) > 0
), ranked as (
  select w.place, w.word, row_number() over (partition by w.place order by f.times, w.word) as spot, w.n
  from words w join (select word, count(*) as times from words group by word) f using (word)
), prefix as (
  select place, word, n from ranked where spot <= n - (4 * n + 4) // 5 + 1
), candidates as (
  select distinct a.place as later, b.place as earlier from prefix a join prefix b
  on a.word = b.word and b.place < a.place and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
), removed as (
  select distinct later as place from (
    select later, len(list_intersect(a.words, b.words)) as common, len(a.words) + len(b.words) as total
    from candidates join lines a on a.place = later join lines b on b.place = earlier)
  where 100 * common >= 80 * (total - common)
)
select doc_id, case when any_value(is_null) then 0 else count(*) end as n_lines,
  count(r.place) as n_removed,
  case when not any_value(is_null) then
    sha256(coalesce(string_agg(line, chr(10) order by no) filter (where r.place is null), '')) end as kept_sha256
from lines left join removed r using (place) group by doc_id
"""

ORACLES["op10_repeated_spans"] = r"""
with texts as (
  select row_number() over () as row_no, doc_id, hex(encode(coalesce(text, ''))) as digits from documents
), starts as (
  select row_no, pos, md5(substr(digits, 2 * pos + 1, 800)) as content
  from (select row_no, digits, unnest(range(length(digits) // 2 - 399)) as pos
        from texts where length(digits) >= 800)
), twins as (
  select row_no, pos from starts
  where content in (select content from starts group by content having count(*) > 1)
), marked as (
  select *, pos > coalesce(max(pos + 400) over (partition by row_no order by pos
    rows between unbounded preceding and 1 preceding), -1) as begins
  from twins
), spans as (
  select row_no, min(pos) as a, max(pos) + 400 as b
  from (select *, sum(begins::int) over (partition by row_no order by pos) as span from marked)
  group by row_no, span
), gaps as (
  select row_no, coalesce(lag(b) over (partition by row_no order by a), 0) as a, a as b from spans
  union all select row_no, max(b), null from spans group by row_no
), kept as (
  select row_no, string_agg(substr(digits, 2 * g.a + 1,
    2 * (coalesce(g.b, length(digits) // 2) - g.a)), '' order by g.a) as left_over
  from gaps g join texts using (row_no) group by row_no
), sums as (
  select row_no, count(*) as n_spans, sum(b - a)::bigint as n_removed from spans group by row_no
)
select doc_id, length(digits) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed,
  coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_over, digits))) as kept_sha256
from texts left join sums using (row_no) left join kept using (row_no)
"""


def _merkle() -> str:
    """The levels of a Merkle manifest, written out for groups of up to 8 ** 8 leaves."""

    def field(column: str) -> str:
        text = f"cast({column} as varchar)"
        return f"coalesce(octet_length(encode({text}))::varchar || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    bits = "list_reduce(list_prepend(xor(acc, byte), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda acc, byte: {bits}), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves as (
  select doc_id, lang, {leaf("text")} as leaf,
    case when ({crc}) % 3 = 0 then {leaf(lowered)} else {leaf("text")} end as changed
  from documents
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as rows
  from leaves
), a0 as (select lang as grp, place, leaf as hash, rows from placed)"""
    ]

    def climb(name: str) -> None:
        for level in range(8):
            parts.append(f"""{name}s{level} as (
  select grp, place // 8 as slot, rows, list(hash order by place) as kids from {name}{level} where rows > 1 group by all
), {name}{level + 1} as (
  select grp, slot as place, sha256(array_to_string(kids, '')) as hash, (rows + 7) // 8 as rows from {name}s{level}
)""")

    climb("a")
    ends = " union all ".join(f"select grp, hash from a{level} where rows = 1" for level in range(9))
    parts.append(f"""subroots as (select grp, hash from ({ends})), b0 as (
  select 0 as grp, row_number() over (order by grp nulls first) - 1 as place, hash, count(*) over () as rows, grp as lang from subroots
)""")
    climb("b")
    root = " union all ".join(f"select hash from b{level} where rows = 1" for level in range(9))
    parts.append(f"root as (select hash as root from ({root}))")
    parts.append("""w0 as (
  select p.doc_id, p.leaf, p.changed as node, '' as proof, p.lang, p.place, b0.place as top, b0.hash as subroot
  from placed p join b0 on p.lang is not distinct from b0.lang
)""")
    step, last = 0, "place"
    for name, key in (("a", "lang"), ("b", "0")):
        for level in range(8):
            at = last if name == "a" else "top"
            parts.append(f"""w{step + 1} as (
  select w.doc_id, w.leaf, case when kids is null then w.node
      else sha256(array_to_string(kids[:{at} % 8] || [w.node] || kids[{at} % 8 + 2:], '')) end as node,
    case when kids is null then proof else proof || array_to_string(kids[:{at} % 8] || kids[{at} % 8 + 2:], '') end as proof,
    w.lang, {"w.place // 8 as place, w.top" if name == "a" else "w.place, w.top // 8 as top"}, w.subroot
  from w{step} w left join {name}s{level} s on s.grp is not distinct from {"w.lang" if name == "a" else "0"} and s.slot = w.{at} // 8
)""")
            step += 1
    return "with " + ", ".join(parts) + f"""
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified
from w{step}, root"""


ORACLES["op11_merkle_manifest"] = _merkle()

ORACLES["op12_hard_negatives"] = r"""
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from vectors a, vectors b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
