"""Equivalent SQL of the queries that SQL can express."""

from __future__ import annotations

from hypomill.llm import split_overlap
from hypomill.llm.text_quality import COMMON_WORDS
from hypomill.plans.sql import edits

_LINES = r"""
lines as (
  select line_id, json_extract_string(payload, '$.utt_id') as u, cast(json_extract_string(payload, '$.rank') as double) as r,
         lower(regexp_replace(json_extract_string(payload, '$.text_raw'), '[^\p{L}\p{N}]+', '', 'g')) as t
  from hypothesis_lines),
hashed as (
  select line_id, u, r, t, min(line_id) over (partition by u, r, t) as first_line_id, count(*) over (partition by u, r, t) as copies
  from lines where u is not null or r is not null or t is not null)
"""

# All pairs of outputs are compared, score by score, so the sums of the operator meet none of its own steps here.
_RANKING = """
with long as (
  select output_id as id, coalesce(ec_system_id, '') as g, unnest(['ec', 'asr', 'combined']) as s,
    unnest([ec_sequence_score, asr_sequence_score, combined_score]) as v from ec_outputs),
finite as (select * from long where v is not null and not isnan(v) and not isinf(v) and abs(v) not in (9999, 99999)),
ranked as (select g, s, v, count(*) over (partition by g, s order by v) as upto, count(*) over (partition by g, s) as size from finite),
quantiles as (
  select g, s, min(v) filter (upto * 10 >= size) as q1, min(v) filter (upto * 2 >= size) as q5, min(v) filter (upto * 10 >= size * 9) as q9
  from ranked group by g, s),
valid as (select f.* from finite f join quantiles q using (g, s) where abs(v - q5) <= 200 * greatest(q9 - q1, 1e-9)),
placed as (
  select id, s, (2 * count(*) over (partition by g, s order by v) - count(*) over (partition by g, s, v))::hugeint * 1000000000000000
    // (2 * count(*) over (partition by g, s)) as x from valid),
flows as (
  select a.id, a.s, case when count(*) > 1 then
    sum(greatest(-200000000000000, least(200000000000000, a.x - b.x)))::double / (200000000000000::double * (count(*) - 1)) else 0.0 end as flow
  from placed a join placed b using (s) group by a.id, a.s),
net as (
  select o.output_id, count(flow) as n_scores, round(sum(flow) / nullif(count(flow), 0), 9) as net_flow
  from ec_outputs o left join flows f on f.id = o.output_id group by 1)
select output_id, n_scores, net_flow, rank() over (order by coalesce(cast(round(net_flow * 1000000000) as bigint), -2000000000) desc) as rank
from net
"""


def _statistics() -> str:
    common = ", ".join("'" + w + "'" for w in sorted(COMMON_WORDS))
    return rf"""
with base as (
  select doc_id, coalesce(text, '') as t from documents),
parts as (
  select doc_id,
    list_filter(string_split(regexp_replace(t, '[^\p{{L}}]+', ' ', 'g'), ' '), lambda w: w <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')) as l,
    length(regexp_replace(t, '[ \t\r\n]+', '', 'g')) as solid,
    length(regexp_replace(t, '[\p{{L}}\p{{N}} \t\r\n]+', '', 'g')) as symbols,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) as letters
  from base)
select doc_id, len(w) as words,
  case when len(w) > 0 then round(letters / len(w), 6) end as mean_word_length,
  case when solid > 0 then round(symbols / solid, 6) end as symbol_ratio,
  case when len(l) > 0 then round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][ \t\r]*$'))) / len(l), 6) end as line_end_share,
  case when len(w) > 0 then round(len(list_filter(w, lambda x: lower(x) in ({common}))) / len(w), 6) end as common_share
from parts
"""


# Every admitted pair of texts shares four words in a row: at most 15 % edits leave a stretch of four untouched.
_NEAR = rf"""
rows as (
  select row_id, utt_id, dataset, split, coalesce(starts_with(lower(trim(split)), 'train'), false) as train,
    array_to_string(regexp_extract_all(lower(reference_normalized), '[\p{{L}}\p{{N}}]+'), ' ') as t
  from data_manifest),
texts as (select t, bool_or(train) as has_train, bool_or(not train) as has_eval, string_split(t, ' ') as w from rows where len(string_split(t, ' ')) >= {split_overlap.MIN_WORDS} group by t),
grams as (select distinct t, has_train, has_eval, array_to_string(w[i:i + 3], ' ') as g from (select *, unnest(range(1, len(w) - 2)) as i from texts)),
candidates as (select distinct a.t as rf, b.t as hy from grams a join grams b using (g) where a.has_eval and b.has_train and a.t <> b.t),
{edits('candidates')},
near as (
  select rf, hy from edits where (substitutions + deletions + insertions) * 100 <= {split_overlap.EDIT_PERCENT} * greatest(len(string_split(rf, ' ')), len(string_split(hy, ' ')))
  union all select t, t from texts where has_train and has_eval),
pairs as (
  select distinct least(e.row_id, t.row_id) as row_a, greatest(e.row_id, t.row_id) as row_b from near join rows e on e.t = rf and not e.train join rows t on t.t = hy and t.train
  union select least(e.row_id, t.row_id), greatest(e.row_id, t.row_id) from rows e join rows t using (utt_id) where not e.train and t.train)
"""

SQL: dict[str, str] = {
    "p4_found": f"with recursive {_NEAR} select row_a, row_b from pairs",
    "p4_overlap_counts": f"""with recursive {_NEAR}
select dataset, replace(lower(trim(split)), '_', '-') as split, count(*) as pairs, count(distinct row_id) as rows
from (select unnest([row_a, row_b]) as row_id from pairs) join rows using (row_id) where not train group by all""",
    "p4_row_links": f"""with recursive {_NEAR},
counted as (select t, count(*) filter (train) as nt, count(*) filter (not train) as ne, min(row_id) as class_id from rows group by t),
facing as (select rf as t, false as train, c.nt as n from near join counted c on c.t = hy union all select hy, true, c.ne from near join counted c on c.t = rf)
select r.row_id, any_value(c.class_id) as class_id, cast(coalesce(sum(f.n), 0) as bigint) as links
from rows r join counted c using (t) left join facing f on f.t = r.t and f.train = r.train where len(string_split(r.t, ' ')) >= {split_overlap.MIN_WORDS} group by 1""",
    "p1_ranking": _RANKING,
    "p5_found": f"with {_LINES} select first_line_id, line_id from hashed where first_line_id < line_id",
    "p5_distinct_hypotheses": f"with {_LINES} select distinct first_line_id as line_id, copies from hashed",
    "p9_statistics": _statistics(),
}
