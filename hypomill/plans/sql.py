"""Equivalent SQL of the core queries, for an independent engine over the same tables."""

from __future__ import annotations

from hypomill.functions.alignment import _STEP_DEL, _STEP_INS, _STEP_SUB
from hypomill.operators.selection import GRID, POISSON_ONE
from hypomill.plans.queries import N
from hypomill.schemas import PARSER_STATUSES, SCORE_TYPES


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({x}), '‘’', ''''''), '[^\p{{L}}\p{{N}}'']', ' ', 'g'), ' +', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def chars(x: str) -> str:
    return f"list_filter(string_split(replace({x}, ' ', ''), ''), lambda w: w <> '')"


_RATE = "case when reference_tokens > 0 then errors / reference_tokens when errors = 0 then 0.0 end"

_CAND = """
cand as (
  select record_id, utt_id, dataset, split, system_id, reference, text_raw, logscore, tokens,
    row_number() over (partition by record_id order by stored_rank, pos) as rank, count(*) over (partition by record_id) as n
  from (
    select record_id, utt_id, dataset, split, asr.system_id as system_id, reference.raw as reference, h.text_raw as text_raw, h.sequence_logscore as logscore,
      coalesce(len(h.token_ids), 0) as tokens, coalesce(h.rank, 2147483647) as stored_rank, pos
    from (select *, unnest(asr.hypotheses) as h, generate_subscripts(asr.hypotheses, 1) as pos from utterance_records where reference.raw is not null))
  where text_raw is not null)"""


def edits(pairs: str, split=words) -> str:
    """CTEs that end in edits(rf, hy, substitutions, deletions, insertions, reference_tokens) for the pairs (rf, hy) of a CTE."""
    return f"""
todo as (select distinct rf, hy, {split('rf')} as r, {split('hy')} as h from {pairs} where rf is not null and hy is not null),
steps as (
  select rf, hy, r, h, 0 as k, list_transform(range(0, len(h) + 1), lambda j: j * {_STEP_INS}) as row from todo
  union all
  select rf, hy, r, h, k + 1, list_reduce(list_prepend([row[1] + {_STEP_DEL}], list_transform(range(1, len(h) + 1), lambda j: [j])), lambda acc, x: list_append(acc,
    case when h[x[1]] = r[k + 1] then row[x[1]]
      when (row[x[1]] >> 48) <= (row[x[1] + 1] >> 48) and (row[x[1]] >> 48) <= (acc[-1] >> 48) then row[x[1]] + {_STEP_SUB}
      when (row[x[1] + 1] >> 48) <= (acc[-1] >> 48) then row[x[1] + 1] + {_STEP_DEL}
      else acc[-1] + {_STEP_INS} end))
  from steps where k < len(r)),
edits as (
  select rf, hy, cast((row[-1] >> 32) & 65535 as int) as substitutions, cast((row[-1] >> 16) & 65535 as int) as deletions,
    cast(row[-1] & 65535 as int) as insertions, cast(len(r) as int) as reference_tokens
  from steps where k = len(r))"""


def scored(split=words, where: str = "true") -> str:
    """CTEs that end in scored: candidates with their edit counts."""
    return f"""{_CAND},
texts as (select *, {norm('reference')} as rf, {norm('text_raw')} as hy from cand where {where}),
{edits('texts', split)},
scored as (select t.*, substitutions, deletions, insertions, reference_tokens, substitutions + deletions + insertions as e from texts t join edits using (rf, hy))"""


def corpus(source: str, *keys: str, where: str = "true") -> str:
    k = ", ".join(keys) + (", " if keys else "")
    group = f"group by {', '.join(keys)}" if keys else ""
    return f"""select *, {_RATE} as error_rate from (select *, substitutions + deletions + insertions as errors from (
  select {k}cast(count(*) as bigint) as utterances, cast(coalesce(sum(substitutions), 0) as bigint) as substitutions, cast(coalesce(sum(deletions), 0) as bigint) as deletions,
    cast(coalesce(sum(insertions), 0) as bigint) as insertions, cast(coalesce(sum(reference_tokens), 0) as bigint) as reference_tokens
  from {source} where {where} {group}))"""


_ORACLE = "best as (select * from (select *, row_number() over (partition by record_id order by e, rank) as o from scored) where o = 1)"
_BEAMS = "select record_id, rank as original_index, tokens, logscore as s from cand where tokens > 0 and logscore is not null and not isnan(logscore) and not isinf(logscore)"
_EC = "-((('0x' || substr(md5(record_id || ':' || rank), 1, 6))::bigint % 1000) / 100.0)"
_DECODABLE = f"""rows as (
  select * from (select *, {_EC} as ec_score, max(case when logscore is null or isnan(logscore) or isinf(logscore) then 1 else 0 end) over (partition by record_id) as bad from scored) where bad = 0)"""
_CURVE = f"""grid as (select k / 20 as lmb from range(0, {len(GRID)}) t(k)),
chosen as (select * from (select *, row_number() over (partition by lmb, record_id order by lmb * ec_score + (1.0 - lmb) * logscore desc, ec_score desc, rank, text_raw desc) as o from rows, grid) where o = 1)"""
_UNIQUE = f"""
lists as (select record_id, system_id, text_raw, {norm('text_raw')} as t, rank from cand where rank <= {N}),
first_norm as (select record_id, system_id, t, min(rank) as at from lists group by all)"""
_CROSS = f"""{_CAND}, {_UNIQUE},
crossed as (select a.system_id as system_id, a.t as rf, b.t as hy from first_norm a join first_norm b on a.record_id = b.record_id and a.at < b.at),
{edits('crossed')},
cross_scored as (select c.*, substitutions, deletions, insertions, reference_tokens from crossed c join edits using (rf, hy))"""


def _count_rules(source: str, rules: dict[str, str]) -> str:
    each = " union all ".join(f"select '{name}' as violation, count(*) as rows from {source} where coalesce({bad}, true)" for name, bad in rules.items())
    return each


def _blank(*names: str) -> str:
    return " or ".join(f"({n} is null or trim({n}) = '')" for n in names)


def _not_finite(x: str) -> str:
    return f"coalesce(isnan({x}) or isinf({x}), false)"


def _any(test: str) -> str:
    return f"coalesce(list_bool_or(list_transform(asr.hypotheses, lambda h: coalesce({test}, true))), false)"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _serialized(separator: str, order: str) -> str:
    return f"with {_CAND} select record_id, string_agg(text_raw, ' {separator} ' order by {order}) as source_text from cand group by 1"


def _standard(x: str) -> str:
    return f"case when stddev_pop({x}) over (partition by record_id) > 1e-12 then round(({x} - avg({x}) over (partition by record_id)) / stddev_pop({x}) over (partition by record_id), 12) else 0.0 end"


_NEG = "coalesce({} < 0, false)"
_BOOT_U = "((('0x' || substr(md5('7:' || (replicate // 4) || ':' || record_id), 1 + 8 * (replicate % 4), 8))::bigint + 0.5) / 4294967296.0)"
_FIRST_ORACLE = f"""{_ORACLE},
both_sides as (select f.record_id, f.system_id, f.e as ea, f.reference_tokens as ra, b.e as eb, b.reference_tokens as rb from scored f join best b using (record_id) where f.rank = 1)"""
_BOOT = f"""{scored()}, {_FIRST_ORACLE},
drawn as (select replicate, ea, eb, ra, {' + '.join(f'case when u > {p!r}::double then 1 else 0 end' for p in POISSON_ONE)} as w from (select *, {_BOOT_U} as u from both_sides, range(0, 200) t(replicate))),
sums as (select replicate, cast(sum(w * ea) as bigint) as errors_a, cast(sum(w * eb) as bigint) as errors_b, cast(sum(w * ra) as bigint) as tokens from drawn group by 1)"""
_SPLIT = "replace(lower(trim(split)), '_', '-')"

# What stands in place of an array is its only element; JSON text that holds JSON text is opened once.
_NODES = """
hyps as (select record_id, h, pos - 1 as hyp_pos from (select record_id, unnest(asr.hypotheses) as h, generate_subscripts(asr.hypotheses, 1) as pos from utterance_records)),
valid as (select record_id, hyp_pos, case when json_valid(h.metadata) then h.metadata else '{}' end as m from hyps),
once as (select record_id, hyp_pos, case when json_type(m) = 'VARCHAR' then json_extract_string(m, '$') else m end as m from valid),
opened as (select record_id, hyp_pos, case when json_valid(m) then m else '{}' end as m from once),
found as (select record_id, hyp_pos, t.value as v, t.type as kind from opened, json_tree(m) t where t.key = 'segments'),
segments as (
  select record_id, hyp_pos, unnest(e) as s, generate_subscripts(e, 1) - 1 as pos_one
  from (select *, case kind when 'ARRAY' then from_json(v, '["JSON"]') when 'OBJECT' then [v::json] else [] end as e from found)),
words as (
  select record_id, hyp_pos, pos_one, unnest(e) as w, generate_subscripts(e, 1) - 1 as pos_two
  from (select *, case json_type(s, '$.words') when 'ARRAY' then from_json(json_extract(s, '$.words'), '["JSON"]') when 'OBJECT' then [json_extract(s, '$.words')] else [] end as e from segments where json_type(s) = 'OBJECT'))
"""

SQL: dict[str, str] = {
    "p6_found": f"""with {_NODES}
select 'hypothesis' as child, record_id, cast(hyp_pos as int) as hyp_pos, -1 as pos_one, -1 as pos_two from hyps
union all select 'logprob', record_id, cast(hyp_pos as int), cast(pos - 1 as int), -1 from (select record_id, hyp_pos, generate_subscripts(h.token_logprobs, 1) as pos from hyps)
union all select 'word', record_id, cast(hyp_pos as int), cast(pos_one as int), cast(pos_two as int) from words""",
    "p6_words": f"""with {_NODES}
select record_id, cast(hyp_pos as int) as hyp_pos, cast(pos_one as int) as segment, cast(pos_two as int) as position,
  case when json_type(w) = 'OBJECT' then w ->> '$.w' else w ->> '$' end as word, case when json_type(w) = 'OBJECT' then cast(w ->> '$.p' as double) end as probability from words""",
    "p6_logprobs": f"""with {_NODES}
select record_id, cast(hyp_pos as int) as hyp_pos, cast(pos - 1 as int) as position, h.token_logprobs[pos] as logprob
from (select record_id, hyp_pos, h, unnest(generate_series(1, len(h.token_logprobs))) as pos from hyps)""",
    "p6_word_links": f"""with {_NODES}
select record_id, cast(hyp_pos as int) as hyp_pos, count(*) as words, cast(sum(cast(round(cast(w ->> '$.p' as double) * 1000) as bigint)) as bigint) as thousandths from words group by all""",
    "normalize_text": f"select row_id, {norm('reference_raw')} as normalized from data_manifest",
    "token_counts": f"""select dataset, count(*) as rows, cast(sum(len({words('t')})) as bigint) as words, cast(sum(len({chars('t')})) as bigint) as characters
        from (select dataset, {norm('reference_raw')} as t from data_manifest where reference_raw is not null) group by 1""",
    "alignment_counts": f"with recursive {scored()} select record_id, cast(rank as int) as rank, substitutions, deletions, insertions, reference_tokens from scored",
    "alignment_trace": f"""with recursive {_CAND},
texts as (select *, {norm('reference')} as rf, {norm('text_raw')} as hy from cand),
{edits('texts')},
rows as (select rf, hy, k, row from steps),
walk as (
  select rf, hy, r, h, len(r) as i, len(h) as j, 0 as back, null::varchar as op, null::varchar as ref, null::varchar as hyp from steps where k = 0
  union all
  select rf, hy, r, h, case when way = 'insertion' then i else i - 1 end, case when way = 'deletion' then j else j - 1 end, back + 1, way,
    case when way <> 'insertion' then r[i] end, case when way <> 'deletion' then h[j] end
  from (select w.*, case when i > 0 and j > 0 and r[i] = h[j] then 'correct'
      when i > 0 and j > 0 and (here.row[j + 1] >> 48) = (above.row[j] >> 48) + 1 then 'substitution'
      when i > 0 and (here.row[j + 1] >> 48) = (above.row[j + 1] >> 48) + 1 then 'deletion' else 'insertion' end as way
    from walk w join rows here on here.rf = w.rf and here.hy = w.hy and here.k = w.i left join rows above on above.rf = w.rf and above.hy = w.hy and above.k = w.i - 1
    where i > 0 or j > 0)),
traces as (select rf, hy, op, ref, hyp, max(back) over (partition by rf, hy) - back as pos from walk where back > 0)
select record_id, cast(rank as int) as rank, cast(pos as int) as pos, op, ref, hyp from texts join traces using (rf, hy)""",
    "wer_by_system": f"with recursive {scored(where='rank = 1')} {corpus('scored', 'system_id')}",
    "wer_corpus": f"with recursive {scored(where='rank = 1')} {corpus('scored')}",
    "cer_by_system": f"with recursive {scored(chars, 'rank = 1')} {corpus('scored', 'system_id')}",
    "line_wer_by_rank": f"""with recursive
lines as (select json_extract_string(payload, '$.utt_id') as utt_id, cast(json_extract(payload, '$.rank') as int) as rank, {norm("json_extract_string(payload, '$.text_raw')")} as hy from hypothesis_lines),
refs as (select utt_id, min(reference_raw) as reference from data_manifest where utt_id is not null and reference_raw is not null group by 1),
texts as (select rank, hy, reference, {norm('reference')} as rf from lines left join refs using (utt_id) where lines.utt_id is not null),
{edits('texts')},
line_scored as (select t.rank, substitutions, deletions, insertions, reference_tokens from texts t join edits using (rf, hy))
select c.*, without_reference from ({corpus('line_scored', 'rank')}) c join (select rank, count(*) filter (reference is null) as without_reference from texts group by 1) using (rank)""",
    "correction_diagnostics": f"""with {_CAND},
first as (select utt_id, arg_min(reference, record_id) as reference, arg_min(text_raw, record_id) as text_raw from cand where rank = 1 and utt_id is not null group by 1),
u as (select ec_system_id, f.utt_id is null as lost, {norm('reference')} as r, {norm('text_raw')} as b, {norm('output_raw')} as a from ec_outputs left join first f using (utt_id)),
t as (select * from u where not lost and a is not null),
l as (select ec_system_id, count(*) filter (lost) as without_record from u group by 1)
select *, case when utterances > 0 then exact_copies / utterances else 0.0 end as copy_rate from l left join (
  select ec_system_id, count(*) as utterances, count(*) filter (b = a) as exact_copies, count(*) filter (b = r and a <> r) as correct_to_wrong,
    count(*) filter (b <> r and a = r) as wrong_to_correct, count(*) filter (b <> r and a <> r and b <> a) as wrong_to_other_wrong from t group by 1) using (ec_system_id)""",
    "output_lengths": f"""with refs as (select utt_id, min(reference_raw) as reference from data_manifest where utt_id is not null and reference_raw is not null group by 1),
t as (select ec_system_id, output_raw, truncated, reference, len({words(norm('coalesce(output_raw, ' + chr(39) * 2 + ')'))}) as h, len({words(norm('reference'))}) as r from ec_outputs left join refs using (utt_id))
select *, output_words / nullif(reference_words, 0) as ratio from (
  select ec_system_id, count(*) as outputs, count(*) filter (h = 0) as empty, count(*) filter (truncated) as truncated,
    cast(coalesce(sum(h) filter (reference is not null), 0) as bigint) as output_words, cast(coalesce(sum(r), 0) as bigint) as reference_words from t group by 1)""",
    "werr_by_system": f"""with recursive {scored()}, {_ORACLE}
select system_id, b.error_rate as baseline, o.error_rate as oracle, case when b.error_rate > 0 then (b.error_rate - o.error_rate) / b.error_rate * 100.0 end as werr
from ({corpus('scored', 'system_id', where='rank = 1')}) b join ({corpus('best', 'system_id')}) o using (system_id)""",
    "oracle_selection": f"with recursive {scored()}, {_ORACLE} select record_id, cast(rank as int) as rank, text_raw, substitutions, deletions, insertions, reference_tokens from best",
    "oracle_by_n": f"""with recursive {scored()},
cuts as (select unnest(list_distinct([1, least(5, m), m])) as requested_n from (select cast(max(rank) as int) as m from scored)),
at_n as (select * from (select *, row_number() over (partition by requested_n, record_id order by e, rank) as o from scored, cuts where rank <= requested_n) where o = 1)
{corpus('at_n', 'requested_n')}""",
    "average_unique": f"""with {_CAND}, {_UNIQUE},
per as (select record_id, system_id, count(distinct text_raw) as r, count(distinct t) as m, count(*) filter (t = '') as empty from lists group by all)
select system_id, count(*) as utterances, sum(r) / count(*) as average_raw_unique, sum(m) / count(*) as average_normalized_unique, cast(sum(empty) as bigint) as empty_candidates from per group by 1""",
    "cross_wer": f"with recursive {_CROSS} {corpus('cross_scored', 'system_id')}",
    "nbest_evaluation": f"""with recursive {scored(where=f'rank <= {N}')},
cuts as (select unnest(list_distinct([1, least(5, m), m])) as requested_n from (select least({N}, cast(max(rank) as int)) as m from scored)),
at_n as (select * from (select *, row_number() over (partition by requested_n, record_id order by e, rank) as o from scored, cuts where rank <= requested_n) where o = 1),
{_UNIQUE},
per as (select record_id, count(distinct text_raw) as r, count(distinct t) as m, count(*) filter (t = '') as empty from lists group by all),
crossed as (select a.t as crf, b.t as chy from first_norm a join first_norm b on a.record_id = b.record_id and a.at < b.at),
{edits('(select crf as rf, chy as hy from crossed)').replace('todo as', 'todo2 as').replace('from todo', 'from todo2').replace('steps', 'steps2').replace('edits as', 'edits2 as')},
cross_scored as (select substitutions, deletions, insertions, reference_tokens from crossed c join edits2 x on x.rf = c.crf and x.hy = c.chy)
select 'baseline' as metric, 1 as n, error_rate as value, errors, reference_tokens as tokens from ({corpus('scored', where='rank = 1')})
union all select 'oracle', requested_n, error_rate, errors, reference_tokens from ({corpus('at_n', 'requested_n')})
union all select 'average_raw_unique', {N}, sum(r) / count(*), null, null from per
union all select 'average_normalized_unique', {N}, sum(m) / count(*), null, null from per
union all select 'empty_candidates', {N}, cast(sum(empty) as double), null, null from per
union all select 'cross', {N}, error_rate, errors, reference_tokens from ({corpus('cross_scored')})""",
    "prefix_counts": f"with {_CAND} select record_id, cast(count(*) as int) as n, cast(least(count(*), 3) as int) as first_three from cand group by 1",
    "constrained_decode": f"""with recursive {scored()}, {_DECODABLE}
select record_id, cast(rank as int) as rank, text_raw, ec_score, logscore as sequence_logscore, round(c, 9) as combined_score from (
  select *, row_number() over (partition by record_id order by c desc, ec_score desc, rank, text_raw desc) as o from (select *, 0.5::double * ec_score + (1.0::double - 0.5::double) * logscore as c from rows)) where o = 1""",
    "lambda_curve": f"with recursive {scored()}, {_DECODABLE}, {_CURVE} {corpus('chosen', 'lmb')}",
    "lambda_select": f"""with recursive {scored()}, {_DECODABLE}, {_CURVE}
select lmb, error_rate from ({corpus('chosen', 'lmb')}) order by coalesce(error_rate, 'inf'::double), lmb limit 1""",
    "closest_projection": f"""with recursive {_CAND},
base as (select *, {norm('reference')} as ref, {norm('text_raw')} as hyp from cand),
usable as (select * from (select *, {_EC} as ec_score, max(case when logscore is null or isnan(logscore) or isinf(logscore) then 1 else 0 end) over (partition by record_id) as bad from base) where bad = 0),
near as (select u.*, g.generated as rf, u.hyp as hy from usable u join (select record_id, arg_max(hyp, rank) as generated from usable group by 1) g using (record_id)),
{edits('near')}
select record_id, cast(rank as int) as rank, text_raw, ec_score, e as word_distance from (
  select n.*, substitutions + deletions + insertions as e, row_number() over (partition by record_id order by substitutions + deletions + insertions, -ec_score, rank, text_raw) as o from near n join edits using (rf, hy)) where o = 1""",
    "unconstrained_outputs": f"select output_id as record_id, 'unconstrained' as decoding_strategy, output_raw, {norm('output_raw')} as output_normalized, cast(null as int) as selected_candidate_rank from ec_outputs where decoding_strategy = 'unconstrained'",
    "rank_by_length": f"""with {_CAND}, b as ({_BEAMS})
select record_id, cast(original_index as int) as original_index, round(s / tokens, 9) as ranking_score, cast(row_number() over (partition by record_id order by s / tokens desc, original_index) as int) as rank from b""",
    "rank_by_penalty": f"""with {_CAND}, b as (select *, s / pow((5.0::double + tokens) / 6.0::double, 0.6::double) as q from ({_BEAMS}))
select record_id, cast(original_index as int) as original_index, round(q, 9) as ranking_score, cast(row_number() over (partition by record_id order by q desc, original_index) as int) as rank from b""",
    "sequence_logprob": """with steps as (select vec_id // 20 as item, list_transform(embedding, lambda x: x::double) as z, case when vec_id % 7 = 0 then -100 else label end as label from embeddings),
lp as (select item, case when label <> -100 then z[label + 1] - list_max(z) - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) end as v from steps)
select item, count(v) as token_count, round(coalesce(sum(v), 0.0), 6) as logprob_sum, round(sum(v) / nullif(count(v), 0), 6) as logprob_mean from lp group by 1""",
    "training_pairs": f"""with {_CAND}
select record_id, any_value(utt_id) as utt_id, string_agg(text_raw, ' [SEP] ' order by rank) as source_text, any_value(reference) as target_raw, {norm('any_value(reference)')} as target_normalized,
  3 as input_nbest, 'literal-sep@v1' as serializer_id, sha256('{{"prefix":"","separator":"[SEP]","serializer_id":"literal-sep@v1"}}') as serializer_sha256
from cand where n >= 3 and rank <= 3 group by record_id""",
    "tagged_prompts": f"with {_CAND} select record_id, string_agg('<hyp' || rank || '> ' || text_raw || ' </hyp' || rank || '>', chr(10) order by rank) as source_text from cand group by 1",
    "error_filter": f"""with recursive {scored(where='rank = 1')}
select dataset, coalesce((case when reference_tokens > 0 then e / reference_tokens when e = 0 then 0.0 end) <= 0.25, false) as kept, count(*) as pairs, cast(sum(e) as bigint) as errors from scored group by all""",
    "length_ratio": f"""with {_CAND}, s as (select system_id, len({words(norm('reference'))}) as r, len({words(norm('text_raw'))}) as h from cand where rank = 1)
select *, hypothesis_words / nullif(reference_words, 0) as ratio from (select system_id, cast(sum(h) as bigint) as hypothesis_words, cast(sum(r) as bigint) as reference_words, count(*) filter (h = 0) as empty from s group by 1)""",
    "combined_lists": f"""with {_CAND},
x as (select utt_id, {norm('text_raw')} as hyp, system_id, record_id, rank from cand where utt_id is not null),
f as (select * from (select *, row_number() over (partition by utt_id, hyp order by rank, system_id, record_id) as o from x) where o = 1),
c as (select utt_id, hyp, count(distinct system_id) as systems from x group by all)
select utt_id, hyp, systems, cast(rank as int) as best_rank, cast(row_number() over (partition by utt_id order by rank, system_id, record_id, hyp) as int) as combined_rank from f join c using (utt_id, hyp)""",
    "undecodable_lists": f"""with {_CAND}, b as (select *, logscore is null or isnan(logscore) or isinf(logscore) as bad from cand)
select record_id, cast(rank as int) as rank, case when logscore is null then 'missing' when bad then 'not finite' end as problem from (select *, bool_or(bad) over (partition by record_id) as any_bad from b) where any_bad""",
    "unrankable_beams": f"""with {_CAND}
select record_id, cast(rank as int) as original_index, case when tokens < 1 then 'no tokens' else 'score not finite' end as problem from cand where tokens < 1 or logscore is null or isnan(logscore) or isinf(logscore)""",
    "win_loss": f"""with recursive {scored()}, {_FIRST_ORACLE}
select system_id, count(*) filter (eb < ea) as wins, count(*) filter (eb = ea) as ties, count(*) filter (eb > ea) as losses from both_sides group by 1""",
    "bootstrap_difference": f"""with recursive {_BOOT} select *, errors_a / tokens - errors_b / tokens as difference from sums""",
    "bootstrap_interval": f"""with recursive {_BOOT}, d as (select errors_a / tokens - errors_b / tokens as difference from sums)
select count(*) as replicates, avg(difference) as mean, quantile_disc(difference, 0.025) as lower, quantile_disc(difference, 0.975) as upper from d""",
    "utterance_violations": _count_rules("utterance_records", {
        "blank_id": _blank("utt_id", "dataset", "split", "audio_path"),
        "schema_version": "schema_version <> '1.0'",
        "reference": "reference.raw is null or reference.normalized is null",
        "no_hypotheses": "coalesce(len(asr.hypotheses), 0) = 0",
        "rank_order": "coalesce(len(asr.hypotheses), 0) > 0 and not coalesce(list_transform(asr.hypotheses, lambda h: h.rank) = list_transform(range(1, len(asr.hypotheses) + 1), lambda i: i::int), false)",
        "rank_value": _any("h.rank < 1 or h.source_original_rank < 1"),
        "token_lengths": _any("h is not null and coalesce(len(h.token_logprobs), 0) > 0 and len(h.token_logprobs) <> coalesce(len(h.token_ids), 0)"),
        "score_not_finite": _any(f"h is not null and (coalesce(list_bool_or(list_transform(h.token_logprobs, lambda x: x is null or {_not_finite('x')})), false) or {_not_finite('h.sequence_logscore')} or {_not_finite('h.length_penalty')})"),
        "score_type": _any(f"h.score_type not in {_in(SCORE_TYPES)}"),
        "source_system": "coalesce(list_bool_or(list_transform(asr.hypotheses, lambda h: coalesce(h.source_system_id <> asr.system_id, true))), false)",
    }),
    "candidate_violations": _count_rules("utterance_records", {
        "logprob_flag": """coalesce(list_bool_or(list_transform(asr.hypotheses, lambda h: coalesce(h is not null and case case when json_valid(h.metadata) then h.metadata ->> '$.token_logprobs_available' end
            when 'true' then coalesce(len(h.token_logprobs), 0) = 0 when 'false' then coalesce(len(h.token_logprobs), 0) > 0 else false end, false))), false)""",
    }),
    "short_lists": f"select record_id, cast(coalesce(len(asr.hypotheses), 0) as int) as candidates from utterance_records where coalesce(len(asr.hypotheses), 0) < {N}",
    "parsed_replies": r"""with p as (select exchange_id, coalesce(len(messages), 0) > 0 as asked, regexp_replace(regexp_replace(regexp_replace(coalesce(raw_response, ''), '^\s+|\s+$', '', 'g'), '^```[a-z]*\n?|\n?```$', '', 'g'), '^\s+|\s+$', '', 'g') as t from llm_exchanges),
a as (select *, starts_with(t, '{') as j, case when starts_with(t, '{') and json_valid(t) then regexp_replace(coalesce(t ->> '$.transcript', t ->> '$.corrected', t ->> '$.answer', t ->> '$.text', t ->> '$.rank'), '^\s+|\s+$', '', 'g') end as answer from p),
x as (select *, case when j then answer else t end as text from a),
n as (select *, regexp_extract(lower(text), '^(?:rank|candidate)? ?#?(\d{1,4})[.)]?$', 1) as number,
  case when not asked then 'not_applicable' when t = '' then 'empty' when j and answer is null then 'malformed' when text = '' then 'empty' else 'parsed' end as parser_status from x)
select exchange_id, parser_status, case when parser_status = 'parsed' and number <> '' and number::int > 0 then number::int end as selected_candidate_rank,
  case when parser_status = 'parsed' and number = '' then text end as text from n""",
    "request_hashes": """with c as (select exchange_id, provider, model_id, messages,
    '{' || array_to_string(list_transform(list_sort(json_keys(generation_parameters)), lambda k: '"' || k || '":' || (generation_parameters -> k)::varchar), ',') || '}' as settings from llm_exchanges),
s as (select *, array_to_string(list_transform(messages, lambda m: coalesce(length(m.role) || ':' || m.role, '-') || coalesce(length(m.content) || ':' || m.content, '-')), '|') as said from c)
select sha256(coalesce(length(provider) || ':' || provider, '-') || '/' || coalesce(length(model_id) || ':' || model_id, '-') || '/' || coalesce(length(said) || ':' || said, '-') || '/' || coalesce(length(settings) || ':' || settings, '-')) as request,
  count(*) as exchanges, min(exchange_id) as first_exchange from s group by 1""",
    "canonical_metadata": """select exchange_id, '{' || array_to_string(list_transform(list_sort(json_keys(generation_parameters)), lambda k: '"' || k || '":' || (generation_parameters -> k)::varchar), ',') || '}' as canonical from llm_exchanges""",
    "unanswered_requests": "select exchange_id, request_hash from llm_exchanges e where not exists (select 1 from llm_exchanges r where r.request_hash = e.request_hash and r.raw_response is not null)",
    "normalized_curve": f"""with recursive {scored()}, {_DECODABLE.replace('rows as', 'plain_rows as')},
rows as (select * exclude (logscore, ec_score), {_standard('logscore')} as logscore, {_standard('ec_score')} as ec_score from plain_rows), {_CURVE} {corpus('chosen', 'lmb')}""",
    "output_violations": _count_rules("ec_outputs", {
        "blank_id": _blank("utt_id", "ec_system_id", "decoding_strategy"),
        "text": "output_raw is null or output_normalized is null",
        "rank_value": "coalesce(selected_candidate_rank < 1, false)",
        "lambda_range": f"coalesce(lambda_value < 0 or lambda_value > 1, false) or {_not_finite('lambda_value')}",
        "score_not_finite": " or ".join(_not_finite(s) for s in ("ec_sequence_score", "asr_sequence_score", "combined_score")),
        "latency": f"{_NEG.format('latency_ms')} or {_not_finite('latency_ms')}",
        "parser_status": f"parser_status not in {_in(PARSER_STATUSES)}",
    }),
    "exchange_violations": _count_rules("llm_exchanges", {
        "request_hash": "not regexp_matches(request_hash, '^[0-9a-f]{64}$')",
        "no_messages": "coalesce(len(messages), 0) < 1",
        "message": "coalesce(list_bool_or(list_transform(messages, lambda m: coalesce(m.role is null or trim(m.role) = '' or m.content is null, true))), false)",
        "blank_id": _blank("provider", "model_id"),
        "negative_count": " or ".join(_NEG.format(c) for c in ("input_tokens", "output_tokens", "retry_count", "latency_ms")),
        "rank_value": "coalesce(selected_candidate_rank < 1, false)",
        "parser_status": f"parser_status not in {_in(PARSER_STATUSES)}",
    }),
    "manifest_violations": _count_rules("data_manifest", {
        "blank_id": _blank("utt_id", "dataset", "split", "audio_path"),
        "audio_sha256": "not regexp_matches(audio_sha256, '^[0-9a-f]{64}$')",
        "reference": f"reference_raw is null or {_blank('reference_normalized')}",
    }),
    "duplicate_ids": "select utt_id, count(*) as rows from data_manifest where utt_id is not null group by 1 having count(*) > 1",
    "duplicate_audio": "select audio_path, count(*) as rows from data_manifest where audio_path is not null group by 1 having count(*) > 1",
    "split_overlap": f"select utt_id, count(distinct {_SPLIT}) as splits, count(*) as rows from data_manifest where utt_id is not null and split is not null group by 1 having count(distinct {_SPLIT}) > 1",
    "manifest_counts": "select dataset, split, count(*) as rows, count(distinct utt_id) as utterances from data_manifest group by all",
    "rank_contiguity": "select record_id, coalesce(len(asr.hypotheses) > 0 and list_transform(asr.hypotheses, lambda h: h.rank) = list_transform(range(1, len(asr.hypotheses) + 1), lambda i: i::int), false) as in_order from utterance_records",
    "score_coverage": f"""with {_CAND},
c as (select distinct utt_id, cast(rank as int) as rank from cand where utt_id is not null),
s as (select distinct utt_id, selected_candidate_rank as rank from ec_outputs where utt_id is not null and selected_candidate_rank is not null)
select *, 'candidate_only' as side from (select * from c except select * from s) union all select *, 'score_only' from (select * from s except select * from c)""",
    "normalizer_consensus": """select count(distinct provenance.normalizer_id) as ids, count(*) filter (provenance.normalizer_id is null) as rows_without, min(provenance.normalizer_id) as first_id,
  count(distinct provenance.normalizer_id) = 1 and count(*) filter (provenance.normalizer_id is null) = 0 as consensus from utterance_records""",
    "requested_n": "select cast(len(arg_min(asr.hypotheses, record_id)) as int) as requested_n from utterance_records where asr.hypotheses is not null",
    "parse_lines": """select json_extract_string(payload, '$.source_system_id') as source_system_id, json_extract_string(payload, '$.score_type') as score_type, count(*) as lines,
  count(*) filter (not json_valid(payload)) as broken, count(distinct json_extract_string(payload, '$.utt_id')) as utterances, max(cast(json_extract(payload, '$.rank') as int)) as deepest_rank from hypothesis_lines group by all""",
    "missing_utterances": "select utt_id, count(*) as lines from hypothesis_lines l where not exists (select 1 from data_manifest m where m.utt_id = l.utt_id) group by 1",
    "exchange_messages": "select exchange_id, cast(pos - 1 as int) as pos, m.role as role, cast(length(m.content) as int) as characters from (select exchange_id, unnest(messages) as m, generate_subscripts(messages, 1) as pos from llm_exchanges)",
    "request_cache": "select request_hash, min(exchange_id) as first_exchange, count(*) as replies, count(distinct raw_response) as texts from llm_exchanges where request_hash is not null group by 1 having count(*) > 1",
    "serialize_literal": _serialized("[SEP]", "rank"),
    "serialize_special": _serialized("<asr_sep>", "rank"),
    "serialize_sentinel": _serialized("<extra_id_0>", "rank"),
    "order_reversed": _serialized("[SEP]", "rank desc"),
    "order_sorted": _serialized("[SEP]", "text_raw"),
    "order_shuffled": _serialized("[SEP]", "md5('7:' || record_id || ':' || rank)"),
}
