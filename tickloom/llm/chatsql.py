"""SQL twin of the chat windows: the same placement, without the text round trip."""

from __future__ import annotations

from .chatwindows import BUDGET, HISTORY, PER_TURN

PROBE = r"\### Assistant: </turn> ok"
_ESC = r"replace(replace(replace({0}, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn')"

CHAT = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0::bigint, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')
), t as (
  select *, row_number() over w - 1 as pos, first_value(role) over w = 'system' as has_system,
    len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\x20\x09-\x0D]')) + {PER_TURN} as tokens,
    length({_ESC.format("role")}) as r, length({_ESC.format("text")}) as b
  from c window w as (partition by conv_id order by turn nulls first, role, text)
), p as (
  select *, 16 + length(r::varchar) + r + b as chars,
    has_system and pos = 0 as is_system,
    coalesce(sum(tokens) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as before,
    case when has_system then first_value(tokens) over (partition by conv_id order by pos) else 0 end as sys_tokens
  from t
), q as (
  select *, case when is_system then 0 else before - sys_tokens end as start,
    greatest(1, {BUDGET - HISTORY} - sys_tokens) as stride
  from p
), m as (
  select conv_id, chars, is_system, floor(start / stride)::bigint as own,
    unnest(generate_series(floor(start / stride)::bigint,
      case when is_system then 0 else floor((start + {HISTORY}) / stride)::bigint end)) as window_id
  from q
), v as (
  select conv_id, window_id, sum(case when is_system then 0 else chars end) as chars
  from m group by all having bool_or(own = window_id)
), f as (
  select v.conv_id, sum(v.chars + coalesce(s.chars, 0))::bigint as formatted_chars
  from v left join (select conv_id, chars from q where is_system) s on v.conv_id is not distinct from s.conv_id
  group by all
), g as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256
  from t group by conv_id
)
select g.*, f.formatted_chars from g join f on g.conv_id is not distinct from f.conv_id
"""
