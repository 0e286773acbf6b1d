"""SQL twin of the weak rules: the statistics by unnesting, EM as a recursive query."""

from __future__ import annotations

from .weakrules import ROUNDS, RULES, START, TOLERANCE

N = range(1, len(RULES) + 1)
VOTES = ", ".join(
    f"case when {v} <= {good} then 1 when {v} > {bad} then 0 end as v{i}" for i, (v, good, bad) in zip(N, RULES.values(), strict=True)
)
KEYS = ", ".join(f"v{i}" for i in N)


def odds(m: str) -> str:
    """Posterior of a pattern under the parameters of ``m``."""
    parts = [f"case v{i} when 1 then ln({m}.g{i} / (1 - {m}.b{i})) when 0 then ln((1 - {m}.g{i}) / {m}.b{i}) else 0 end" for i in N]
    return f"1 / (1 + exp(-(ln({m}.prior / (1 - {m}.prior)) + {' + '.join(parts)})))"


def new(i: int) -> str:
    def share(w: str, right: int, top: float, lo: float) -> str:
        hit = f"coalesce(sum(n * {w}) filter (v{i} = {right}), 0) + {top}"
        every = f"coalesce(sum(n * {w}) filter (v{i} is not null), 0) + 10"
        return f"round(least(greatest(({hit}) / ({every}), {lo}), 1 - 1e-6), 9)"

    return f"{share('y', 1, 9.95, 0.5)} as g{i}, {share('(1 - y)', 0, 2, 1e-6)} as b{i}"


START_ROW = f"0 as it, 1.0::double as moved, {START[0]}::double as prior, " + ", ".join(
    f"{START[1]}::double as g{i}, {START[2]}::double as b{i}" for i in N
)
MOVED = "greatest(abs(x.prior - x.prior0), " + ", ".join(f"abs(x.g{i} - x.g{i}_0), abs(x.b{i} - x.b{i}_0)" for i in N) + ")"

RULES_SQL = rf"""
with recursive t as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), w as (
  select rid, unnest(ws) as w, unnest(generate_series(1, len(ws))) as i from (
    select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from t)
), tri as (
  select rid, i, lead(w) over o as w2, lead(w, 2) over o as w3, w from w window o as (partition by rid order by i)
), rep as (
  select rid, count(distinct place) as n_repeat_words from (
    select rid, unnest([i, i + 1, i + 2]) as place from (
      select rid, i, count(*) over (partition by rid, w, w2, w3) as c from tri where w3 is not null) where c > 1) group by 1
), ws as (
  select rid, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (not regexp_matches(w, '\p{{L}}')) as n_letterless from w group by 1
), ln as (
  select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (
    select rid, unnest(string_split(t, chr(10))) as l from t) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1
), s as (
  select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '\p{{L}}')) as n_letters,
    len(regexp_extract_all(t, '\p{{Lu}}')) as n_upper, len(regexp_extract_all(t, '!')) as n_bangs,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_letterless, 0) as n_letterless,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from t left join ws using (rid) left join ln using (rid) left join rep using (rid)
), v as materialized (
  select *, {VOTES} from s
), pat as materialized (
  select {KEYS}, count(*) as n from v group by all
), em as (
  select {START_ROW}
  union all
  select it + 1, {MOVED}, prior, {", ".join(f"g{i}, b{i}" for i in N)} from (
    select any_value(it) as it, round(least(greatest((sum(n * y) + 8) / (sum(n) + 10), 1e-6), 1 - 1e-6), 9) as prior, {", ".join(new(i) for i in N)},
      any_value(prior) as prior0, {", ".join(f"any_value(g{i}) as g{i}_0, any_value(b{i}) as b{i}_0" for i in N)}
    from (select em.*, pat.*, {odds("em")} as y from em, pat where it < {ROUNDS} and moved >= {TOLERANCE}) having count(*) > 0) x
), last as (
  select * from em order by it desc limit 1
), f as (
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {odds("last")} as quality
  from v, last
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and quality >= 0.5 as kept, round(quality, 4) as quality from f
"""
