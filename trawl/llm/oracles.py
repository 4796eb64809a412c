"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from trawl.llm import quality, urlfilter

WORD = r"[^\x20\x09-\x0D]+"


def _rules() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)


URLS = rf"""
with rules(rh, rp, rv) as (values {_rules()}),
u as (select page_id, row_number() over () as r,
        case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select p.*, rh || rp as rule, rv,
        row_number() over (partition by r order by length(rh) + length(rp) desc, length(rh) desc, rv desc) as k
      from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from m where k = 1
"""

_SHARES = {
    "word_length": ("100 * word_chars", "n_words"),
    "symbols": ("10000 * n_symbols", "word_chars"),
    "dup_lines": ("10000 * n_dup_lines", "n_lines"),
    "repeats": ("10000 * n_repeat_words", "n_words"),
}


def _quality() -> str:
    shares = ", ".join(f"case when {b} > 0 then ({a}) // {b} else 0 end as {r}" for r, (a, b) in _SHARES.items())
    long = " union all ".join(f"select lang, source, '{r}' as rate, {r} as v from rated where not base_failed" for r in quality.RATES)

    def level(name: str, keys: str) -> str:
        comma = f"{keys}, " if keys else ""
        found = ", ".join(
            f"min(case when rate = '{r}' and 100 * upto >= {share} * total then {'high' if upper else 'low'} end) as {r}_{q}"
            for r in quality.RATES
            for q, (share, upper) in quality.QUANTILES.items()
        )
        return f"""
{name}_m as (select {comma}rate, bucket, sum(n) as n from sk group by {comma}rate, bucket),
{name}_r as (select *, sum(n) over (partition by {comma}rate order by bucket rows unbounded preceding) as upto,
    sum(n) over (partition by {comma}rate) as total, case when bucket < 64 then 0 else bucket // 32 - 1 end as sh from {name}_m),
{name} as (select {comma}max(total) as total, {found} from (select *, (bucket - sh * 32) << sh::int as low, ((bucket - sh * 32 + 1) << sh::int) - 1 as high from {name}_r) {f'group by {keys}' if keys else ''})"""

    def pick(c: str) -> str:
        return f"(case when own.total >= {quality.MIN_GROUP} then own.{c} when bylang.total >= {quality.MIN_GROUP} then bylang.{c} else whole.{c} end)"

    def within(r: str, low: bool) -> str:
        bottom, q1, q3, top = (pick(f"{r}_{q}") for q in quality.QUANTILES)
        out = f"{r} <= case when {q3} > {q1} then {q3} + {quality.FENCE} * ({q3} - {q1}) else {top} end"
        return out + (f" and {r} >= case when {q3} > {q1} then {q1} - {quality.FENCE} * ({q3} - {q1}) else {bottom} end" if low else "")

    every = " and ".join(within(r, low) for r, low in quality.RATES.items())
    return rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{WORD}') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from d),
win as (select r, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
winh as (select r, i, array_to_string(w[i:i+4], ' ') as g from win),
twice as (select r, i from (select *, count(*) over (partition by r, g) as c from winh) where c > 1),
marked as (select r, count(distinct i + o) as n_repeat_words from twice, (select unnest(range(0, 5)) as o) group by r),
f as (select w.r, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join marked on w.r = marked.r),
rated as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {shares} from f),
long as ({long}),
s as (select *, greatest(length(bin(v)) - 6, 0) as s from long),
sk as (select lang, source, rate, s * 32 + (v >> s::int) as bucket, count(*) as n from s group by all),
{level("own", "lang, source")}, {level("bylang", "lang")}, {level("whole", "")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce({every}, false) as kept
from rated left join own on rated.lang is not distinct from own.lang and rated.source is not distinct from own.source
left join bylang on rated.lang is not distinct from bylang.lang left join whole on true
"""


QUALITY = _quality()


#: Rounds and calibrations after which these data change no more.
ROUNDS, CALIBRATIONS = 24, 12


def _mixing() -> str:
    from trawl.llm import mixing

    ctes = []
    for m in mixing.MARGINS:
        ctes.append(f"t_{m} as (select {m}, pow(sum(tokens)::double, {mixing.TEMPER[m]}) as t from cells group by {m})")
        ctes.append(f"s_{m} as (select {m}, t / (select sum(t) from t_{m}) as share from t_{m})")
    shares = ", ".join(f"s_{m}.share as share_{m}" for m in mixing.MARGINS)
    joins = " ".join(f"join s_{m} on cells.{m} is not distinct from s_{m}.{m}" for m in mixing.MARGINS)
    ctes.append(f"r0 as materialized (select cells.*, tokens::double as fitted, sum(tokens) over ()::double as total, {shares} from cells {joins})")
    last = 0
    for _ in range(ROUNDS):
        for m in mixing.MARGINS:
            ctes.append(f"r{last + 1} as materialized (select * replace (fitted * total * share_{m} / sum(fitted) over (partition by {m}) as fitted) from r{last})")
            last += 1
    ctes.append(f"w as materialized (select source, lang, topic, tokens, fitted / tokens as weight from r{last})")
    ctes.append("c0 as (select 0.0::double as c)")
    for k in range(CALIBRATIONS):
        ctes.append(
            f"c{k + 1} as materialized (select coalesce((select ({mixing.BUDGET} * sum(tokens) - coalesce(sum(case when c * weight >= 1 then tokens end), 0))"
            f" / nullif(sum(case when c * weight < 1 then tokens * weight end), 0) from w, c{k}), (select c from c{k})) as c)"
        )
    return rf"""
with d as (select doc_id, text, source, lang,
    case when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '***') or contains(coalesce(text, ''), '$$$') then 'symbols'
         when contains(coalesce(text, ''), '!!') then 'emphatic' else 'prose' end as topic,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens from documents),
cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all having sum(n_tokens) > 0),
{", ".join(ctes)},
j as (select d.*, case when n_tokens > 0 then weight else 0 end as weight,
    case when n_tokens > 0 then least(1.0, weight * c) else 0 end as probability,
    ('0x' || substr(md5(coalesce(doc_id::varchar, md5(text), '') || ':{mixing.SEED}'), 1, 13))::bigint / 4503599627370496.0 as dice
    from d left join w on d.source is not distinct from w.source and d.lang is not distinct from w.lang and d.topic = w.topic, c{CALIBRATIONS})
select doc_id, source, lang, topic, n_tokens, round(weight, 6) as weight, round(probability, 6) as probability, dice < probability as kept from j
"""


MIXING = _mixing()


BACKOFF = rf"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
t as (select r, unnest(w) as w, unnest(range(len(w))) as i from d),
p as (select r, i, w, lag(w) over (partition by r order by i) as v from t),
c1 as (select w, count(*) as n from t group by w),
c2 as (select v, w, count(*) as n from p where v is not null group by v, w),
total as (select count(*)::double as n from t),
s as (select p.r, ln(case when p.v is null then b.n / total.n when c2.n >= 2 then c2.n / a.n::double else 0.4 * b.n / total.n end) as s
    from p join c1 b on p.w = b.w left join c1 a on p.v = a.w left join c2 on p.v = c2.v and p.w = c2.w, total)
select doc_id, len(w)::bigint as n_words, round(coalesce(sum(s), 0), 5) as score, round(sum(s) / len(w), 5) as mean_score
from d left join s on d.r = s.r group by d.r, doc_id, w
"""


#: Every window of an item's length that shares a shingle with it, compared exactly; items have 5 words or more.
DECONTAMINATION = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'), '{WORD}') as w from documents),
i as (select item_id, regexp_extract_all(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'), '{WORD}') as w from benchmark),
ds as (select r, doc_id, len(w) - 4 as nd, unnest(range(0, len(w) - 4)) as pos, w from d where len(w) > 4),
dg as (select r, doc_id, nd, pos, array_to_string(w[pos + 1:pos + 5], ' ') as g from ds),
ig as (select item_id, len(w) - 4 as n, array_to_string(w[q + 1:q + 5], ' ') as g from (select *, unnest(range(0, len(w) - 4)) as q from i)),
ic as (select item_id, n, g, count(*) as c from ig group by all),
win as (select distinct r, doc_id, nd, item_id, n, unnest(range(greatest(0, pos - n + 1), greatest(0, least(pos, nd - n)) + 1)) as s from dg join ic using (g)),
wc as (select win.r, win.doc_id, win.nd, win.item_id, win.n, s, dg.g, count(*) as c from win join dg on dg.r = win.r and dg.pos between s and s + win.n - 1 group by all),
m as (select wc.r, wc.doc_id, wc.item_id, s, any_value(wc.n) as n, least(any_value(wc.n), any_value(wc.nd)) as wn, sum(least(wc.c, ic.c)) as shared
    from wc join ic on ic.item_id = wc.item_id and ic.g = wc.g group by wc.r, wc.doc_id, wc.item_id, s)
select doc_id, item_id, round(max(shared / (n + wn - shared)), 9) as similarity from m where 5 * shared >= 4 * (n + wn - shared) group by doc_id, item_id
"""
