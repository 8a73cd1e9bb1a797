"""The registered queries as plain SQL over the same tables, for a second engine to check."""

from __future__ import annotations

from tokentide.functions.scalars import MODEL_ALIASES
from tokentide.schemas import TOKEN_FIELDS
from tokentide.sources.ratecard import BUILT_IN_MODELS

TOKENS = ", ".join(TOKEN_FIELDS)
SUM_TOKENS = ", ".join(f"cast(sum({f}) as bigint) AS {f}" for f in TOKEN_FIELDS)
NOW = "TIMESTAMP '2024-01-20 00:00:00'"
START = "TIMESTAMP '2024-01-15 00:00:00'"
END = "TIMESTAMP '2024-01-25 00:00:00'"
D = "DECIMAL(38,12)"


def r6(x: str) -> str:
    return f"cast(round({x}, 6) as double)"


def usd(x: str) -> str:
    return f"cast(round(cast({x} as DECIMAL(28,12)) * cast(0.04 as DECIMAL(3,2)), 6) as double)"


# --- shared tables ------------------------------------------------------------

_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in MODEL_ALIASES.items())

CTES: dict[str, str] = {
    "ev": """select event_id, ts, user_id, event_type, value,
        cast(regexp_extract(props, '[0-9]+') as bigint) as k, epoch_us(ts) as us from events""",
    "usage": """select event_id, ts, us, user_id, k, event_type,
        concat('s', user_id, '-', cast(floor(us/86400000000.0) as bigint)) as session_id,
        case event_type when 'click' then 'gpt-5.5' when 'view' then 'GPT-5.4' when 'purchase' then 'gpt-5.4  mini'
          when 'signup' then 'gpt-5.2' else 'mystery-model' end as model,
        case k%3 when 0 then null when 1 then 'Low' else 'x High' end as reasoning_effort,
        concat('/w/', user_id%20) as cwd,
        cast(floor(value*100) as bigint) as input_tokens, k*50 as cached_input_tokens, k*10 as output_tokens,
        k as reasoning_output_tokens, cast(floor(value*100) as bigint)+k*10 as total_tokens,
        case when user_id%6=0 then null else concat('a', user_id%5) end as account_id,
        case when user_id%2=0 then 'pro' else 'plus' end as rl_plan,
        case when k%4=0 then null else event_type end as rl_limit,
        case when k%4=0 then null else (cast(floor(us/18000000000.0) as bigint)+1)*18000000000 end as rl_reset
        from ev""",
    "mode_sw": "select ts, event_id, (k%2=0) as fast from ev where event_type='error' and k<10",
    "acct_sw": "select ts, event_id, concat('a', user_id%5) as account_id from ev where event_type='signup' and k<20",
    "mode_last": "select ts, arg_max(fast, event_id) as fast from mode_sw group by ts",
    "acct_last": "select ts, arg_max(account_id, event_id) as account_id from acct_sw group by ts",
    "moded": "select u.*, m.fast from usage u asof left join mode_last m on u.ts >= m.ts",
    "aliases": f"select * from (values {_ALIASES}) t(alias_name, alias_key)",
    "card": f"""select card_key, label, cast(in_rate as DECIMAL(10,4)) as in_rate, cast(cached_rate as DECIMAL(10,4)) as cached_rate,
        cast(out_rate as DECIMAL(10,4)) as out_rate, cast(fast_mult as DECIMAL(6,3)) as fast_mult
        from (values {BUILT_IN_MODELS}) t(card_key, label, in_rate, cached_rate, out_rate, fast_mult, note)""",
    "named": """select m.*, lower(trim(regexp_replace(model, '\\s+', ' ', 'g'))) as norm,
        greatest(input_tokens, 0) - least(greatest(cached_input_tokens, 0), greatest(input_tokens, 0)) as billable,
        least(greatest(cached_input_tokens, 0), greatest(input_tokens, 0)) as cached from moded m""",
    "matched": """select n.*, c.label, c.fast_mult,
        cast((cast(billable as DECIMAL(18,0)) * in_rate + cast(cached as DECIMAL(18,0)) * cached_rate
          + cast(greatest(output_tokens, 0) as DECIMAL(18,0)) * out_rate) * cast(0.000001 as DECIMAL(6,6)) as DECIMAL(28,12)) as per_call
        from named n left join aliases a on n.norm = a.alias_name left join card c on coalesce(a.alias_key, n.norm) = c.card_key""",
    "priced": f"""select *, label is not null as priced, coalesce(cast(per_call as {D}), 0) as normal_credits,
        coalesce(cast(per_call * fast_mult as {D}), 0) as fast_credits,
        coalesce(cast(case when fast then per_call * fast_mult else per_call end as {D}), cast(0 as {D})) as credits,
        case when label is not null and fast then cast(fast_mult as double) else 1.0 end as credit_multiplier,
        concat('/logs/', session_id, '.jsonl') as file_path from matched""",
    "rolling": """select *, cast(case when event_id%2=0 then 300 else 10080 end as bigint) as wm,
        (event_type='view' and k%10<>0 and user_id%5=1) as rolling from ev""",
    "samples": """select event_id, ts, us, concat('s', user_id, '-', cast(floor(us/86400000000.0) as bigint)) as session_id,
        case when user_id%6=0 then null else concat('a', user_id%5) end as account_id,
        case when user_id%2=0 then 'pro' else 'plus' end as plan_type,
        case when k%10=0 then null else event_type end as limit_id, wm as window_minutes,
        case when wm=300 then '5h' else '7d' end as win,
        case when rolling then 0.0 else cast(floor(least(value,100.0)) as double) end as used_percent,
        case when rolling then (cast(floor(us/1000000.0) as bigint)+wm*60)*1000000
          else (cast(floor(us/(wm*60000000.0)) as bigint)+1)*wm*60000000 + (event_id%3)*20000000 end as resets_us
        from rolling""",
    "sdedup": """select account_id, plan_type, limit_id, window_minutes, ts, us, resets_us, count(*) as copies,
        arg_min(event_id, (session_id, event_id)) as event_id, min(session_id) as session_id,
        arg_min(win, (session_id, event_id)) as win, arg_min(used_percent, (session_id, event_id)) as used_percent
        from samples group by all""",
    "inactive": """select account_id, plan_type, limit_id, window_minutes, count(*) as samples from sdedup
        group by all having count(*) >= 3 and max(us) - min(us) >= 60000000
        and bool_and(abs(used_percent) <= 0.000001 and abs(us + window_minutes*60000000 - resets_us) < 61000000)""",
    "active": """select s.* from sdedup s where not exists (select 1 from inactive i where i.account_id is not distinct from s.account_id
        and i.plan_type is not distinct from s.plan_type and i.limit_id is not distinct from s.limit_id and i.window_minutes = s.window_minutes)""",
    "lagged": """select *, lag(resets_us) over w as p_reset, lag(used_percent) over w as p_used from active
        window w as (partition by account_id, plan_type, limit_id, window_minutes order by us, resets_us, session_id)""",
    "steps": """select *, case when p_reset is null then 'firstObserved'
          when resets_us > us and abs(p_reset - resets_us) >= 61000000 and used_percent < p_used
            then case when us < p_reset then 'early' else 'normal' end
          when p_reset <> resets_us then 'changed' else 'firstObserved' end as kind,
        case when p_reset is null or abs(p_reset - resets_us) >= 61000000 then 1 else 0 end as opens from lagged""",
    "islands": """select *, sum(opens) over (partition by account_id, plan_type, limit_id, window_minutes
        order by us, resets_us, session_id rows unbounded preceding) as island from steps""",
    "windows": """select *, reset_at - window_minutes*60000000 as estimated_start,
        concat(win, '-', coalesce(account_id, 'unknown-account'), '-', plan_type, '-', coalesce(limit_id, 'unknown-limit'),
          '-reset-', reset_at // 1000000) as id from (
        select account_id, plan_type, limit_id, window_minutes, island,
        arg_min(win, (us, resets_us, session_id)) as win, arg_max(resets_us, (us, resets_us, session_id)) as reset_at,
        min(us) as first_seen, max(us) as last_seen, min(used_percent) as min_used_percent, max(used_percent) as max_used_percent,
        arg_max(used_percent, (us, resets_us, session_id)) as last_used_percent, count(*) as sample_count,
        arg_min(kind, (us, resets_us, session_id)) as reset_kind from islands group by all)""",
    "pairs_wu": """select p.event_id, p.session_id, p.total_tokens, p.credits, p.rl_limit is not null as limited,
        w.account_id as w_account, w.plan_type as w_plan, w.limit_id as w_limit, w.window_minutes, w.island, w.id, w.reset_at, w.estimated_start,
        coalesce(p.rl_limit is not null and w.window_minutes = 300 and abs(p.rl_reset - w.reset_at) < 61000000
          and p.rl_plan = w.plan_type and p.rl_limit is not distinct from w.limit_id, false) as exact
        from priced p join windows w on p.us >= w.estimated_start and p.us < w.reset_at
          and (w.account_id is null or w.account_id = p.account_id)""",
    "attached": """select * from (select *, bool_or(exact) over (partition by event_id) as any_exact,
        count(*) over (partition by event_id, window_minutes, w_account, w_plan) as n from pairs_wu)
        where case when any_exact then exact else n = 1 end""",
}

ORDER = list(CTES)
NEEDS = {
    "ev": [], "usage": ["ev"], "mode_sw": ["ev"], "acct_sw": ["ev"], "mode_last": ["mode_sw"], "acct_last": ["acct_sw"],
    "moded": ["usage", "mode_last"], "aliases": [], "card": [], "named": ["moded"], "matched": ["named", "aliases", "card"],
    "priced": ["matched"], "rolling": ["ev"], "samples": ["rolling"], "sdedup": ["samples"], "inactive": ["sdedup"],
    "active": ["sdedup", "inactive"], "lagged": ["active"], "steps": ["lagged"], "islands": ["steps"], "windows": ["islands"],
    "pairs_wu": ["priced", "windows"], "attached": ["pairs_wu"],
}


def with_(body: str, *tables: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """`body` behind the shared tables it needs, and its own."""
    wanted: set[str] = set()

    def need(name: str) -> None:
        wanted.add(name)
        for other in NEEDS[name]:
            need(other)

    for table in tables:
        need(table)
    # Materialised: DuckDB then evaluates a table once however often it is used.
    parts = [f"{n} as materialized ({CTES[n]})" for n in ORDER if n in wanted]
    parts += [f"{n} as ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


# --- usage ------------------------------------------------------------------

MEASURES = f"""count(*) as calls, {SUM_TOKENS}, {r6('sum(credits)')} as credits,
    count(*) filter (priced) as priced_calls, count(*) filter (not priced) as unpriced_calls, {usd('sum(credits)')} as usd"""
MODEL_KEY = "concat(model, case when fast then '-fast' else '' end)"
EFFORT = "nullif(trim(regexp_replace(lower(reasoning_effort), '[^a-z0-9]+', '-', 'g'), '-'), '')"
KEYS = {
    "hour": "strftime(ts, '%Y-%m-%d %H:00')",
    "day": "strftime(ts, '%Y-%m-%d')",
    "week": "strftime(ts, '%G-W%V')",
    "month": "strftime(ts, '%Y-%m')",
    "model": MODEL_KEY,
    "model_effort": f"concat({MODEL_KEY}, coalesce('-' || {EFFORT}, ''))",
    "cwd": "cwd",
    "account": "coalesce(account_id, 'unknown')",
}

SQL: dict[str, str] = {}
for _name, _key in KEYS.items():
    SQL[f"usage_by_{_name}"] = with_(
        f"select {_key} as key, count(distinct session_id) as sessions, {MEASURES} from priced group by 1", "priced"
    )
SQL["usage_by_month_kept"] = SQL["usage_by_month"]
SQL["usage_totals"] = with_(
    f"""select 'Total' as key, (select count(distinct session_id) from priced) as sessions, cast(sum(calls) as bigint) as calls,
    {SUM_TOKENS}, {r6('sum(c)')} as credits, cast(sum(priced_calls) as bigint) as priced_calls, cast(sum(unpriced_calls) as bigint) as unpriced_calls,
    {usd('sum(c)')} as usd from (select {MODEL_KEY} as key, {MEASURES}, cast(round(sum(credits), 6) as DECIMAL(38,6)) as c from priced group by 1)""",
    "priced",
)
SQL["usage_topk_credits"] = with_(
    f"select cwd as key, count(distinct session_id) as sessions, {MEASURES} from priced group by 1 order by credits desc, key limit 5",
    "priced",
)
SQL["fast_attribution"] = with_(
    f"""select count(*) filter (fast) as fast_attributed_calls,
    {r6('coalesce(sum(credits) filter (fast), 0)')} as fast_attributed_credits from priced""",
    "priced",
)
_STUB = """concat('{', chr(10), '  "key": "', norm, '",', chr(10), '  "label": "', model, '",', chr(10),
 '  "input_credits_per_million": 0,', chr(10), '  "cached_input_credits_per_million": 0,', chr(10), '  "output_credits_per_million": 0', chr(10), '}')"""
SQL["unpriced_models"] = with_(
    f"""select norm as pricing_key, model, calls, total_tokens, {_STUB} as pricing_stub from (
    select norm, arg_min(model, (file_path, event_id)) as model, count(*) as calls, cast(sum(total_tokens) as bigint) as total_tokens
    from priced where not priced group by norm)""",
    "priced",
)
SQL["price_usage"] = with_(
    f"""select event_id, priced, coalesce(label, model) as pricing_label, billable as billable_input_tokens,
    cached as billed_cached_tokens, credit_multiplier, {r6('credits')} as credits, {usd('credits')} as usd from priced""",
    "priced",
)
SQL["price_own_card"] = with_(
    """select event_id, case norm when 'gpt-5.5' then 'Five' when 'gpt-5.4' then 'Four' else model end as pricing_label,
    cast(round(coalesce(credits, 0), 6) as double) as credits, cast(round(coalesce(credits, 0) / 30, 6) as double) as usd from (
      select event_id, model, norm, cast(cast((cast(billable as DECIMAL(16,0)) * i + cast(cached as DECIMAL(16,0)) * c
        + cast(greatest(output_tokens, 0) as DECIMAL(16,0)) * o) * cast(0.000001 as DECIMAL(6,6)) as DECIMAL(28,12))
        * case when fast then f else cast(1 as DECIMAL(9,6)) end as DECIMAL(38,12)) as credits
      from named left join (values ('gpt-5.5', cast(1.00125 as DECIMAL(12,6)), cast(0.00125 as DECIMAL(12,6)),
        cast(3.33333 as DECIMAL(12,6)), cast(1.3333 as DECIMAL(9,6))), ('gpt-5.4', 0.5, 0.12345, 2.0, 1.0)) own(key, i, c, o, f) on norm = key)""",
    "named",
)
SQL["asof_account"] = with_(
    """select event_id, case when account_id is null then 'a9' else account_id end as account_id from (
    select u.event_id, a.account_id from usage u asof left join acct_last a on u.ts >= a.ts)""",
    "usage", "acct_last",
)
SQL["asof_mode"] = with_("select event_id, fast from moded", "moded")
SQL["scalar_keys"] = with_(
    f"""select event_id, {EFFORT} as effort, concat('5h-', coalesce(account_id, 'unknown-account'), '-pro-plan-',
    coalesce(replace(lower(reasoning_effort), ' ', '-'), 'unknown-limit'), '-reset-', us // 1000000) as window_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') as shown from usage""",
    "usage",
)

# --- sessions ---------------------------------------------------------------

_SESSION = f"""select session_id, arg_max(model, (file_path, event_id)) as model, arg_max(cwd, (file_path, event_id)) as cwd,
    min(us) as first_seen, max(us) as last_seen, {MEASURES}, min(file_path) as file_path from priced group by 1"""
SQL["sessions_all"] = with_(_SESSION, "priced")
SQL["sessions_top"] = with_(_SESSION + " order by credits desc, total_tokens desc, session_id limit 10", "priced")
SQL["sessions_totals"] = with_(
    f"select 'Total' as key, count(distinct session_id) as sessions, {MEASURES} from priced", "priced"
)
_EVENTS = f"""select session_id, us as "timestamp", model, fast, reasoning_effort, cwd, {TOKENS}, {r6('credits')} as credits,
    {usd('credits')} as usd, priced, file_path, event_id as line_no from priced"""
SQL["session_events"] = with_(_EVENTS, "priced")
_CENT = "cast(round(credits, 6) as DECIMAL(38,6))"
for _name, _key in {"model": MODEL_KEY, "cwd": "cwd", "effort": "coalesce(reasoning_effort, 'unknown')"}.items():
    SQL[f"session_by_{_name}"] = with_(
        f"""select session_id, {_key} as key, cast(1 as bigint) as sessions, count(*) as calls, {SUM_TOKENS},
        {r6(f'sum({_CENT})')} as credits, {usd(f'sum({_CENT})')} as usd,
        count(*) filter (priced) as priced_calls, count(*) filter (not priced) as unpriced_calls from priced group by 1, 2""",
        "priced",
    )
_W = "(partition by session_id order by us, model, file_path, event_id)"
SQL["session_switches"] = with_(
    """select session_id, count(*) filter (m <> model) as model_switches, count(*) filter (c <> cwd) as cwd_switches,
    count(*) filter (e <> effort) as reasoning_effort_switches from (
    select *, lag(model) over w as m, lag(cwd) over w as c, lag(effort) over w as e from (
      select *, coalesce(reasoning_effort, 'unknown') as effort from priced)
    window w as (partition by session_id order by us, model, file_path, event_id)) group by 1""",
    "priced",
)


def compact(rows: int, changes: str = "") -> str:
    return with_(
        f"""select session_id, run, bucket, min(us) as start, max(us) as "end", count(*) as events,
        arg_min(model, (us, model, file_path, event_id)) as model,
        arg_min_null(reasoning_effort, (us, model, file_path, event_id)) as reasoning_effort, {SUM_TOKENS},
        {r6(f'sum({_CENT})')} as credits, count(*) filter (not priced) as unpriced_calls, {usd(f'sum({_CENT})')} as usd,
        case when strftime(min(ts), '%Y-%m-%d %H:%M:%S') = strftime(max(ts), '%Y-%m-%d %H:%M:%S') then strftime(min(ts), '%Y-%m-%d %H:%M:%S')
          else strftime(min(ts), '%Y-%m-%d %H:%M:%S') || ' -> ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') end as label
        from (select r.*, (pos * nb + n - 1) // n - 1 as bucket from placed r join alloc using (session_id, run))
        group by 1, 2, 3""",
        "priced",
        extra={
            "base": f"select * {changes} from priced",
            "marked": f"""select *, case when lag(us) over w is null or lag(model) over w <> model
                or lag(reasoning_effort) over w is distinct from reasoning_effort then 1 else 0 end as s from base window w as {_W}""",
            "runs": f"select *, sum(s) over {_W} as run from marked",
            "placed": "select *, row_number() over (partition by session_id, run order by us, model, file_path, event_id) as pos from runs",
            "lens": "select session_id, run, count(*) as n from runs group by 1, 2",
            "shares": "select *, sum(n) over (partition by session_id) as total, count(*) over (partition by session_id) as nruns from lens",
            "extra": f"""select session_id, run, nruns, row_number() over (partition by session_id
                order by cast(n as double) / cast(total as double) * {rows}.0 - b desc, run, b) as place
                from (select *, unnest(range(1, n)) as b from shares where total > {rows} and nruns < {rows})""",
            "won": f"select session_id, run, count(*) as w from extra where place <= {rows} - nruns group by 1, 2",
            "alloc": f"""select s.session_id, s.run, n, cast(case when total <= {rows} then n when nruns >= {rows} then 1
                else 1 + coalesce(w, 0) end as bigint) as nb from shares s left join won using (session_id, run)""",
        },
    )


BUSY = "concat(coalesce(account_id, 'none'), '-', right(session_id, 5))"
SQL["session_compact"] = compact(3)
SQL["session_compact_busy"] = compact(
    20, f"replace ({BUSY} as session_id, concat('m', us // 21600000000 % 4) as model, cast(null as varchar) as reasoning_effort)"
)

# --- ordered scans ----------------------------------------------------------

_COUNTER = """select *, case when k%11=0 then null else cast(sum(total_tokens) over (partition by session_id order by event_id) as bigint)
    - case when k=50 then 5000 else 0 end end as counter from usage"""
SQL["counter_diff"] = with_(
    """select event_id, case when counter is null then total_tokens when prev is null then counter
    else greatest(counter - prev, 0) end as delta from (select *, last_value(counter ignore nulls) over (
    partition by session_id order by event_id rows between unbounded preceding and 1 preceding) as prev from counted)""",
    "usage", extra={"counted": _COUNTER},
)
SQL["carry_forward"] = with_(
    """select event_id, coalesce(last_value(case when k%4=0 then model end ignore nulls) over w, 'unknown') as model,
    coalesce(last_value(case when k%5=0 then cwd end ignore nulls) over w, 'unknown') as cwd from usage
    window w as (partition by session_id order by event_id rows between unbounded preceding and current row)""",
    "usage",
)

# --- samples and quota windows ----------------------------------------------

SQL["samples_dedup"] = with_(
    """select account_id, plan_type, limit_id, window_minutes, us as "timestamp", resets_us as resets_at, count(*) as copies,
    arg_min(event_id, (session_id, event_id)) as event_id, min(session_id) as session_id,
    arg_min(win, (session_id, event_id)) as "window", arg_min(used_percent, (session_id, event_id)) as used_percent
    from (select * from samples union all select * replace (concat('r', session_id) as session_id) from samples where event_id%7=0)
    group by all""",
    "samples",
)
SQL["inactive_streams"] = with_("select * from inactive", "inactive")
SQL["sample_counters"] = with_(
    """select cast(sum(copies) as bigint) as samples, cast(sum(copies - 1) as bigint) as duplicate_samples,
    count(*) - (select count(*) from active) as ignored_inactive_stream_samples,
    cast(coalesce(sum(copies) filter (limit_id is null), 0) as bigint) as unknown_limit_samples,
    case when count(*) = 0 then 'unobserved' else 'ok' end as status from sdedup""",
    "active",
)
SQL["samples_active"] = with_(
    'select event_id, us as "timestamp", window_minutes, used_percent, resets_us as resets_at from active', "active"
)
SQL["samples_filtered"] = with_(
    f"""select event_id, us as "timestamp", 100.0 - used_percent as remaining_percent from samples
    where ts between {START} and {END} and account_id = 'a1' and plan_type = 'pro' and window_minutes = 300""",
    "samples",
)
_WINDOW = """account_id, plan_type, limit_id, win as "window", window_minutes, reset_at, first_seen, last_seen, min_used_percent,
    max_used_percent, last_used_percent, sample_count, reset_kind, estimated_start, id"""
SQL["quota_windows"] = with_(f"select {_WINDOW} from windows", "windows")
SQL["quota_windows_merged"] = SQL["quota_windows"]
_RESETS = """select us as at, account_id, plan_type, limit_id, win as "window", window_minutes, p_used as previous_used_percent,
    used_percent as next_used_percent, p_reset as previous_resets_at, resets_us as next_resets_at,
    greatest((p_reset - us) // 1000000, 0) as early_by_seconds, kind from steps
    where p_reset is not null and resets_us > us and abs(p_reset - resets_us) >= 61000000 and used_percent < p_used"""
SQL["quota_resets"] = with_(_RESETS, "steps")
SQL["quota_resets_early"] = with_(_RESETS + " and kind = 'early'", "steps")
SQL["quota_unknown_limit_resets"] = with_(
    f"select count(*) filter (limit_id is null) as unknown_limit_reset_events from ({_RESETS})", "steps"
)
_CURRENT = f"""select concat(id, '-current') as id, case when reset_at > {{now}} then 'active' else 'expired' end as status,
    account_id, plan_type, limit_id, win as "window", window_minutes, last_seen, last_used_percent as used_percent,
    100.0 - last_used_percent as remaining_percent, reset_at as resets_at,
    case when reset_at > {{now}} then (reset_at - {{now}}) // 1000000 end as reset_in_seconds
    from (select *, row_number() over (partition by window_minutes, account_id, plan_type, limit_id, win
      order by reset_at desc, last_seen desc, first_seen desc) as rn from windows where first_seen <= {{now}}) where rn = 1""".format(
    now=f"epoch_us({NOW})"
)
SQL["quota_current"] = with_(_CURRENT, "windows")
SQL["quota_current_status"] = with_(
    f"""select case when count(*) = 0 then 'unobserved' when count(*) filter (status = 'active') > 0 then 'ok' else 'expired' end as status
    from ({_CURRENT})""",
    "windows",
)
_CHANGES = """select us as at, account_id, plan_type, limit_id, win as "window", window_minutes, used_percent,
    100.0 - used_percent as remaining_percent, delta as delta_used_percent, resets_us as resets_at, kind from fold where kind <> ''"""


def folded(active: str) -> dict[str, str]:
    """The trend's rule over a table of samples, one after the other."""
    return {
        "vectors": f"""select *, lag((window_minutes, used_percent, resets_us)) over (
            partition by account_id, plan_type, limit_id, session_id order by us, event_id) as p from {active}""",
        "kept": """select *, row_number() over (partition by account_id, plan_type, limit_id, window_minutes order by us, event_id) as n
            from vectors where (p is null or p <> (window_minutes, used_percent, resets_us)) and resets_us > us""",
        "fold": """select *, used_percent as su, resets_us as sr, cast(null as double) as delta, 'firstObserved' as kind from kept where n = 1
            union all
            select k.*, case when acc <> '' then k.used_percent else f.su end, case when acc <> '' then k.resets_us else f.sr end,
            case when acc <> '' then k.used_percent - f.su end, acc
            from fold f join kept k on k.n = f.n + 1 and k.window_minutes = f.window_minutes and k.plan_type = f.plan_type
              and k.account_id is not distinct from f.account_id and k.limit_id is not distinct from f.limit_id,
            lateral (select case when abs(k.resets_us - f.sr) >= 61000000 then 'resetChanged'
              when k.used_percent - f.su > 0.000001 then 'increased' else '' end as acc) x""",
    }


SQL["quota_trend"] = with_(_CHANGES, "active", recursive=True, extra=folded("active"))
SQL["quota_trend_creeping"] = with_(
    _CHANGES,
    "ev",
    recursive=True,
    extra={
        "creeping": """select event_id, ts, us, concat('s', user_id, '-', cast(floor(us/86400000000.0) as bigint)) as session_id,
            case when user_id%6=0 then null else concat('a', user_id%5) end as account_id, case when user_id%2=0 then 'pro' else 'plus' end as plan_type,
            'main' as limit_id, cast(300 as bigint) as window_minutes, '5h' as win, cast(k // 34 as double) as used_percent,
            1900000000000000 + (event_id * 2 + event_id % 3 * 20) * 1000000 as resets_us from ev""",
        **folded("creeping"),
    },
)

# --- interval joins ---------------------------------------------------------

SQL["windows_usage_attach"] = with_(
    f"""select w.id, w.first_seen, w.sample_count, cast(coalesce(total_tokens, 0) as bigint) as total_tokens,
    {r6('coalesce(c, 0)')} as credits, {usd('coalesce(c, 0)')} as usd from windows w left join (
      select w_account, w_plan, w_limit, window_minutes, island, sum(total_tokens) as total_tokens, sum(credits) as c from attached group by all) a
    on a.w_account is not distinct from w.account_id and a.w_plan = w.plan_type and a.w_limit is not distinct from w.limit_id
      and a.window_minutes = w.window_minutes and a.island = w.island""",
    "windows", "attached",
)
SQL["windows_usage_range"] = with_('select min(estimated_start) as start, max(reset_at) as "end" from windows', "windows")
SQL["windows_overlapping"] = with_(
    f"""select id, first_seen, estimated_start, reset_at from windows
    where reset_at > epoch_us({START}) and estimated_start <= epoch_us({END})""",
    "windows",
)


def assigned(minutes: int) -> dict[str, str]:
    return {
        "cand": f"select * from pairs_wu where window_minutes = {minutes}",
        "best": """select event_id, case when bool_or(limited) then arg_max(id, (estimated_start, reset_at, id)) filter (exact)
            when count(*) = 1 then min(id) end as window_id from cand group by 1""",
        "joined": "select p.*, b.window_id from priced p left join best b using (event_id)",
        "known": f"""select id as window_id, arg_min(account_id, (reset_at, estimated_start)) as w_account, arg_min(plan_type, (reset_at, estimated_start)) as w_plan,
            arg_min(limit_id, (reset_at, estimated_start)) as w_limit, min(win) as win, min(estimated_start) as estimated_start, min(reset_at) as reset_at
            from windows where window_minutes = {minutes} group by 1""",
    }


def window_usage(selector: str, group: str) -> str:
    minutes = {"5h": 300, "7d": 10080}[selector]
    key = {"window": "coalesce(window_id, 'unobserved')", "model": MODEL_KEY, "cwd": "cwd", "account": "coalesce(account_id, 'unknown')"}[group]
    extra = assigned(minutes)
    extra["sums"] = f"""select coalesce(window_id, 'unobserved:{selector}') as window_id, {key} as group_key,
        count(distinct session_id) as sessions, count(*) as calls, {SUM_TOKENS}, sum(credits) as c,
        count(*) filter (priced) as priced_calls, count(*) filter (not priced) as unpriced_calls from joined group by 1, 2"""
    source = "sums"
    if group == "window":
        extra["keys"] = "select window_id, window_id as group_key from known union select window_id, group_key from sums"
        source = "keys left join sums using (window_id, group_key)"
    count = lambda c: f"coalesce({c}, 0) as {c}"
    return with_(
        f"""select window_id, w_account as account_id, w_plan as plan_type, w_limit as limit_id, coalesce(win, '{selector}') as "window",
        cast({minutes} as bigint) as window_minutes, estimated_start as window_start, reset_at, reset_at is not null as observed,
        '{group}' as group_by, group_key, {count('sessions')}, {count('calls')}, {', '.join(count(f) for f in TOKEN_FIELDS)},
        {r6('coalesce(c, 0)')} as credits, {usd('coalesce(c, 0)')} as usd, {count('priced_calls')}, {count('unpriced_calls')}
        from {source} left join known using (window_id)""",
        "priced", "windows", "pairs_wu", extra=extra,
    )


SQL["limit_usage_window"] = window_usage("5h", "window")
SQL["limit_usage_model"] = window_usage("5h", "model")
SQL["limit_usage_cwd"] = window_usage("5h", "cwd")
SQL["limit_usage_account"] = window_usage("7d", "account")
SQL["limit_usage_unobserved"] = with_(
    """select (select count(*) from windows) as observed_windows,
    (select count(*) from priced p left join best b using (event_id) where b.window_id is null) as unobserved_usage_events""",
    "priced", "windows", "pairs_wu",
    extra={
        "best": """select event_id, case when bool_or(limited) then arg_max(id, (estimated_start, reset_at, id)) filter (exact)
            when count(*) = 1 then min(id) end as window_id from pairs_wu group by 1"""
    },
)

# --- detector ---------------------------------------------------------------

_DETECT = {
    "five": f"""select account_id, plan_type, 'main' as limit_id, us, ts, event_id,
        {BUSY} as session_id, cast(floor((us % 18000000000) / 180000000.0) as double) as used,
        (us // 18000000000 + 1) * 18000000000 as resets_at from samples""",
    "obs": """select account_id, plan_type, limit_id, resets_at, us, max(used) as used, sum(n) as n from (
        select account_id, plan_type, limit_id, resets_at, us, session_id, arg_min(used, event_id) as used, count(*) as n from five group by all)
        group by all""",
    "pairs": """select account_id, plan_type, limit_id, resets_at, p_us as interval_start, us as interval_end, greatest(used - p_used, 0.0) as delta_used_percent,
        (resets_at > us and resets_at > p_us) as active, (resets_at > us and resets_at > p_us) and used - p_used > 0.000001 as rising,
        (resets_at > us and resets_at > p_us) and used - p_used >= -0.000001 as usable from (
        select *, lag(us) over w as p_us, lag(used) over w as p_used from obs
        window w as (partition by account_id, plan_type, limit_id, resets_at order by us)) where p_us is not null""",
    "records": f"""select event_id, us, {BUSY} as session_id, account_id, model, total_tokens, normal_credits, fast_credits, file_path,
        rl_limit is not null as limited, rl_plan, rl_reset from priced""",
    "cand": """select r.*, q.account_id as q_account, q.plan_type as q_plan, q.limit_id as q_limit, q.resets_at, q.interval_start, q.interval_end,
        q.delta_used_percent, (limited and abs(rl_reset - q.resets_at) < 61000000 and rl_plan = q.plan_type) as exact
        from records r join pairs q on q.usable and r.us > q.interval_start and r.us <= q.interval_end
          and (q.account_id is null or q.account_id = r.account_id)""",
    "numbered": """select *, count(*) over (partition by event_id, q_account, q_plan) as n from cand""",
    "judged": """select *, min(n) over (partition by event_id) as min_n from numbered""",
    "used": "select * from judged where case when limited then exact else n = 1 end",
    "persession": """select q_account, q_plan, q_limit, resets_at, interval_start, interval_end, session_id, any_value(delta_used_percent) as d,
        sum(normal_credits) as w, count(*) as calls from used group by all""",
    "split": """select q_account as account_id, q_plan as plan_type, q_limit as limit_id, session_id, resets_at, interval_start, interval_end,
        cast(d * case when all_w <= 0.000001 then cast(calls as double) / cast(all_calls as double) else cast(w as double) / cast(all_w as double) end as DECIMAL(28,12)) as delta, calls
        from (select *, sum(w) over p as all_w, sum(calls) over p as all_calls from persession
        window p as (partition by q_account, q_plan, q_limit, resets_at, interval_start))""",
    "spans": """select account_id, plan_type, limit_id, session_id, resets_at, min(interval_start) as segment_start, max(interval_end) as segment_end,
        sum(delta) as delta, count(*) as sample_pairs from split group by all""",
    "bymodel": """select q_account as account_id, q_plan as plan_type, q_limit as limit_id, session_id, resets_at, model, count(*) as calls,
        sum(total_tokens) as total_tokens, sum(normal_credits) as nc,
        sum(case when normal_credits > 0.000001 then fast_credits else normal_credits end) as ex, min(file_path) as f1, max(file_path) as f2 from used group by all""",
    "summary": """select account_id, plan_type, limit_id, session_id, resets_at, cast(sum(calls) as bigint) as calls, cast(sum(total_tokens) as bigint) as total_tokens,
        sum(nc) as nc, sum(ex) as ex, arg_min(model, (-nc, -calls, model)) as model, count(*) > 1 as mixed,
        case when min(f1) = max(f2) then min(f1) else 'mixed' end as file_path from bymodel group by all""",
    "segs": """select s.*, m.calls, m.total_tokens, m.nc, m.ex, m.model, m.mixed, m.file_path, cast(delta as double) as dd, cast(nc as double) as nd,
        case when cast(nc as double) <= 0.000001 then 1.0 else cast(ex as double) / cast(nc as double) end as expected
        from spans s join summary m on s.account_id is not distinct from m.account_id and s.plan_type = m.plan_type
          and s.limit_id = m.limit_id and s.session_id = m.session_id and s.resets_at = m.resets_at""",
    "rejected": """select *, case when dd <= 0.000001 then 'noRisingUsageInSegment' when dd <= 1.000001 then 'minimumPercentStep'
        when calls < 3 then 'tooFewUsageCallsInSegment' when nd <= 0.000001 then 'noPricedUsageInSegment'
        when expected <= 1.000001 then 'noFastMultiplierModel' end as reject from segs""",
    "based": """select *, case when reject is null then dd / nd end as ppc, count(*) filter (reject is null) over p as scored,
        greatest(min(case when reject is null then dd / nd end) over p, 0.000001) as baseline from rejected
        window p as (partition by account_id, plan_type, limit_id)""",
    "scored": """select *, case when reject is null and scored >= 2 then ppc / baseline end as eff from based""",
    "final": """select *, case when reject is not null then reject when scored < 2 then 'insufficientBaseline'
        when eff < 1.5 or eff < expected * 0.65 then 'normalMultiplier'
        when mixed then 'mixedModelsWeightedExpectedMultiplier' else 'matchesExpectedFastMultiplier' end as reason,
        case when abs(eff - expected) <= 0.25 then 'high' when abs(eff - expected) <= 0.5 then 'medium' else 'low' end as confidence from scored""",
}


def detect(body: str, last: str, *more: str) -> str:
    names = list(_DETECT)
    keep = names[: names.index(last) + 1]
    extra = {n: _DETECT[n] for n in keep}
    return with_(body, "samples", "priced", extra=extra)


def metric(x: str) -> str:
    return f"floor(({x} + 2.220446049250313e-16) * 1e6 + 0.5) / 1e6"


SQL["detector_pairs"] = detect("select * from pairs", "pairs")
SQL["detector_intervals"] = detect(f"select * exclude (delta), {r6('delta')} as delta_used_percent from split", "split")
SQL["detector_segments"] = detect(
    f"""select account_id, plan_type, limit_id, session_id, resets_at, segment_start, segment_end, {r6('delta')} as delta_used_percent, sample_pairs,
    calls, total_tokens, {r6('nc')} as normal_credits, model, mixed, file_path from segs""",
    "segs",
)
SQL["detector_candidates"] = detect(
    f"""select segment_end as "timestamp", segment_start, segment_end, segment_end + 1000 as suggested_off_at, session_id, model, file_path,
    account_id, plan_type, limit_id, resets_at, sample_pairs, calls, total_tokens, {metric('dd')} as delta_used_percent, {r6('nc')} as normal_credits,
    {metric('ppc')} as percent_per_credit, {metric('baseline')} as baseline_percent_per_credit, {metric('eff')} as effective_multiplier,
    {metric('expected')} as expected_fast_multiplier, confidence, reason from final
    where reason in ('mixedModelsWeightedExpectedMultiplier', 'matchesExpectedFastMultiplier')""",
    "final",
)
_IDLE = """select 'noUsageInSegment' as reason from pairs q where q.usable and q.rising and not exists (
    select 1 from used u where u.q_account is not distinct from q.account_id and u.q_plan = q.plan_type and u.resets_at = q.resets_at
    and u.interval_start = q.interval_start)"""
SQL["detector_reasons"] = detect(
    f"""select reason, count(*) as "count" from (select reason from final union all {_IDLE}
    union all select 'noFiveHourSamples' from (select count(*) as n from obs) where n = 0) group by 1""",
    "final",
)
SQL["detector_counters"] = detect(
    """select (select cast(sum(n) as bigint) from obs) as five_hour_samples, (select count(*) from pairs) as sample_pairs,
    (select count(*) from pairs where active) as active_sample_pairs, (select count(*) from pairs where rising) as rising_sample_pairs,
    (select count(*) from used where limited) as exact_usage_matches, (select count(*) from used where not limited) as legacy_usage_matches,
    (select count(distinct event_id) from judged where not limited and min_n > 1) as ambiguous_legacy_usage_records,
    count(*) as segments_with_usage,
    count(*) filter (reason in ('mixedModelsWeightedExpectedMultiplier', 'matchesExpectedFastMultiplier')) as candidate_segments,
    count(*) filter (reason = 'normalMultiplier') as normal_segments,
    count(*) filter (reason in ('noRisingUsageInSegment', 'minimumPercentStep', 'tooFewUsageCallsInSegment', 'insufficientBaseline')) as insufficient_segments,
    count(*) filter (reject is null and mixed) as mixed_model_segments, (select count(*) from obs) = 0 as no_five_hour_samples from final""",
    "final",
)

# --- logs -------------------------------------------------------------------

_LOGS = {
    "counted": _COUNTER,
    # A context line stands before the token count of every fourth record; broken lines carry nothing.
    "logged": """select c.*, s.event_id is not null as has_sample, s.plan_type, s.limit_id, s.window_minutes, s.used_percent, s.resets_us,
        k%29 = 0 as broken, case when k%17 <> 0 then c.us end as at_us, k%23 <> 0 as has_info,
        last_value(case when k%4=0 then model end ignore nulls) over w as c_model,
        last_value(case when k%4=0 then cwd end ignore nulls) over w as c_cwd,
        last_value(case when k%4=0 then reasoning_effort end ignore nulls) over w as c_effort,
        last_value(case when k%23 <> 0 and k%29 <> 0 then counter end ignore nulls) over v as prev
        from counted c join samples s using (event_id)
        window w as (partition by c.session_id order by event_id rows between unbounded preceding and current row),
          v as (partition by c.session_id order by event_id rows between unbounded preceding and 1 preceding)""",
    "diffed": """select *, case when not has_info then 'none' when counter is null then case when k%5 <> 0 then 'last' else 'none' end
        when prev is null then 'total' else 'grown' end as how from logged where not broken""",
    "counts": """select *,
        case how when 'last' then input_tokens when 'total' then counter * 2 when 'grown' then greatest(counter * 2 - prev * 2, 0) end as n_input,
        case how when 'last' then cached_input_tokens when 'total' then 0 when 'grown' then 0 end as n_cached,
        case how when 'last' then output_tokens when 'total' then 0 when 'grown' then 0 end as n_output,
        case how when 'last' then reasoning_output_tokens when 'total' then 0 when 'grown' then 0 end as n_reasoning,
        case how when 'last' then total_tokens when 'total' then counter when 'grown' then greatest(counter - prev, 0) end as n_total from diffed""",
    "tagged": f"""select c.* exclude (account_id), coalesce(a.account_id, case when c.at_us is not null then 'a0' end) as account_id, m.fast from counts c
        asof left join acct_last a on make_timestamp(c.at_us) >= a.ts asof left join mode_last m on make_timestamp(c.at_us) >= m.ts""",
    "judged": f"""select *, case when not has_info or at_us is null then 'missing_metadata' when how = 'none' then 'missing_usage'
        when n_input = 0 and n_cached = 0 and n_output = 0 and n_reasoning = 0 and n_total = 0 then 'empty_usage'
        when at_us < epoch_us({START}) or at_us > epoch_us({END}) then 'out_of_range'
        when account_id is distinct from 'a1' then 'account_mismatch' end as skip from tagged""",
}


def logs_(body: str, last: str) -> str:
    names = list(_LOGS)
    return with_(body, "usage", "samples", "acct_last", "mode_last", extra={n: _LOGS[n] for n in names[: names.index(last) + 1]})


SQL["parse_usage_lines"] = logs_(
    """select event_id, at_us as "timestamp", session_id_of as session_id, coalesce(c_model, 'unknown') as model, coalesce(c_cwd, 'unknown') as cwd,
    c_effort as reasoning_effort, has_info, n_input as input_tokens, n_cached as cached_input_tokens, n_output as output_tokens,
    n_reasoning as reasoning_output_tokens, n_total as total_tokens
    from (select *, concat('/logs/', session_id, '.jsonl') as session_id_of from counts)""",
    "counts",
)
_QUOTA = """select event_id, at_us as "timestamp", concat('/logs/', session_id, '.jsonl') as session_id,
    coalesce(a.account_id, 'a0') as account_id, plan_type, limit_id,
    case when window_minutes=300 then '5h' else '7d' end as "window", window_minutes, used_percent, 100.0 - used_percent as remaining_percent,
    resets_us // 1000000 * 1000000 as resets_at from (select * exclude (account_id) from logged where not broken and at_us is not null and k%19 <> 0) l
    asof left join acct_last a on make_timestamp(l.at_us) >= a.ts"""
SQL["parse_quota_lines"] = logs_(_QUOTA, "logged")
SQL["usage_records"] = logs_(
    """select event_id, at_us as "timestamp", coalesce(c_model, 'unknown') as model, fast, account_id,
    cast(case when k%19 = 0 then 0 else 1 end as integer) as limits, n_input as input_tokens, n_total as total_tokens from judged where skip is null""",
    "judged",
)
SQL["skip_reasons"] = logs_("select coalesce(skip, 'included') as reason, count(*) as events from judged group by 1", "judged")
_FORKED = {
    **_LOGS,
    "counted": f"""select x.*, event_id > 0 and event_id < least + 500 and user_id%3 = 0 as u_replay,
        event_id > 0 and event_id <= least + 500 and user_id%3 = 0 as c_replay
        from ({_COUNTER}) x join (select session_id, min(event_id) as least from usage group by 1) using (session_id)""",
    "logged": _LOGS["logged"].replace("k%4=0 then", "k%4=0 and not c_replay then"),
    "judged": _LOGS["judged"].replace("case when not has_info", "case when u_replay then 'fork_replay' when not has_info", 1),
}
SQL["replay_skips"] = with_(
    """select coalesce(skip, 'included') as reason, coalesce(c_model, 'unknown') as model, user_id%3 = 0 as pinned, count(*) as events
    from judged group by 1, 2, 3""",
    "usage", "samples", "acct_last", "mode_last", extra=_FORKED,
)
_SKIPS = ", ".join(
    f"count(*) filter (skip = '{s}') as {s}"
    for s in ("missing_metadata", "missing_usage", "empty_usage", "out_of_range", "account_mismatch", "fork_replay")
)
SQL["usage_diagnostics"] = logs_(
    f"""select (select count(*) from logged where broken) as invalid_json_lines, count(*) as token_count_events,
    count(*) filter (skip is null) as included_usage_events, {_SKIPS} from judged""",
    "judged",
)
SQL["sample_diagnostics"] = logs_(
    f"""select (select count(*) from logged where broken) as invalid_json_lines, (select count(*) from logged where not broken) as rate_limit_events,
    cast(0 as bigint) as null_rate_limits, cast(0 as bigint) as missing_rate_limits,
    (select count(*) from logged where not broken and at_us is null) as missing_timestamps,
    (select count(*) from logged where not broken and at_us is not null and k%19 = 0) as missing_windows,
    cast(0 as bigint) as unknown_windows, cast(0 as bigint) as invalid_window_minutes,
    (select count(*) from logged where not broken and at_us is not null and k%19 = 0) as invalid_used_percent,
    cast(0 as bigint) as invalid_resets_at, cast(0 as bigint) as out_of_range_percent, cast(0 as bigint) as fork_replay_lines_skipped,
    cast(0 as bigint) as rate_limit_only_files,
    count(*) filter (r is null) as included_samples, count(*) filter (r = 'range') as out_of_range_samples,
    count(*) filter (r = 'account') as account_mismatches, count(*) filter (r = 'plan') as plan_mismatches,
    count(*) filter (r = 'window') as window_mismatches from (
      select case when "timestamp" < epoch_us({START}) or "timestamp" > epoch_us({END}) then 'range' when account_id <> 'a1' then 'account'
        when plan_type <> 'pro' then 'plan' when window_minutes <> 300 then 'window' end as r from ({_QUOTA}))""",
    "logged",
)
SQL["warnings"] = with_(
    """select * from (
    select 'missing_metadata' as code, count(*) filter (skip = 'missing_metadata') as "count" from judged
    union all select 'missing_usage', count(*) filter (skip = 'missing_usage') from judged
    union all select 'out_of_range', count(*) filter (skip = 'out_of_range') from judged
    union all select 'account_mismatch', count(*) filter (skip = 'account_mismatch') from judged
    union all select 'invalid_json_lines', count(*) filter (broken) from logged
    union all select 'unpriced_calls', count(*) filter (not priced) from priced) where "count" > 0""",
    "usage", "samples", "acct_last", "mode_last", "priced", extra=_LOGS,
)
_FILES = {
    "firsts": "select session_id, min(ts) as first, max(ts) as mtime from usage group by 1",
    "files": """select session_id, mtime, date_trunc('second', first) as written, date_trunc('day', first) as day,
        concat('/sessions/', strftime(first, '%Y/%m/%d/rollout-%Y-%m-%dT%H-%M-%S-'), session_id, '.jsonl') as file_path from firsts""",
    "acted": f"""select *, case when day > {END} then 'skip_folder' when written > {END} then 'skip_late' when written >= {START} then 'read'
        when written >= {START} - interval 7 days then 'tail' when mtime >= {START} then 'tail_mtime' else 'skip_old' end as action from files""",
}
SQL["file_prune"] = with_("select file_path, session_id, action from acted", "usage", extra=_FILES)
SQL["stale_files"] = with_(
    f"""select file_path, action, epoch_us(last_event) as last_event from (select a.file_path, a.action, arg_max(u.ts, u.event_id) as last_event
    from acted a join usage u using (session_id) where action like 'tail%' group by all) where last_event < {START}""",
    "usage", extra=_FILES,
)
_FORKS = """select concat('/forks/c', user_id, '.jsonl') as file_path, concat('c', user_id) as pinned_id, concat('u', user_id) as parent_session_id,
    concat('/forks/u', user_id, '.jsonl') as parent_path, least(count(*), user_id % 7) + 2 as replay_prefix_lines from ev where user_id % 3 = 0 group by user_id"""
SQL["fork_replay"] = with_(_FORKS, "ev")
SQL["fork_counters"] = with_(
    f"""select count(*) as fork_files, cast(0 as bigint) as fork_parent_missing, cast(sum(replay_prefix_lines - 1) as bigint) as fork_replay_lines
    from ({_FORKS})""",
    "ev",
)

SQL["fork_names"] = with_(
    """select k.file_path, k.first_id as pinned_id, k.second_id as parent_session_id, min(f.file_path) as parent_path from (
      select concat('/kids/', session_id) as file_path, concat('kid-', session_id) as first_id, case user_id % 4 when 0 then session_id[2:]
        when 1 then session_id[-5:] when 2 then concat('x', session_id) else concat('-', session_id, '.jsonl') end as second_id
      from (select distinct session_id, user_id from usage)) k
    left join acted f on contains(split_part(f.file_path, '/', -1), k.second_id) group by all""",
    "usage", extra=_FILES,
)

# --- folders of logs ---------------------------------------------------------

_TREE = {
    "grouped": """select *, case when event_id % 5 = 4 then 'z' when event_id % 2 = 0 then 'a' else 'b' end as g, date_trunc('day', ts) as d0 from ev""",
    "filed": """select *, cast(case when g = 'b' then d0 - to_days(cast(dayofyear(d0) % 2 as integer)) else d0 end as timestamp) as day from grouped""",
    "lined": """select *, concat(g, strftime(day, '%Y%m%d')) as session_id,
        1 + sum(1 + (k % 7 = 0)::int) over w as line_no,
        coalesce(last_value(case when k % 7 = 0 then concat('m', k % 3) end ignore nulls) over w, 'm9') as model
        from filed window w as (partition by g, day order by ts, event_id rows unbounded preceding)""",
    "listed": f"""select session_id, g, day, max(line_no) as lines, max(ts) filter (k % 11 <> 0) as last_token,
        case when day > {END} then case when g = 'z' then 'skip_late' else 'skip_folder' end when day >= {START} then 'read'
          when day >= {START} - interval 7 days then 'tail' else 'tail_mtime' end as action from lined group by all""",
    "kept": f"select *, action in ('tail', 'tail_mtime') and coalesce(last_token < {START}, false) as stale from listed",
}
_SCANNED = f"""select concat('rollout-', strftime(day, '%Y-%m-%dT%H-%M-%S'), '-', session_id, '.jsonl') as file_name, cast(line_no as bigint) as line_no,
    us as timestamp, session_id, model, '/w' as cwd, cast(floor(value*100) as bigint) as input_tokens, cast(floor(value*100) as bigint) + k*10 as total_tokens
    from lined where k % 11 <> 0 and ts >= {START} and ts <= {END}"""
SQL["scan_records"] = with_(_SCANNED, "ev", extra=_TREE)
SQL["scan_indexed"] = with_(_SCANNED, "ev", extra=_TREE)
SQL["scan_counters"] = with_(
    f"""select count(*) filter (action not like 'skip%' and not stale) as read_files, count(*) filter (action = 'skip_late') as skipped_files,
    count(*) filter (stale) as prefiltered_files, count(*) filter (action like 'tail%') as tail_read_files,
    count(*) filter (action like 'tail%' and not stale) as tail_read_hits, count(*) filter (action = 'tail_mtime') as mtime_read_files,
    2 + count(distinct day) filter (g <> 'z' and day <= {END}) + count(distinct date_trunc('month', day)) filter (g <> 'z' and day <= {END})
      + count(distinct date_trunc('year', day)) filter (g <> 'z' and day <= {END}) as scanned_directories,
    count(distinct day) filter (g <> 'z' and day > {END}) as skipped_directories,
    cast(sum(lines) filter (action not like 'skip%' and not stale) as bigint) as read_lines, cast(0 as bigint) as invalid_json_lines,
    (select count(*) from lined join kept using (session_id) where k % 11 <> 0 and action not like 'skip%' and not stale) as token_count_events,
    (select count(*) from lined where k % 11 <> 0 and ts >= {START} and ts <= {END}) as included_usage_events,
    (select count(*) from lined join kept using (session_id) where k % 11 <> 0 and action not like 'skip%' and not stale
      and not (ts >= {START} and ts <= {END})) as out_of_range
    from kept""",
    "ev", extra=_TREE,
)

# --- histories and health ---------------------------------------------------

SQL["history_normalize"] = with_(
    """select us as ts, concat('a', user_id%5) as account_id, concat('a', (user_id+1)%5) as from_account_id, 'auth select' as source
    from ev where event_type='signup' and k<20 and k%3<>0""",
    "ev",
)
SQL["history_status"] = with_(
    f"""select count(*) as switch_count, epoch_us(max(ts)) as latest_switch_at, arg_max(fast, (ts, event_id)) as latest_switch_fast,
    epoch_us({NOW}) as as_of, arg_max(fast, (ts, event_id)) filter (ts <= {NOW}) as fast,
    case arg_max(fast, (ts, event_id)) filter (ts <= {NOW}) when true then 'on' when false then 'off' else 'unknown' end as state from mode_sw""",
    "mode_sw",
)
SQL["history_append"] = with_(
    """select h.fast, count(*) as records from usage u asof left join hist h on u.ts >= h.ts group by 1""",
    "usage", "mode_sw",
    extra={
        "hist": f"""select ts, arg_max(fast, event_id) as fast from (select ts, event_id, fast from mode_sw
            union all select {NOW}, (select max(event_id) + 1 from mode_sw), true) group by ts"""
    },
)
_RECENT = f"ts between {NOW} - interval 7 days and {NOW}"
SQL["health_usage"] = with_(
    f"""select count(*) as included_usage_events, count(*) filter (not priced) as unpriced_calls,
    cast(coalesce(sum(total_tokens) filter (not priced), 0) as bigint) as unpriced_tokens,
    case when count(*) = 0 or count(*) filter (not priced) > 0 then 'warn' else 'ok' end as status from priced where {_RECENT}""",
    "priced",
)
SQL["health_unpriced"] = with_(
    f"""select norm as pricing_key, arg_min(model, (file_path, event_id)) as model, count(*) as calls, cast(sum(total_tokens) as bigint) as total_tokens
    from priced where not priced and {_RECENT} group by 1""",
    "priced",
)
SQL["health_quota"] = with_(
    f"""select count(*) as sample_count, count(*) filter (window_minutes = 300) as five_hour_samples,
    count(*) filter (window_minutes = 10080) as seven_day_samples, max(us) as latest_observed_at,
    case when count(*) = 0 then 'warn' else 'ok' end as status from samples where {_RECENT}""",
    "samples",
)
SQL["rate_card_use"] = with_(
    """select card_key, c.label, cast(in_rate as double) as in_rate, cast(fast_mult as double) as fast_mult, coalesce(calls, 0) as calls
    from card c left join (select label, count(*) as calls from priced where priced group by 1) p on c.label = p.label""",
    "card", "priced",
)
SQL["history_commits"] = SQL["history_append"]
