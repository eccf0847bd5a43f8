"""Named SQL building blocks for the checking queries (DuckDB dialect)."""

from __future__ import annotations

import re

SW = "(partition by symbol, session_date order by bar)"

CTES: dict[str, str] = {
    "ticks": """select event_id as seq, concat('S', cast(user_id % 2 as varchar)) as symbol, ts,
        cast(ts as date) as session_date, 100.0 + value as spot, cast(event_id % 400 as double) as volume,
        epoch_us(ts) - epoch_us(date_trunc('day', ts)) as us from events""",
    "rth": """select *, cast(ceil(us / 300000000.0) * 5 - 570 as int) as bar from ticks
        where us between 34200000000 and 57600000000 and isodow(ts) <= 5 and spot > 0""",
    "spine": """select symbol, session_date, bar,
        session_date + to_minutes(cast(570 + bar as bigint)) as bts
        from (select distinct symbol, session_date from rth), (select unnest(range(0, 391, 5)) as bar)""",
    "grid": """select s.symbol, s.session_date, s.bar, t.spot, t.bar as src
        from spine s asof left join rth t
        on s.symbol = t.symbol and s.session_date = t.session_date and s.bts >= t.ts""",
    "bars": """select symbol, session_date, bar, arg_max(spot, ts) as spot, arg_min(spot, ts) as open,
        max(spot) as high, min(spot) as low, sum(volume) as volume, count(*) as n_ticks
        from rth group by symbol, session_date, bar""",
    "prints": """select event_id as seq, concat('S', cast(user_id % 2 as varchar)) as symbol, ts,
        cast(ts as date) as session_date, value as premium,
        case when user_id % 4 < 2 then 'call' else 'P' end as option_type,
        cast(100 + 5 * (event_id % 21) as double) as strike,
        case event_type when 'click' then 'ask' when 'purchase' then 'buy' when 'error' then 'bid'
            when 'signup' then 'sell' else 'mid' end as side,
        case event_type when 'purchase' then 'block' when 'signup' then 'dark_pool'
            when 'click' then 'sweep' else 'regular' end as trade_type,
        cast((event_id * 37) % 700 as double) as size,
        epoch_us(ts) - epoch_us(date_trunc('day', ts)) as us from events""",
    "ladder": """select event_id as seq, concat('S', cast(user_id % 2 as varchar)) as symbol, ts,
        cast(ts as date) as session_date, epoch_us(ts) - epoch_us(date_trunc('day', ts)) as us,
        cast(100 + 5 * (event_id % 21) as double) as strike,
        case when event_id % 29 = 0 then null
            else value * case when event_type in ('click','purchase','view') then 1.0 else -1.0 end end as gex,
        case when event_id % 17 = 0 then null else value - 50.0 end as vanna,
        case when event_id % 19 = 0 then null else (50.0 - value) * 0.1 end as charm,
        cast(event_id % 1000 as double) as call_oi, cast((event_id * 7) % 1000 as double) as put_oi,
        value * 100.0 as call_prem, cast(event_id % 100 as double) * 50.0 as put_prem,
        case when user_id % 2 = 0 then value * 60.0 end as call_ask_prem,
        case when user_id % 2 = 0 then value * 40.0 end as call_bid_prem,
        case when user_id % 2 = 0 then cast(event_id % 100 as double) * 20.0 end as put_ask_prem,
        case when user_id % 2 = 0 then cast(event_id % 100 as double) * 30.0 end as put_bid_prem,
        cast(event_id % 50 as double) as call_vol, cast((event_id * 3) % 50 as double) as put_vol from events""",
    "optbars": """select seq, symbol, ts, session_date, us, type, strike,
        case when type = 'C' then greatest(50.0 - 5 * (seq % 21), 0.0) + value / 10.0
            else greatest(5 * (seq % 21) - 50.0, 0.0) + value / 12.0 end as c,
        cast(case when type = 'C' then seq % 400 else (seq * 3) % 400 end as double) as v
        from (select event_id as seq, concat('S', cast(user_id % 2 as varchar)) as symbol, ts, value,
            cast(ts as date) as session_date, epoch_us(ts) - epoch_us(date_trunc('day', ts)) as us,
            cast(100 + 5 * (event_id % 21) as double) as strike from events), (values ('C'), ('P')) as k(type)""",
    "daily": """select cast(o_orderdate as date) as session_date, arg_min(o_totalprice, o_orderkey) as open,
        arg_max(o_totalprice, o_orderkey) as close, max(o_totalprice) as high, min(o_totalprice) as low
        from orders group by 1""",
    "daily_alt": """select cast(l_shipdate as date) as session_date, max(l_extendedprice) as close
        from lineitem group by 1""",
    "trades": """select l_orderkey, l_linenumber, l_returnflag as horizon, l_linestatus as reason,
        cast(l_shipdate as date) as day, cast(l_quantity as int) as contracts, l_quantity * 1.4 as costs,
        l_extendedprice * (l_discount - 0.05) as pnl_net, l_discount >= 0.05 as hit_target from lineitem""",
    "preds": """select event_id as seq, ts, cast(ts as date) as session_date,
        epoch_us(ts) - epoch_us(date_trunc('day', ts)) as us,
        case event_id % 3 when 0 then '5m' when 1 then '20m' else 'eod' end as horizon,
        (value - 50.0) / 50.0 as y, (cast((event_id * 13) % 101 as double) - 50.0) / 50.0 as lgb,
        case when event_id % 7 = 0 then null else (cast((event_id * 29) % 97 as double) - 48.0) / 48.0 end as cat,
        cast(-0.8 as double) as q10, cast(0.05 as double) as q50, cast(0.9 as double) as q90 from events""",
    "board": """select o_orderkey as trial, o_orderpriority as node,
        case o_orderstatus when 'O' then 'ok' when 'F' then 'pruned' else 'failed' end as status,
        case when o_orderstatus = 'O' then o_totalprice / 1000000.0 end as score,
        o_totalprice / 1000000.0 as screen_score, cast(o_custkey % 600 as double) as seconds,
        case when o_custkey % 10 = 0 then 'full_session' else 'eod_pre11' end as scoring_version from orders""",
}


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def q(sql: str) -> str:
    """Prefix ``sql`` with every named block it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n" + sql


def sdiv(a: str, b: str, fill: str = "0.0") -> str:
    return f"coalesce(case when abs({b}) >= 1e-9 then ({a}) / ({b}) end, {fill})"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"case when ({x}) is not null then greatest({lo}, least({hi}, {x})) end"


def roll(x: str, n: int, fn: str, least: int = 1) -> str:
    over = f"over (partition by symbol, session_date order by bar rows {n - 1} preceding)"
    return f"case when count({x}) {over} >= {least} then {fn}({x}) {over} end"


def zscore(x: str, n: int = 60, least: int = 20) -> str:
    z = sdiv(f"{x} - ({roll(x, n, 'avg', least)})", f"({roll(x, n, 'stddev_samp', least)})")
    return f"greatest(-8.0, least(8.0, {z}))"
