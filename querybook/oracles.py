"""The same results in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

from wardwise.sources.dimensions import OFFICIAL_STATES, STATE_CENTROIDS

ORACLES: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- views ---------------------------------------------------------------------

CUST = """cust as (
  select c.c_custkey as k, c.c_mktsegment as segment, n.n_name as state,
         concat(c.c_mktsegment, ' ', cast(c.c_custkey % 7 as varchar)) as district,
         cast(110000 + c.c_custkey % 900 as int) as pincode
  from customer c join nation n on c.c_nationkey = n.n_nationkey)"""

ENROL = CUST + """,
enrol as (
  select cast(o.o_orderdate as date) as date, c.state, c.district, c.pincode,
         cast(l.l_quantity as bigint) as adult_enrolments
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join cust c on o.o_custkey = c.k)"""

BIO = """bio as (
  select cast(o.o_orderdate as date) as date, c.state, replace(c.district, '6', '7') as district, c.pincode,
         cast(o.o_orderkey % 13 + o.o_orderkey % 29 as bigint) as bio_stress
  from orders o join cust c on o.o_custkey = c.k)"""

DEMO = """demo as (
  select cast(e.ts as date) as date, c.state, c.district, c.pincode,
         cast(floor(e.value) as bigint) + cast(e.event_id % 7 as bigint) as update_volume
  from events e join cust c on e.user_id = c.k)"""

_RAW_KEYS = """
    case when {key} % 97 = 0 then 'not a date'
         when {key} % 89 = 0 then strftime({day}, '%Y-%m-%d')
         when {key} % 83 = 0 then strftime({day}, '%d-%m-%y')
         when {key} % 79 = 0 then strftime({day}, '%-d %b %Y')
         when {key} % 73 = 0 then strftime({day}, '%Y-%m-%d 00:00:00')
         when {key} % 71 = 0 then strftime({day}, '%-d/%B/%y')
         else strftime({day}, '%d-%m-%Y') end as date,
    case c.k % 5 when 0 then lower(c.state) when 1 then concat(' ', c.state, ' ')
         when 2 then 'jammu & kashmir' when 3 then 'o''brien-nagar y.s.r.' else c.state end as state,
    lower(c.segment) as district,
    case when c.k % 11 = 0 then 'NA' when c.k % 13 = 0 then null
         else cast(c.pincode as varchar) end as pincode"""

RAW_ENROL = CUST + """,
raw_enrol as (
  select """ + _RAW_KEYS.format(key="o.o_orderkey", day="cast(o.o_orderdate as date)") + """,
    case when l.l_linenumber = 7 then null else l.l_linenumber end as age_0_5,
    cast(l.l_orderkey % 5 as int) as age_5_17,
    case when l.l_orderkey % 17 = 0 then null else cast(l.l_quantity as bigint) end as age_18_greater
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join cust c on o.o_custkey = c.k)"""

RAW_BIO = CUST + """,
raw_bio as (
  select """ + _RAW_KEYS.format(key="o.o_orderkey", day="cast(o.o_orderdate as date)") + """,
    case when o.o_orderkey % 31 = 0 then null else o.o_orderkey % 13 end as bio_age_5_17,
    case when o.o_orderkey % 37 = 0 then null else o.o_orderkey % 29 end as bio_age_17_
  from orders o join cust c on o.o_custkey = c.k)"""

RAW_DEMO = CUST + """,
raw_demo as (
  select """ + _RAW_KEYS.format(key="e.event_id", day="cast(e.ts as date)") + """,
    case when e.event_id % 19 = 0 then null else cast(floor(e.value) as bigint) end as demo_age_5_17,
    case when e.event_id % 23 = 0 then null else e.event_id % 7 end as demo_age_17_
  from events e join cust c on e.user_id = c.k)"""

OFFICIAL = "off(i, nm) as (values " + ", ".join(
    f"({i}, {_quote(n)})" for i, n in enumerate(OFFICIAL_STATES)
) + ")"

CENTRES = "centres(state, lat, lon) as (values " + ", ".join(
    f"({_quote(n)}, {lat}::double, {lon}::double)" for n, (lat, lon) in STATE_CENTROIDS.items()
) + ")"

DIRTY = OFFICIAL + """,
names as (
  select c.c_custkey as k,
    case c.c_custkey % 50 when 0 then substr(nm, 1, length(nm) - 1) when 1 then lower(nm)
         when 2 then concat('  ', upper(nm), ' ') when 3 then replace(nm, ' & ', ' And ')
         when 4 then concat(nm, 'x') else nm end as state,
    case c.c_custkey % 50 when 5 then concat(nm, 'h')
         when 6 then concat(substr(nm, 1, 3), substr(nm, 5, 40))
         when 7 then concat(substr(nm, 1, 4), substr(nm, 4, 40)) else nm end as district,
    cast(case when c.c_custkey % 100 >= 55 and c.c_custkey % 50 in (5, 6, 7)
              then 900000 + c.c_custkey % 37
              else 500000 + (c.c_custkey % 37) * 10 + c.c_custkey % 3 end as int) as pincode
  from customer c join off on off.i = c.c_custkey % 37),
dirty as (
  select cast(o.o_orderdate as date) as date, c.state, c.district, c.pincode,
         cast(l.l_quantity as bigint) as adult_enrolments
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join names c on o.o_custkey = c.k)"""

_LOG = """{name} as (
  select concat('g', lpad(cast(e.event_id as varchar), 12, '0')) as id, e.ts,
    case when e.event_id % 2 = 0 then 'State' else 'District' end as scope,
    case when e.event_type = 'signup' then 'Revert' when e.event_type = 'error' then 'Delete'
         else 'Merge' end as action,
    {original} as original,
    case when e.event_type = 'signup'
         then concat('g', lpad(cast(greatest(e.event_id - 3, 0) as varchar), 12, '0'))
         when e.event_type = 'error' then 'N/A' else {target} end as target,
    concat('Admin_', lpad(cast(e.user_id % 5 as varchar), 2, '0')) as "user"
  from events e join {people} c on e.user_id = c.k)"""

LOG = _LOG.format(
    name="log",
    people="cust",
    original="""case
      when e.event_id % 2 = 0 and e.event_type = 'error' then concat('NATION_', cast(e.user_id % 50 + 20 as varchar))
      when e.event_id % 2 = 0 then concat('NATION_', cast(e.user_id % 25 as varchar))
      when e.event_type = 'error' then concat(c.segment, ' ', cast(e.user_id % 7 + 5 as varchar))
      else concat(c.segment, ' ', cast(e.user_id % 7 as varchar)) end""",
    target="""case when e.event_id % 2 = 0 then concat('NATION_', cast((e.user_id + e.event_id) % 25 as varchar))
      else concat('HOUSEHOLD ', cast(e.event_id % 7 as varchar)) end""",
)

DIRTY_LOG = _LOG.format(
    name="log", people="names",
    original="case when e.event_id % 2 = 0 then c.state else c.district end",
    target="'Goa'",
)

STANDING = """standing as (
  select * from log l where action <> 'Revert'
  and not exists (select 1 from log r where r.action = 'Revert' and r.target = l.id))"""

PATCHES = """patches as (
  select scope, original, target from (
    select *, row_number() over (partition by scope, original order by ts desc, id desc) as rn
    from standing where action = 'Merge') where rn = 1),
gone as (select distinct scope, original from standing where action = 'Delete')"""

SHARE = """share as (
  select state, district, cast(sum(adult_enrolments) as bigint) as adult_enrolments
  from enrol group by state, district)"""

RANGE = "date between date '1996-03-01' and date '1998-06-30'"
STATES = "('NATION_3', 'NATION_7', 'NATION_19', 'NATION_24')"


def oracle(name: str, *parts: str) -> None:
    *ctes, body = parts
    ORACLES[name] = "with recursive " + ",\n".join(ctes) + "\n" + body


# --- ingestion ---------------------------------------------------------------------

oracle("feed_union", RAW_ENROL, """
select date, state, district, pincode,
       case when age_5_17 % 2 = 0 then age_0_5 end as age_0_5, age_5_17,
       case when age_5_17 % 2 = 0 then age_18_greater end as age_18_greater
from raw_enrol""")
oracle("bio_fallback", ENROL, """
select date, state, district, pincode, trunc(adult_enrolments * 0.4::double)::bigint as bio_stress,
       true as is_simulated from enrol""")
oracle("adult_measure", RAW_ENROL, """
select *, coalesce(age_18_greater, 0)::bigint as adult_enrolments from raw_enrol""")
oracle("adult_measure_children_only", RAW_ENROL, """
select * exclude (age_18_greater), (coalesce(age_0_5, 0) + coalesce(age_5_17, 0))::bigint as adult_enrolments
from raw_enrol""")
oracle("bio_measure", RAW_BIO, """
select *, (coalesce(bio_age_5_17, 0) + coalesce(bio_age_17_, 0))::bigint as bio_stress from raw_bio""")
oracle("demo_measure", RAW_DEMO, """
select *, (coalesce(demo_age_5_17, 0) + coalesce(demo_age_17_, 0))::bigint as update_volume from raw_demo""")

_PARSED = """cast(coalesce(try_strptime(date, '%d-%m-%y'), try_strptime(date, '%d-%m-%Y'), try_strptime(date, '%Y-%m-%d'),
    try_strptime(date, '%d %b %Y'), try_strptime(date, '%Y-%m-%d %H:%M:%S'),
    try_strptime(date, '%d/%B/%y')) as date)"""
_PIN = "coalesce(trunc(try_cast(pincode as double)), 0)::int"


def _title(col: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({col}) + 1), lambda i: "
        f"case when i = 1 or not regexp_matches(substr({col}, i - 1, 1), '[A-Za-z]') "
        f"then upper(substr({col}, i, 1)) else lower(substr({col}, i, 1)) end), '')"
    )


def _standard(raw: str, measure: str, alias: str) -> str:
    return f"""
select {_PARSED} as date, trim({_title('state')}) as state, trim({_title('district')}) as district,
       {_PIN} as pincode, ({measure})::bigint as {alias} from {raw}"""


oracle("standardized_enrol", RAW_ENROL, _standard("raw_enrol", "coalesce(age_18_greater, 0)", "adult_enrolments"))
oracle("standardized_bio", RAW_BIO, _standard(
    "raw_bio", "coalesce(bio_age_5_17, 0) + coalesce(bio_age_17_, 0)", "bio_stress"))
oracle("standardized_demo", RAW_DEMO, _standard(
    "raw_demo", "coalesce(demo_age_5_17, 0) + coalesce(demo_age_17_, 0)", "update_volume"))
oracle("missing_names", RAW_ENROL, f"""
select count(*) filter (where state is null) as no_state,
       count(*) filter (where district is null) as no_district,
       count(*) filter (where {_PARSED} is null) as no_date from raw_enrol""")
oracle("date_parse", RAW_ENROL, f"select date, {_PARSED} as parsed from raw_enrol")
oracle("pin_coerce", RAW_ENROL, f"select pincode, {_PIN} as pin from raw_enrol")
oracle("title_case_names", RAW_ENROL, f"""
select state, district, {_title('state')} as state_title, {_title('district')} as district_title
from raw_enrol""")

# --- aggregates ----------------------------------------------------------------------

oracle("market_share", ENROL, SHARE, "select * from share")
DAILY = """daily as (
  select date, cast(sum(adult_enrolments) as bigint) as v from enrol where date is not null group by date)"""
oracle("daily_totals", ENROL, DAILY, "select date, v as adult_enrolments from daily")
oracle("daily_totals_raw", RAW_ENROL, f"""
select date, sum(v)::bigint as adult_enrolments from (
  select {_PARSED} as date, coalesce(age_18_greater, 0) as v from raw_enrol)
where date is not null group by date""")
oracle("daily_totals_by_state", ENROL, """
select state, date, sum(adult_enrolments)::bigint as adult_enrolments from enrol group by state, date""")
oracle("state_totals", ENROL, """
select state, sum(adult_enrolments)::bigint as adult_enrolments from enrol group by state""")
oracle("demo_share", CUST, DEMO, """
select state, district, sum(update_volume)::bigint as update_volume from demo group by state, district""")
oracle("district_totals", ENROL, """
select district, sum(adult_enrolments)::bigint as adult_enrolments from enrol group by district""")
oracle("kpi_analytics", ENROL, f"""
select coalesce(sum(adult_enrolments), 0)::bigint as total_enrolments,
       count(distinct state) as active_states, count(distinct district) as active_districts
from enrol""")
oracle("hotspot", ENROL, """
select district as hotspot, sum(adult_enrolments)::bigint as hotspot_volume
from enrol group by district order by 2 desc, 1 limit 1""")
oracle("date_extent", ENROL, 'select min(date) as "first", max(date) as "last" from enrol')
oracle("distinct_states", DIRTY, "select distinct state from dirty")
oracle("name_counts", DIRTY, "select district, count(*) as records from dirty group by district")
PINS = "pins as (select distinct district, pincode from dirty where pincode > 0)"
LABELS = """labels_of as (
  select district, count(*) as n_pins,
         array_to_string(list_sort(list(pincode))[1:3], ', ')
           || case when count(*) > 3 then '...' else '' end as pins
  from pins group by district)"""
oracle("pin_sets", DIRTY, PINS, "select * from pins")
oracle("pin_labels", DIRTY, PINS, LABELS, "select * from labels_of")

# --- workload --------------------------------------------------------------------------

WORKLOAD = """work as (
  select coalesce(e.district, b.district) as district, coalesce(e.v, 0)::bigint as Enrolments,
         coalesce(b.v, 0)::bigint as Bio_Updates
  from (select district, sum(adult_enrolments) as v from enrol group by district) e
  full join (select district, sum(bio_stress) as v from bio group by district) b on e.district = b.district)"""
oracle("workload_by_district", ENROL, BIO, WORKLOAD, "select * from work")
oracle("ops_export", ENROL, BIO, WORKLOAD, "select * from work")
oracle("workload_ratio", ENROL, BIO, WORKLOAD, """
select new_enrolments, bio_updates, round(r, 6) as ratio,
       printf('ℹ️ **Insight:** Ratio: %.1f biometric updates per enrolment.', r) as insight
from (select sum(Enrolments)::bigint as new_enrolments, sum(Bio_Updates)::bigint as bio_updates,
             sum(Bio_Updates)::double / (sum(Enrolments) + 1)::double as r from work)""")

# --- filters and rankings -----------------------------------------------------------------

oracle("state_filter", ENROL, f"select * from enrol where state in {STATES}")
oracle("date_range_view", ENROL, f"select * from enrol where {RANGE}")
oracle("regional_export", ENROL, f"""
select state, district, sum(adult_enrolments)::bigint as adult_enrolments
from enrol group by state, district""")
oracle("trend_export", ENROL, f"""
select date, sum(adult_enrolments)::bigint as adult_enrolments from enrol where date is not null group by date""")
oracle("top_states", ENROL, f"""
select state, sum(adult_enrolments)::bigint as adult_enrolments from enrol
group by state order by 2 desc, 1 limit 10""")
oracle("watchlist", ENROL, """
select state, district, sum(adult_enrolments)::bigint as adult_enrolments from enrol
where adult_enrolments > 0 group by state, district order by 3, 1, 2 limit 10""")
TOP5 = """top5 as (
  select state, district, adult_enrolments from (
    select *, row_number() over (partition by state order by adult_enrolments desc, district) as rn from share)
  where rn <= 5)"""
oracle("top5_per_state", ENROL, SHARE, TOP5, "select * from top5")
RECENT = """recent as (
  select * from enrol where date is not null
  order by date desc, state, district, pincode, adult_enrolments limit 60)"""
oracle("recent_history", ENROL, RECENT, "select * from recent")
oracle("market_share_page", ENROL, SHARE, """
select * from share order by adult_enrolments desc, state, district limit 10 offset 20""")


# --- forecast --------------------------------------------------------------------------------

def _series(keys: tuple[str, ...]) -> str:
    """CTEs ``chg`` and ``ser`` (state of each series) for the given keys."""
    k = "".join(f"{c}, " for c in keys)
    part = f"partition by {', '.join(keys)}" if keys else ""
    by = f"group by {', '.join(keys)}" if keys else "having count(*) > 0"
    return f"""chg as (
  select *, v::double / nullif(previous, 0)::double - 1 as change,
         coalesce(previous = 0 and v <> 0, false) as from_zero from (
    select {k}date, v, lag(v) over ({part} order by date) as previous from (
      select {k}date, cast(sum(adult_enrolments) as bigint) as v from enrol
      where date is not null group by {k}date))),
ser as (
  select {k}count(*) as days, max(date) as last_date,
         case when arg_max(v, date) < 10 and count(*) > 1 then arg_max(previous, date)
              else arg_max(v, date) end as start_value,
         case when count(*) > 5 and not bool_or(from_zero) and stddev_samp(change) > 0
              then stddev_samp(change) else 0.05::double end as volatility
  from chg {by})"""


_HEX = "('0x' || substr(md5({t}), {p}, 8))::bigint"


def _normal(text: str) -> str:
    u1 = f"(({_HEX.format(t=text, p=1)} + 0.5::double) / 4294967296::double)"
    u2 = f"(({_HEX.format(t=text, p=9)} + 0.5::double) / 4294967296::double)"
    return f"(sqrt(-2::double * ln({u1})) * cos(2::double * pi() * {u2}))"


def _projection(keys=(), scenarios=(("base", 0.0, 30, "Linear"),), vol="volatility") -> str:
    k = "".join(f"{c}, " for c in keys)
    text = "concat_ws('|', '42'" + "".join(f", {c}" for c in keys) + ", step::varchar)"
    grid = ", ".join(f"('{n}', {float(g)}::double, {h}, '{m}')" for n, g, h, m in scenarios)
    return f"""grid(scenario, growth, horizon, model) as (values {grid}),
steps as (
  select {k}scenario, model, growth, horizon, last_date, start_value,
         unnest(range(1, horizon + 1)) as step, {vol} as vol from ser, grid),
proj as (
  select {k}scenario, model, cast(last_date + step::int as date) as date,
         greatest(0::double, start_value * product(
           1::double + case when model = 'Linear' then 0.002::double else 0.005::double end
           + vol * {_normal(text)}) over (partition by {k}scenario order by step)
           * pow(1::double + growth / horizon, step)) as p
  from steps)"""


_BANDS = ", ".join(
    f"printf('%.9e', p * {f}::double)::double as {name}"
    for f, name in ((1, "predicted"), (1.2, "upper"), (0.8, "lower"))
)
SER, PROJ = _series(()), _projection()

_REACH = """sum(adult_enrolments)::bigint as adult_enrolments, count(distinct state) as active_states,
  count(distinct district) as active_districts, count(distinct pincode) filter (where pincode > 0) as active_pins"""
oracle("reach_by_month", ENROL, f"""
select date_trunc('month', date)::date as month, state, {_REACH} from enrol group by all""")
oracle("reach_range", ENROL, f"""
select {_REACH} from enrol where date between date '1996-03-01' and date '1998-06-30'""")

oracle("daily_change", ENROL, SER, """
select date, v as adult_enrolments, previous, round(change, 6) as change, from_zero from chg""")
oracle("volatility", ENROL, SER, "select days, round(volatility, 6) as volatility from ser")
oracle("start_value", ENROL, SER, "select last_date, start_value from ser")
oracle("series_state_by_district", ENROL, _series(("state", "district")), """
select state, district, days, last_date, start_value, round(volatility, 6) as volatility from ser""")
oracle("forecast_drift_only", ENROL, SER, """
select cast(last_date + i::int as date) as date, round(p, 6) as predicted,
       round(p * 1.2::double, 6) as upper, round(p * 0.8::double, 6) as lower
from (select last_date, i, start_value * pow(1.002::double, i) * pow(1 + 0.1::double / 90, i) as p
      from ser, range(1, 91) r(i))""")
oracle("forecast_seeded", ENROL, SER, PROJ, f"select date, {_BANDS} from proj")
oracle("forecast_by_state", ENROL, _series(("state",)),
       _projection(("state",), (("base", 0.0, 14, "Polynomial"),)),
       f"select state, date, {_BANDS} from proj")
oracle("forecast_bands", ENROL, _series(("state",)), f"""
draws as (
  select state, path, step, last_date, start_value, 1::double + 0.005::double
         + volatility * {_normal("concat_ws('|', '42', state, path::varchar, step::varchar)")} as f
  from ser, range(1, 201) as a(path), range(1, 15) as b(step)),
grown as (
  select state, last_date + step::int as date, greatest(0::double,
         start_value * product(f) over (partition by state, path order by step)) as value
  from draws)""", """
select state, date::date as date, printf('%.9e', quantile_disc(value, 0.1))::double as lower,
  printf('%.9e', quantile_disc(value, 0.5))::double as middle, printf('%.9e', quantile_disc(value, 0.9))::double as upper
from grown group by state, date""")
oracle("forecast_by_district", ENROL, _series(("state", "district")),
       _projection(("state", "district"), (("base", 0.0, 7, "Linear"),)),
       f"select state, district, date, {_BANDS} from proj")
oracle("forecast_scenarios", ENROL, SER, _projection((), [
    (f"{m} {s:+d}% {h}d", s / 100.0, h, m)
    for m in ("Linear", "Polynomial") for s in (-50, 0, 50) for h in (7, 30, 90)]),
    f"select scenario, model, date, {_BANDS} from proj")
oracle("forecast_summary", ENROL, SER, PROJ, """
select round(max(p), 6) as peak, round(min(p), 6) as floor, round(avg(p), 6) as mean from proj""")
ENDS = "ends as (select arg_min(p, date) as a, arg_max(p, date) as b from proj)"
oracle("forecast_growth", ENROL, SER, PROJ, ENDS, """
select round(case when a > 0 then (b - a) / a * 100 else 0::double end, 6) as growth_pct from ends""")


def _insight(model: str) -> str:
    return f"""case when chg_pct is null then 'Insufficient data for insight.' else
  printf('**%s Projection:** The {model} stochastic model predicts a **%.1f%% %s**.',
    case when chg_pct > 0 then '📈' else '📉' end, abs(chg_pct),
    case when chg_pct > 0 then 'Growth' else 'Decline' end)
  || chr(10) || chr(10) ||
  case when abs(chg_pct) > 10 then ' **Action Required:** Significant volume shift detected.'
       else ' **Status:** Operations expected to remain stable.' end end as insight"""


oracle("forecast_insight", ENROL, SER, PROJ, ENDS, f"""
select round(chg_pct, 6) as change_pct, {_insight('Linear')}
from (select (b / nullif(a, 0) - 1) * 100 as chg_pct from ends)""")
SER_S, PROJ_S = _series(("state",)), _projection(("state",), vol="0.05::double")
oracle("insight_by_state", ENROL, SER_S, PROJ_S, f"""
select state, round(chg_pct, 6) as change_pct, {_insight('Linear')}
from (select state, (arg_max(p, date) / nullif(arg_min(p, date), 0) - 1) * 100 as chg_pct
      from proj group by state)""")


def _capacity(key: str) -> str:
    k = f"{key}, " if key else ""
    return f"""
select {k}try_cast(ceil(peak / 40) as bigint) as operators, round(peak * 5 / 1024, 6) as peak_gb_per_day,
       try_cast(trunc(mean) as bigint) as mean_daily_volume, peak / 40 > 100 as high_load,
       case when peak / 40 > 100 then
         concat('⚠️ **High Load Alert:** Peak volume (', coalesce(try_cast(trunc(peak) as bigint)::varchar, 'null'),
           ') requires significant staffing (', coalesce(try_cast(ceil(peak / 40) as bigint)::varchar, 'null'),
           ' operators).')
       else concat('✅ **Stable Load:** Projected peak of ', trunc(peak)::bigint::varchar,
           '/day is within current capacity.') end as status
from (select {k}max(p) as peak, avg(p) as mean from proj {f"group by {key}" if key else ""})"""


oracle("capacity_plan", ENROL, SER, PROJ, _capacity(""))
oracle("capacity_by_state", ENROL, SER_S, PROJ_S, _capacity("state"))
_FUTURE = """
union all select 'AI Projection', date, """ + _BANDS + " from proj"
oracle("forecast_envelope", ENROL, SER, PROJ, RECENT, """
select 'Historical Data' as series, date, adult_enrolments::double as value,
       null::double as upper, null::double as lower from recent""" + _FUTURE)
oracle("forecast_envelope_daily", ENROL, SER, PROJ, """
select * from (select 'Historical Data' as series, date, v::double as value,
       null::double as upper, null::double as lower from chg order by date desc limit 60)""" + _FUTURE)
oracle("forecast_export", ENROL, SER, PROJ, """
select date as "Date", try_cast(trunc(p) as bigint) as "Predicted (N)",
       try_cast(trunc(p * 1.2::double) as bigint) as "Upper Bound",
       try_cast(trunc(p * 0.8::double) as bigint) as "Lower Bound" from proj""")

# --- anomalies: the same forest, level by level ----------------------------------------------

_MEAN_PATH = """case when {n} <= 1 then 0::double when {n} = 2 then 1::double
  else 2 * (ln({n} - 1::double) + 0.5772156649::double) - 2 * ({n} - 1::double) / {n} end"""
FOREST = """size as (select least(256, count(*)) as psi, ceil(log2(greatest(least(256, count(*)), 2))) as lim from share),
samp as (
  select t, x from (
    select t, adult_enrolments::double as x,
           row_number() over (partition by t order by md5(concat_ws('|', '42', t::varchar, state, district)), state, district) as rn
    from share, range(100) r(t)) where rn <= 256),
lv(t, node, x, lo, hi) as (
  select t, '', x, '-infinity'::double, 'infinity'::double from samp
  union all
  select t, node || case when x <= cut then '0' else '1' end, x,
         case when x <= cut then lo else cut end, case when x <= cut then cut else hi end
  from (
    select t, node, x, lo, hi, n, mn, mx,
           mn + ('0x' || substr(md5(concat('42|', t::varchar, '|', node)), 1, 8))::bigint / 4294967296::double * (mx - mn) as cut
    from (select *, count(*) over p as n, min(x) over p as mn, max(x) over p as mx
          from lv window p as (partition by t, node)))
  where length(node) < (select lim from size) and n > 1 and mn < mx),
leaf as (
  select t, node, lo, hi, length(node) + """ + _MEAN_PATH.format(n="count(*)") + """ as len
  from lv group by t, node, lo, hi
  having length(node) >= (select lim from size) or count(*) <= 1 or min(x) = max(x)),
paths as (
  select v.adult_enrolments, sum(l.len) as total
  from (select distinct adult_enrolments from share) v
  join leaf l on v.adult_enrolments > l.lo and v.adult_enrolments <= l.hi group by 1),
scored as (
  select s.*, round(pow(2::double, -(p.total / (100 * (select """ + _MEAN_PATH.format(n="psi") + """ from size)))), 9) as score
  from share s join paths p using (adult_enrolments)),
cut as (select quantile_cont(score, 0.95) as threshold from scored),
flagged as (
  select scored.*, case when score > threshold then -1 else 1 end::int as anomaly, threshold from scored, cut),
risk as (
  select state, district, adult_enrolments, anomaly,
         trunc(adult_enrolments::double / case when m > 0 then m else 1 end * 90 + 10)::int as risk_score
  from flagged, (select max(adult_enrolments) as m from share)
  where anomaly = -1)"""
oracle("anomaly_scores", ENROL, SHARE, FOREST, """
select state, district, adult_enrolments, round(score, 6) as score, anomaly from flagged""")
_BY_PIN = FOREST.replace("state, district", "state, district, pincode").replace(" from share", " from by_pin")
oracle("anomaly_by_pin", ENROL, """by_pin as (
  select state, district, pincode, sum(adult_enrolments)::bigint as adult_enrolments from enrol group by all)""",
       _BY_PIN, """
select state, district, pincode, adult_enrolments, round(score, 6) as score, anomaly from flagged""")
_QUANTILE = """
select '{0}' as measure, {1}::double as share, round(quantile_cont({0}::double, {1}), 6) as value from prices"""
oracle("line_quantiles", "prices as (select l_extendedprice, l_quantity from lineitem)", " union all ".join(
    _QUANTILE.format(c, q) for c in ("l_extendedprice", "l_quantity") for q in (0.01, 0.5, 0.95)))
oracle("anomaly_threshold", ENROL, SHARE, FOREST, """
select round(max(threshold), 6) as threshold, count(*) filter (where anomaly = -1) as flagged,
       count(*) as groups from flagged""")
RISKS = "select * from risk where risk_score > 0"
oracle("risk_table", ENROL, SHARE, FOREST, RISKS)
oracle("risk_export", ENROL, SHARE, FOREST, RISKS)
_RISK_ORDER = " order by risk_score desc, adult_enrolments desc, state, district limit "
oracle("top_risks", ENROL, SHARE, FOREST, RISKS + _RISK_ORDER + "5")
oracle("worst_risk", ENROL, SHARE, FOREST, """
select *, concat('Flagged **', district, '** as highest risk due to statistical variance.') as headline
from risk where risk_score > 0""" + _RISK_ORDER + "1")
_STATUS = "case when issues = 0 then '✅ Healthy' else concat('🚨 ', issues::varchar, ' Issues') end"
oracle("risk_status", ENROL, SHARE, FOREST, f"""
select issues, {_STATUS} as status from (select count(*) as issues from risk where risk_score > 0)""")
KPIS = """kpis as (
  select (select sum(adult_enrolments)::bigint from enrol) as total_enrolments,
         (select sum(bio_stress)::bigint from bio) as total_bio,
         (select count(*) from risk where risk_score > 0) as issues,
         (select case when a > 0 then (b - a) / a * 100 else 0::double end from ends) as growth_pct)"""
oracle("kpi_executive", ENROL, BIO, SHARE, FOREST, SER, PROJ, ENDS, KPIS, f"""
select total_enrolments, total_bio, issues, round(growth_pct, 6) as growth_pct, {_STATUS} as risk_status from kpis""")
oracle("format_kpis", ENROL, BIO, SHARE, FOREST, SER, PROJ, ENDS, KPIS, f"""
select format('{{:,}}', total_enrolments) as total_enrolments, format('{{:,}}', total_bio) as biometric_updates,
       {_STATUS} as risk_monitor, printf('%.1f%%', growth_pct) as growth_projection from kpis""")


# --- map -------------------------------------------------------------------------------------------

def _jitter(text: str) -> str:
    return f"({_HEX.format(t=text, p=1)} % 1000 / 3000::double - 0.15::double)"


def _points(src: str, scale: str) -> str:
    norm = (
        "(v - lo)::double / (hi - lo + 1)::double"
        if scale == "linear"
        else "(ln(1 + v::double) - ln(1 + lo::double)) / (ln(1 + hi::double) - ln(1 + lo::double) + 0.1::double)"
    )
    height = "v * 50::double" if scale == "linear" else "norm * 200000"
    log_v = "" if scale == "linear" else "round(ln(1 + v::double), 6) as log_v, "
    return f"""pts as (
  select s.state, s.district, s.adult_enrolments as v, r.lo, r.hi,
         coalesce(c.lat, 20::double) + {_jitter('s.district')} as lat,
         coalesce(c.lon, 78::double) + {_jitter('reverse(s.district)')} as lon
  from {src} s left join centres c on s.state = c.state,
       (select min(adult_enrolments) as lo, max(adult_enrolments) as hi from {src}) r),
points as (
  select state, district, v as adult_enrolments, round(lat, 6) as lat, round(lon, 6) as lon,
         case when (v - lo)::double / (hi - lo + 1)::double < 0.1 then '[0, 255, 255, 140]'
              when (v - lo)::double / (hi - lo + 1)::double < 0.3 then '[255, 191, 0, 160]'
              else '[255, 0, 50, 200]' end as color,
         {log_v}round(norm, 6) as norm, round({height}, 6) as elevation,
         round(4000 + norm * 20000, 6) as radius
  from (select *, {norm} as norm from pts))"""


DIRTY_SHARE = """share as (
  select state, district, sum(adult_enrolments)::bigint as adult_enrolments from dirty group by state, district)"""
CHOSEN = f"chosen as (select * from share where state in {STATES})"
oracle("geo_linear", ENROL, SHARE, TOP5, CENTRES, _points("top5", "linear"), "select * from points")
oracle("geo_log", DIRTY, DIRTY_SHARE, CENTRES, _points("share", "log"), "select * from points")
oracle("geo_selected_states", ENROL, SHARE, CHOSEN, CENTRES, _points("chosen", "linear"), "select * from points")
oracle("map_export", ENROL, SHARE, TOP5, CENTRES, _points("top5", "log"), "select * from points")
oracle("top_districts", ENROL, SHARE, TOP5, CENTRES, _points("top5", "log"), """
select * from points order by adult_enrolments desc, state, district limit 20""")
oracle("top_states_geo", ENROL, SHARE, TOP5, """
select state, sum(adult_enrolments)::bigint as adult_enrolments from top5 group by state order by 2 desc, 1 limit 10""")
oracle("geo_jitter", DIRTY, f"""
select district, round({_jitter('district')}, 6) as lat_offset, round({_jitter('reverse(district)')}, 6) as lon_offset
from (select distinct district from dirty)""")
oracle("geo_summary", ENROL, f"""
select sum(adult_enrolments)::bigint as visible_volume, count(distinct district) as districts,
       (select district from enrol where state in {STATES} group by district
        order by sum(adult_enrolments) desc, district limit 1) as hotspot
from enrol where state in {STATES}""")
oracle("geo_focus", DIRTY, CENTRES, """
select s.state, coalesce(c.lat, 22::double) as lat, coalesce(c.lon, 79::double) as lon, 6 as zoom
from (select distinct state from dirty) s left join centres c on s.state = c.state""")

# --- governance ----------------------------------------------------------------------------------------

G = (CUST, LOG, STANDING, PATCHES)
oracle("active_patches", *G, "select * from patches")
oracle("active_deletions", *G, "select * from gone")


def _governed(src: str, measure: str) -> str:
    return f"""governed as (
  select f.date, coalesce(ps.target, f.state) as state, coalesce(pd.target, f.district) as district,
         f.pincode, f.{measure}
  from {src} f
  left join patches ps on ps.scope = 'State' and ps.original = f.state
  left join patches pd on pd.scope = 'District' and pd.original = f.district
  where not exists (select 1 from gone g where g.scope = 'State' and g.original = f.state)
    and not exists (select 1 from gone g where g.scope = 'District' and g.original = f.district))"""


oracle("apply_governance", ENROL, LOG, STANDING, PATCHES, _governed("enrol", "adult_enrolments"),
       "select * from governed")
oracle("apply_governance_bio", *G, BIO, _governed("bio", "bio_stress"), "select * from governed")
oracle("apply_governance_demo", *G, DEMO, _governed("demo", "update_volume"), "select * from governed")
oracle("governed_market_share", ENROL, LOG, STANDING, PATCHES, _governed("enrol", "adult_enrolments"), """
select state, district, sum(adult_enrolments)::bigint as adult_enrolments from governed group by state, district""")

oracle("revert", CUST, LOG, STANDING, """
select id, ts, scope, action, original, target, "user" from log
union all
select 'r' || md5(id), timestamp '2024-02-01 08:00:00', scope, 'Revert', original, id, 'Admin_01'
from standing where "user" = 'Admin_03'""")
oracle("revert_filtered", CUST, LOG, STANDING, """
select id, ts, scope, action, original, target, "user" from standing
where not (scope = 'State' and cast(ts as date) between date '2024-01-10' and date '2024-01-20')""")
_DISPLAY = """id, strftime(ts, '%H:%M:%S') as time, concat(scope, ' ', action) as action,
  case when action = 'Merge' then concat(original, ' -> ', target) else concat('Del: ', original) end as change, "user" """
_DAYS = "cast(ts as date) between date '2024-01-05' and date '2024-01-20'"
oracle("audit_view", CUST, LOG, STANDING, f"select {_DISPLAY} from standing where {_DAYS}")
oracle("audit_page", CUST, LOG, STANDING, f"""
select {_DISPLAY} from (select * from standing where {_DAYS} and scope = 'District'
  order by ts desc, id limit 15 offset 15)""")
oracle("audit_page_deep", CUST, LOG, STANDING, f"""
select {_DISPLAY} from (select * from standing order by ts desc, id limit 15 offset 585)""")
oracle("recent_log", CUST, LOG, STANDING, """
select id, ts, scope, action, original, target, "user" from standing order by ts desc, id limit 10""")
oracle("audit_export", CUST, LOG, STANDING, """
select id as "ID", ts as "Timestamp", scope as "Scope", action as "Action", original as "Original",
       target as "Target", "user" as "User" from standing""")
oracle("log_extent", CUST, LOG, 'select min(ts) as "first", max(ts) as "last" from log')


# --- similarity: longest common blocks, found recursively on a table of diagonal runs ----------------------

def _ratio_ctes(name: str, pairs: str) -> str:
    """CTEs giving ``name(a, b, r)`` for the distinct pairs of ``pairs(a, b)``."""
    return f"""{name}_hit as (
  select a, b, i, j from (
    select a, b, i, unnest(range(1, length(b) + 1)) as j from (
      select a, b, unnest(range(1, length(a) + 1)) as i from {pairs}))
  where substr(a, i, 1) = substr(b, j, 1)),
{name}_run as (
  select a, b, i, j, max(i) over (partition by a, b, i - j, g) - i + 1 as len from (
    select *, i - row_number() over (partition by a, b, i - j order by i) as g from {name}_hit)),
{name}_w(a, b, alo, ahi, blo, bhi, k) as (
  select a, b, 1::bigint, length(a)::bigint + 1, 1::bigint, length(b)::bigint + 1, 0::bigint from {pairs}
  union all
  select a, b, case s when 0 then alo else i + k end, case s when 0 then i else ahi end,
         case s when 0 then blo else j + k end, case s when 0 then j else bhi end,
         case s when 0 then k else 0 end
  from (
    select a, b, alo, ahi, blo, bhi, best // 1000000 as k,
           999 - (best // 1000) % 1000 as i, 999 - best % 1000 as j
    from (
      select w.a, w.b, w.alo, w.ahi, w.blo, w.bhi,
             max(least(r.len, w.ahi - r.i, w.bhi - r.j)::bigint * 1000000 + (999 - r.i) * 1000 + 999 - r.j) as best
      from {name}_w w join {name}_run r
        on r.a = w.a and r.b = w.b and r.i >= w.alo and r.i < w.ahi and r.j >= w.blo and r.j < w.bhi
      group by w.a, w.b, w.alo, w.ahi, w.blo, w.bhi)), (values (0), (1)) sides(s)),
{name} as (
  select a, b, 2::double * sum(k)::double / (length(a) + length(b))::double as r
  from {name}_w group by a, b)"""


STATE_ISSUES = """suspects as (
  select state, count(*) as n from dirty where state not in (select nm from off) group by state),
sp as (select off.nm as a, s.state as b from suspects s, off),
""" + _ratio_ctes("sr", "sp") + """,
sbest as (
  select b as state, a as fix from (
    select *, row_number() over (partition by b order by r desc, a desc) as rn from sr where r >= 0.4)
  where rn = 1),
cp as (select distinct lower(state) as a, lower(fix) as b from sbest),
""" + _ratio_ctes("cr", "cp") + """,
issues as (
  select s.state as Suspect, coalesce(m.fix, 'Unknown') as Fix, coalesce(cr.r, 0) as Conf, s.n as Suspect_Vol
  from suspects s left join sbest m using (state)
  left join cr on cr.a = lower(m.state) and cr.b = lower(m.fix))"""

NEAR = """cnt as (select district, count(*) as n from dirty group by district),
""" + PINS + """,
np as (select x.district as a, d.district as b from cnt x, cnt d where x.district <> d.district
       and 2::double * least(length(x.district), length(d.district)) >= 0.85 * (length(x.district) + length(d.district))),
""" + _ratio_ctes("nr", "np") + """,
near as (
  select * from (
    select b as name, a as candidate, r, row_number() over (partition by b order by r desc, a desc) as rk
    from nr where r >= 0.85) where rk <= 4)"""

MEETING = """meeting as (
  select name, candidate,
    exists (select 1 from pins p where p.district = name) as lp,
    exists (select 1 from pins p where p.district = candidate) as rp,
    exists (select 1 from pins p join pins q on p.pincode = q.pincode
            where p.district = name and q.district = candidate) as meet
  from near)"""


def _district_issues(order: str) -> str:
    return NEAR + ",\n" + MEETING + ",\n" + LABELS + f""",
accepted as (
  select n.name, n.candidate, n.r, s.n as sn, c.n as cn, m.meet from near n
  join cnt s on s.district = n.name join cnt c on c.district = n.candidate
  join meeting m on m.name = n.name and m.candidate = n.candidate
  where c.n > s.n and not (m.lp and m.rp and not m.meet)),
picked as (
  select * from (select *, row_number() over (partition by name order by {order}) as rn from accepted) where rn = 1),
dp as (select distinct lower(name) as a, lower(candidate) as b from picked),
""" + _ratio_ctes("dr", "dp") + """,
issues as (
  select p.name as Suspect, p.candidate as Fix, dr.r as Conf, p.sn as Suspect_Vol, p.cn as Target_Vol,
         p.meet as PIN_Overlap, coalesce(ls.pins, '') as Suspect_PINs, coalesce(lf.pins, '') as Fix_PINs
  from picked p join dr on dr.a = lower(p.name) and dr.b = lower(p.candidate)
  left join labels_of ls on ls.district = p.name left join labels_of lf on lf.district = p.candidate)"""


DISTRICT_ISSUES = _district_issues("r, candidate")
LARGEST = _district_issues("cn desc, r desc, candidate desc")
_STATE_COLS = "Suspect, Fix, round(Conf, 6) as Conf, Suspect_Vol"
_DIST_COLS = _STATE_COLS + ", Target_Vol, PIN_Overlap, Suspect_PINs, Fix_PINs"

oracle("state_scan", DIRTY, STATE_ISSUES, f"select {_STATE_COLS} from issues")
oracle("district_scan", DIRTY, DISTRICT_ISSUES, f"select {_DIST_COLS} from issues")
oracle("district_scan_largest", DIRTY, LARGEST, f"select {_DIST_COLS} from issues")
oracle("closest_districts", DIRTY, NEAR, """
select name, candidate, round(r, 6) as ratio, rk::int as rank from near""")
oracle("closest_suppliers", """cnt as (select distinct s_name as district from supplier)""", NEAR[NEAR.index("np as"):], """
select name, candidate, round(r, 6) as ratio, rk::int as rank from near""")
oracle("state_scan_nations", DIRTY, "nations as (select distinct n_name as nm from nation)",
       STATE_ISSUES.replace("from off)", "from nations)").replace("suspects s, off)", "suspects s, nations off)"),
       f"select {_STATE_COLS} from issues")
oracle("pin_overlap", DIRTY, NEAR, MEETING, """
select name as suspect, candidate, lp as left_has_pins, rp as right_has_pins, meet as pins_meet from meeting""")
oracle("pin_overlap_by_bits", DIRTY, NEAR, MEETING, """
select name as suspect, candidate, lp as left_has_pins, rp as right_has_pins, meet as pins_meet,
  (select count(*) from pins p join pins q on p.pincode = q.pincode
   where p.district = name and q.district = candidate)::bigint as shared from meeting""")
oracle("pin_counts", ENROL, """
select district, count(distinct pincode)::bigint as n_pins from enrol where pincode > 0 group by district""")

_OPEN = """open_issues as (
  select * from issues where Suspect not in (select original from standing where scope = '{scope}'))"""
OPEN_STATE = (DIRTY, STATE_ISSUES, DIRTY_LOG, STANDING, _OPEN.format(scope="State"))
OPEN_DIST = (DIRTY, DISTRICT_ISSUES, DIRTY_LOG, STANDING, _OPEN.format(scope="District"))
oracle("pending_issues", *OPEN_STATE, f"select {_STATE_COLS} from open_issues")
oracle("pending_district_issues", *OPEN_DIST, f"select {_DIST_COLS} from open_issues")
oracle("issues_page", *OPEN_STATE, f"""
select {_STATE_COLS} from (select * from open_issues order by open_issues.Conf desc, Suspect limit 10 offset 10)""")
oracle("auto_fix", *OPEN_STATE, """
select 'a' || md5(Suspect) as id, timestamp '2024-02-01 09:00:00' as ts, 'State' as scope, 'Merge' as action,
       Suspect as original, Fix as target, 'Admin_01' as "user" from open_issues where Conf > 0.9""")
oracle("default_actions", DIRTY, STATE_ISSUES, """
select Suspect as suspect, case when Conf > 0.85 then 'Merge' else 'Ignore' end as action,
       case when Conf > 0.85 then case when Fix in (select nm from off) then Fix else 'Andhra Pradesh' end end as target
from issues""")
oracle("default_district_actions", DIRTY, DISTRICT_ISSUES, """
select Suspect as suspect, case when Conf > 0.85 then 'Merge' else 'Ignore' end as action,
       case when Conf > 0.85 then case when Fix in (select district from cnt) then Fix
            else (select min(district) from cnt) end end as target
from issues""")
DECIDED = """decided as (
  select Suspect as suspect, case when Conf > 0.85 then 'Merge' when Suspect_Vol < 100 then 'Delete' else 'Ignore' end as action,
         case when Conf > 0.85 then case when Fix in (select nm from off) then Fix else 'Andhra Pradesh' end end as target
  from issues),
events_new as (
  select 'c' || md5(suspect) as id, timestamp '2024-02-01 10:00:00' as ts, 'State' as scope, action,
         suspect as original, coalesce(target, 'N/A') as target, 'Admin_01' as "user"
  from decided where action <> 'Ignore')"""
oracle("commit_decisions", DIRTY, STATE_ISSUES, DECIDED, "select * from events_new")
oracle("log_append", DIRTY, STATE_ISSUES, DECIDED, DIRTY_LOG, """
select id, ts, scope, action, original, target, "user" from log union all select * from events_new""")
oracle("tallies", DIRTY, STATE_ISSUES, DECIDED, """
select (select count(*) from issues) as issues_found, (select count(*) from issues where Conf > 0.9) as auto_fixable,
       (select count(*) from decided where action <> 'Ignore') as changes_processed""")
