"""The same queries in SQL, written independently of the Spark operators.

Derived tables are common table expressions over the driver's tables. Where the Spark
operator replaces a join by one aggregation, or a replay by windows, the SQL keeps the
join or the row-by-row replay.
"""

from __future__ import annotations

from headgrid import schema
from headgrid.plans.rule_tables import RULE_TABLES, SOURCES

ORDER_STATES = """
order_states as (
  select o_orderkey, o_custkey, cast(date_trunc('month', o_orderdate) as date) as m,
    'S' || lpad(cast(o_orderkey % (select count(*) from supplier) as varchar), 6, '0') as costcenter_id,
    case o_orderpriority when '1-URGENT' then 'direct' when '2-HIGH' then 'indirect'
      when '3-MEDIUM' then 'overhead' when '4-NOT SPECIFIED' then 'contractor' end as classification_id,
    case when o_orderstatus = 'P' then null else 'EG_' || o_orderstatus end as employee_group_id
  from orders)"""

COSTCENTERS = """
costcenters as (
  select 'R' || lpad(cast(r_regionkey as varchar), 2, '0') as id, 'DIV-' || cast(r_regionkey as varchar) as code,
    r_name as name, 1 as level, cast(null as varchar) as parent_id, true as is_active from region
  union all
  select 'N' || lpad(cast(n_nationkey as varchar), 3, '0'), 'DEP-' || cast(n_nationkey as varchar),
    n_name, 2, 'R' || lpad(cast(n_regionkey as varchar), 2, '0'), n_nationkey % 11 <> 10 from nation
  union all
  select 'S' || lpad(cast(s_suppkey as varchar), 6, '0'), 'CC-' || cast(s_suppkey as varchar),
    s_name, 3, 'N' || lpad(cast(s_nationkey as varchar), 3, '0'), s_suppkey % 17 <> 0 from supplier)"""

ACTUALS = (
    ORDER_STATES
    + """,
employee_actuals as (
  select 'A' || lpad(cast(o_orderkey as varchar), 9, '0') as id, 'RUN-' || substr(cast(m as varchar), 1, 7) as import_run_id,
    'C' || lpad(cast(o_custkey as varchar), 8, '0') as employee_id, costcenter_id, classification_id, employee_group_id,
    cast((o_orderkey % 8 + 1) * 0.125 as decimal(6,4)) as fte, m as period_start
  from (select s.*, row_number() over (partition by o_custkey, m order by o_orderkey desc) as rn from order_states s) x
  where rn = 1),
import_runs as (
  select import_run_id as id, cast(year(period_start) as integer) as period_year, cast(month(period_start) as integer) as period_month,
    case when month(period_start) = 7 then 'failed' else 'completed' end as status, count(*) as row_count
  from employee_actuals group by import_run_id, period_start)"""
)


def _versions(bounds: str) -> str:
    return f"""
forecast_versions as (
  select 'v' || cast(n as varchar) as id, 'FC ' || substr(cast(m as varchar), 1, 7) as label,
    case when n = count(*) over () then 'working' else 'archived' end as status,
    cast(year(m) as integer) as period_year, cast(month(m) as integer) as period_month, 18 as fc_horizon_months,
    case when n > 1 then 'v' || cast(n - 1 as varchar) end as source_version_id
  from (select m, row_number() over (order by m) as n
        from (select distinct cast(date_trunc('month', o_orderdate) as date) as m from orders) d {bounds}) x)"""


VERSIONS = _versions("where m between date '1998-10-01' and date '1999-01-01'")
ALL_VERSIONS = _versions("")

ENTRIES = (
    ORDER_STATES
    + """,
forecast_entries as (
  select 'v' || cast(v as varchar) || '-' || cast(o_orderkey as varchar) as id, 'v' || cast(v as varchar) as version_id,
    case when o_custkey % 10 <> 0 then 'C' || lpad(cast(o_custkey as varchar), 8, '0') end as employee_id,
    case when o_custkey % 10 = 0 then 'P' || lpad(cast(o_custkey as varchar), 8, '0') end as container_id,
    costcenter_id, classification_id, employee_group_id,
    cast(case when o_custkey % 10 = 0 then (o_orderkey % 25 - 8) * 0.25 else (o_orderkey % 8 + 1) * 0.125 end as decimal(6,4)) as fte,
    m as valid_from, nx as valid_to, (nx is null and o_orderkey % 13 = 0) as is_deleted
  from (select y.*, lead(m) over (partition by v, o_custkey order by m) as nx
        from (select k.v, s.*, row_number() over (partition by k.v, o_custkey, m order by o_orderkey desc) as rn
              from order_states s cross join (select unnest([1, 2, 3, 4]) as v) k where o_orderkey % 5 <> k.v) y
        where rn = 1) z)"""
)

ACTIVE = "valid_from <= date '{month}' and (valid_to is null or valid_to > date '{month}') and not is_deleted"
AT = ACTIVE.format(month="1998-10-01")

FEED = """
feed as (
  select user_id, event_id, event_type, ts, event_type = 'error' as del,
    cast(date '2024-01-01' + to_months(cast(day(ts) - 1 as integer)) as date) as m,
    row_number() over (partition by user_id order by event_id) as rn
  from events),
replay as (
  select user_id, event_id, event_type, ts, del, m, rn, not del as accepted, case when not del then m end as open_from
  from feed where rn = 1
  union all
  select f.user_id, f.event_id, f.event_type, f.ts, f.del, f.m, f.rn,
    not f.del and (r.open_from is null or f.m > r.open_from),
    case when f.del then null when r.open_from is null or f.m > r.open_from then f.m else r.open_from end
  from feed f join replay r on f.user_id = r.user_id and f.rn = r.rn + 1),
steps as (
  select *, lead(del) over w as next_del, lead(m) over w as next_m, lead(event_type) over w as next_type, lead(ts) over w as next_ts
  from replay where accepted or del window w as (partition by user_id order by event_id)),
feed_rows as (
  select user_id, event_id, event_type, ts, m as valid_from,
    case when not next_del then next_m end as valid_to, coalesce(next_del, false) as is_deleted,
    next_del, next_type, next_ts,
    case when {is_container} then 'container' else 'employee' end as subject_kind,
    case when {is_container} then 'B' else 'U' end || cast(user_id as varchar) as subject_key,
    'CC-' || cast(event_id % 7 as varchar) as costcenter_id,
    cast((event_id % 8 + 1) * 0.125 as decimal(38,4)) as fte
  from steps where not del)"""
MIXED_FEED = FEED.format(is_container="user_id % 10 = 0")
CONTAINER_FEED = FEED.format(is_container="true")
FEED_COLUMNS = """subject_kind, subject_key, costcenter_id, fte, valid_from, valid_to, is_deleted,
  case when is_deleted then 'by-' || next_type end as deleted_by, 'by-' || event_type as created_by"""
FEED_AUDIT = """
feed_audit as (
  select subject_kind, subject_key, valid_from, ts as created, is_deleted as ends_deleted, costcenter_id, 'INSERT' as action,
    'by-' || event_type as changed_by, ts as changed_at, cast(null as varchar) as field, cast(null as varchar) as old, cast(null as varchar) as new
  from feed_rows
  union all
  select subject_kind, subject_key, valid_from, ts, is_deleted, costcenter_id, 'UPDATE', 'by-' || next_type, next_ts, 'valid_to', null, cast(valid_to as varchar)
  from feed_rows where valid_to is not null
  union all
  select subject_kind, subject_key, valid_from, ts, is_deleted, costcenter_id, 'DELETE', 'by-' || next_type, next_ts, 'is_deleted', 'false', 'true'
  from feed_rows where is_deleted)"""
TIME_TEXT = "strftime(changed_at, '%Y-%m-%d %H:%M:%S.%f')"

GRID = """
months as (select cast(unnest(generate_series(timestamp '{start}', timestamp '{end}', interval 1 month)) as date) as month_start),
rolled as (
  select month_start, costcenter_id, cast(sum(fte) as decimal(38,4)) as total_fte, count(*) as headcount
  from months join forecast_entries on version_id = 'v4' and not is_deleted and valid_from <= month_start
    and (valid_to is null or valid_to > month_start) {extra}
  group by month_start, costcenter_id)"""


def _grid(start="1998-01-01", end="1999-06-01", extra="") -> str:
    return GRID.format(start=start, end=end, extra=extra)


# Regions, nations and suppliers: three levels, joined one by one.
LEVELS = """
live as (select id, code, name, level, parent_id from costcenters where is_active),
family as (
  select r.id as region, r.name as region_name, n.id as nation, n.name as nation_name, s.id as supplier, s.name as supplier_name
  from live r left join live n on n.parent_id = r.id left join live s on s.parent_id = n.id
  where r.parent_id is null)"""
TREE = LEVELS + """,
placed as (
  select distinct region as id, [region] as path_ids, [region_name] as path_names from family
  union all
  select distinct nation, [region, nation], [region_name, nation_name] from family where nation is not null
  union all
  select supplier, [region, nation, supplier], [region_name, nation_name, supplier_name] from family where supplier is not null),
tree as (select live.*, path_ids, path_names, len(path_ids) - 1 as depth from placed join live using (id))"""
BELOW = """
live as (select id, code, name, level, parent_id from costcenters where is_active),
steps as (select p.id as upper_id, c.id as lower_id from live p join live c on c.parent_id = p.id),
reach as (
  select id as root_id, id from live
  union all
  select upper_id, lower_id from steps
  union all
  select a.upper_id, b.lower_id from steps a join steps b on b.upper_id = a.lower_id),
below as (select root_id, live.* from reach join live using (id))"""


def _with(*parts: str) -> str:
    return "with recursive" + ",".join(parts) + "\n"


def _totals(name: str, where: str, source: str = "forecast_entries", key: str = "costcenter_id") -> str:
    return f"""
{name} as (select {key}, cast(sum(fte) as decimal(38,4)) as fte, count(*) as heads from {source} where {where} group by {key})"""


def _delta(new: str, old: str) -> str:
    return f"cast(coalesce({new}, 0) - coalesce({old}, 0) as decimal(38,4))"


def _snapshot(version: str) -> str:
    return f"(select *, coalesce(employee_id, container_id) as subject_key from forecast_entries where version_id = '{version}' and {AT})"


ENTRY_COLUMNS = """id, version_id, employee_id, container_id, costcenter_id, classification_id, employee_group_id,
  cast(fte as decimal(38,4)) as fte, valid_from, valid_to, is_deleted"""

ORACLE: dict[str, str] = {}

ORACLE["asof_snapshot"] = _with(ENTRIES) + f"select {ENTRY_COLUMNS} from forecast_entries where version_id = 'v4' and {AT}"
ORACLE["asof_employee"] = _with(ENTRIES) + f"""select version_id, employee_id, id, container_id, costcenter_id, classification_id, employee_group_id,
  cast(fte as decimal(38,4)) as fte, valid_from, valid_to, is_deleted
from forecast_entries where version_id = 'v4' and employee_id is not null and {AT}
qualify row_number() over (partition by employee_id order by valid_from, id) = 1"""
ORACLE["asof_container"] = _with(ENTRIES) + f"""select version_id, container_id, id, employee_id, costcenter_id, classification_id, employee_group_id,
  cast(fte as decimal(38,4)) as fte, valid_from, valid_to, is_deleted
from forecast_entries where version_id = 'v4' and container_id is not null and {AT}
qualify row_number() over (partition by container_id order by valid_from, id) = 1"""
ORACLE["open_rows"] = _with(ENTRIES) + f"select {ENTRY_COLUMNS} from forecast_entries where valid_to is null and not is_deleted"
ORACLE["month_spine"] = """select o_custkey, cast(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as date) as month_start
from orders group by o_custkey"""
ORACLE["next_period"] = _with(ACTUALS) + """select id, period_year, period_month,
  cast(case when period_month = 12 then period_year + 1 else period_year end as integer) as next_year,
  cast(case when period_month = 12 then 1 else period_month + 1 end as integer) as next_month from import_runs"""

ORACLE["monthly_rollup"] = _with(ENTRIES, _grid()) + "select * from rolled order by month_start, costcenter_id"
ORACLE["monthly_rollup_positive"] = _with(ENTRIES, _grid(extra="and fte > 0 and employee_id is not null")) + "select * from rolled"
ORACLE["monthly_rollup_horizon"] = _with(ENTRIES, _grid("1999-01-01", "2000-06-01")) + "select * from rolled"
ORACLE["actuals_rollup"] = _with(ACTUALS) + """select import_run_id, costcenter_id, cast(sum(fte) as decimal(38,4)) as total_fte, count(*) as headcount
from employee_actuals group by import_run_id, costcenter_id"""
ORACLE["rollup_grid"] = _with(ENTRIES, _grid()) + "select costcenter_id" + "".join(
    f""",
  cast(sum(total_fte) filter (where month_start = date '{y}-{m:02d}-01') as decimal(38,4)) as fte_{y}_{m:02d},
  cast(sum(headcount) filter (where month_start = date '{y}-{m:02d}-01') as bigint) as heads_{y}_{m:02d}"""
    for y, m in [(1998 + i // 12, i % 12 + 1) for i in range(18)]
) + "\nfrom rolled group by costcenter_id"
ORACLE["hierarchy_rollup"] = _with(ENTRIES, COSTCENTERS, TREE) + f"""select a.id as costcenter_id, cast(sum(e.fte) as decimal(38,4)) as total_fte, count(*) as headcount
from forecast_entries e join tree t on t.id = e.costcenter_id join tree a on list_contains(t.path_ids, a.id)
where e.version_id = 'v4' and {AT.replace('valid_', 'e.valid_').replace('is_deleted', 'e.is_deleted')} group by a.id"""
ORACLE["subtree_rollup"] = _with(ENTRIES, _grid(), COSTCENTERS, BELOW) + """select b.root_id, r.month_start, r.costcenter_id, r.total_fte, r.headcount
from rolled r join below b on b.id = r.costcenter_id join costcenters c on c.id = b.root_id where c.level < 3"""

ORACLE["diff_versions_by_cc"] = _with(
    ENTRIES,
    _totals("older", f"version_id = 'v3' and {AT}"),
    _totals("newer", f"version_id = 'v4' and {AT}"),
    """
held as (select costcenter_id from older union select costcenter_id from newer)""",
) + f"""select held.costcenter_id, older.fte as fte_version_a, newer.fte as fte_version_b, {_delta('newer.fte', 'older.fte')} as fte_delta
from held left join older using (costcenter_id) left join newer using (costcenter_id) where newer.fte is distinct from older.fte"""
ORACLE["diff_versions_by_subject"] = _with(ENTRIES) + f"""select coalesce(a.subject_key, b.subject_key) as subject_key, coalesce(a.employee_id, b.employee_id) as employee_id,
  coalesce(a.container_id, b.container_id) as container_id,
  a.costcenter_id as costcenter_id_a, b.costcenter_id as costcenter_id_b,
  a.classification_id as classification_id_a, b.classification_id as classification_id_b,
  a.employee_group_id as employee_group_id_a, b.employee_group_id as employee_group_id_b,
  cast(a.fte as decimal(38,4)) as fte_a, cast(b.fte as decimal(38,4)) as fte_b, {_delta('b.fte', 'a.fte')} as fte_delta,
  cast(case when a.id is null then 0 else 1 end as bigint) as rows_a, cast(case when b.id is null then 0 else 1 end as bigint) as rows_b
from {_snapshot('v3')} a full outer join {_snapshot('v4')} b on a.subject_key = b.subject_key
where a.costcenter_id is distinct from b.costcenter_id or a.classification_id is distinct from b.classification_id
  or a.employee_group_id is distinct from b.employee_group_id or a.fte is distinct from b.fte"""
ORACLE["diff_versions_overlapping"] = _with(ENTRIES) + f""", merged as (
  select version_id, case when employee_id is null then 'container' else 'employee' end as kind,
    coalesce('M' || cast(cast(substr(employee_id, 2) as bigint) // 30 as varchar), container_id) as subject_key,
    costcenter_id, classification_id, employee_group_id, cast(fte as decimal(38,4)) as fte
  from forecast_entries where {AT}),
only_a as (select * exclude (version_id) from merged where version_id = 'v3' except all select * exclude (version_id) from merged where version_id = 'v4'),
only_b as (select * exclude (version_id) from merged where version_id = 'v4' except all select * exclude (version_id) from merged where version_id = 'v3'),
sides as (
  select *, (select count(*) from only_a a where a.kind = s.kind and a.subject_key = s.subject_key) as all_a,
    (select count(*) from only_b b where b.kind = s.kind and b.subject_key = s.subject_key) as all_b
  from (select distinct kind, subject_key from only_a union select distinct kind, subject_key from only_b) s),
found as (
  select s.kind, s.subject_key, a.costcenter_id as costcenter_id_a, b.costcenter_id as costcenter_id_b,
    a.classification_id as classification_id_a, b.classification_id as classification_id_b,
    a.employee_group_id as employee_group_id_a, b.employee_group_id as employee_group_id_b, a.fte as fte_a, b.fte as fte_b,
    s.all_a as rows_a, s.all_b as rows_b
  from sides s left join only_a a on a.kind = s.kind and a.subject_key = s.subject_key
    left join only_b b on b.kind = s.kind and b.subject_key = s.subject_key where s.all_a <= 1 and s.all_b <= 1
  union all
  select s.kind, s.subject_key, costcenter_id, null, classification_id, null, employee_group_id, null, fte, null, count(*), 0
  from sides s join only_a a on a.kind = s.kind and a.subject_key = s.subject_key where s.all_a > 1 or s.all_b > 1
  group by s.kind, s.subject_key, costcenter_id, classification_id, employee_group_id, fte
  union all
  select s.kind, s.subject_key, null, costcenter_id, null, classification_id, null, employee_group_id, null, fte, 0, count(*)
  from sides s join only_b b on b.kind = s.kind and b.subject_key = s.subject_key where s.all_a > 1 or s.all_b > 1
  group by s.kind, s.subject_key, costcenter_id, classification_id, employee_group_id, fte)
select subject_key, case when kind = 'employee' then subject_key end as employee_id, case when kind = 'container' then subject_key end as container_id,
  * exclude (kind, subject_key), cast(coalesce(fte_b, 0) * rows_b - coalesce(fte_a, 0) * rows_a as decimal(38,4)) as fte_delta from found""".replace("\n, merged", ", merged")
ORACLE["actuals_mom_delta"] = _with(
    ACTUALS,
    _totals("p", "import_run_id = 'RUN-1998-09'", "employee_actuals"),
    _totals("c", "import_run_id = 'RUN-1998-10'", "employee_actuals"),
) + f"""select coalesce(c.costcenter_id, p.costcenter_id) as costcenter_id, p.fte as prev_fte, c.fte as curr_fte, {_delta('c.fte', 'p.fte')} as delta_fte
from c full outer join p on c.costcenter_id = p.costcenter_id"""
ORACLE["actual_vs_forecast"] = "with recursive" + ACTUALS + ENTRIES.replace(ORDER_STATES, "") + "," + _totals(
    "a", "import_run_id = 'RUN-1998-10'", "employee_actuals"
) + "," + _totals("f", f"version_id = 'v4' and {AT}") + f"""
select coalesce(a.costcenter_id, f.costcenter_id) as costcenter_id, a.fte as actual_fte, f.fte as forecast_fte,
  coalesce(a.heads, 0) as actual_headcount, coalesce(f.heads, 0) as forecast_headcount, {_delta('f.fte', 'a.fte')} as fte_delta
from a full outer join f on a.costcenter_id = f.costcenter_id"""
ORACLE["chain_diff"] = _with(
    ENTRIES,
    VERSIONS,
    """
ranked as (
  select id, count(*) over (order by period_year desc, period_month desc) as nth, lead(id) over (order by period_year desc, period_month desc) as older
  from forecast_versions where (period_year, period_month) <= (select (period_year, period_month) from forecast_versions where id = 'v4')),
pairs as (select nth as position, older as version_a, id as version_b from ranked where older is not null)""",
    _totals("t", AT, key="version_id, costcenter_id"),
    """
keyed as (select distinct p.position, p.version_a, p.version_b, t.costcenter_id from pairs p join t on t.version_id in (p.version_a, p.version_b))""",
) + f"""select k.position, k.version_a, k.version_b, k.costcenter_id, a.fte as fte_version_a, b.fte as fte_version_b, {_delta('b.fte', 'a.fte')} as fte_delta
from keyed k left join t a on a.version_id = k.version_a and a.costcenter_id = k.costcenter_id
left join t b on b.version_id = k.version_b and b.costcenter_id = k.costcenter_id where a.fte is distinct from b.fte"""

ORACLE["hierarchy_tree"] = _with(COSTCENTERS, TREE) + """select id, code, name, level, parent_id, array_to_string(path_ids, '/') as path_ids,
  array_to_string(path_names, '/') as path_names, cast(depth as bigint) as depth from tree"""
ORACLE["hierarchy_problems"] = """with recursive nodes as (
  select c_custkey as id, c_acctbal > -900 as is_active,
    case when c_custkey % 41 = 0 then -1 when c_custkey % 17 <> 0 then (c_custkey * c_custkey + 1) % (select count(*) from customer) end as parent_id
  from customer),
climb as (
  select id as start_id, id as at_id from nodes where is_active
  union
  select c.start_id, p.id from climb c join nodes n on n.id = c.at_id join nodes p on p.id = n.parent_id where p.is_active),
ends as (
  select c.start_id, case when n.parent_id is null then 'root' when p.id is null then 'missing_parent' when not p.is_active then 'inactive_ancestor' end as reason
  from climb c join nodes n on n.id = c.at_id left join nodes p on p.id = n.parent_id)
select cast(start_id as varchar) as id, coalesce(max(reason), 'cycle') as reason from ends group by start_id having coalesce(max(reason), 'cycle') <> 'root'"""
ORACLE["hierarchy_descendants"] = _with(COSTCENTERS, BELOW) + "select * from below"
ORACLE["version_chain"] = """with recursive turns as (select distinct conv_id, turn from conversations),
chain as (
  select conv_id, max(turn) as start_turn, max(turn) as turn, cast(1 as bigint) as position from turns group by conv_id
  union all
  select t.conv_id, c.start_turn, t.turn, c.position + 1 from turns t join chain c on c.conv_id = t.conv_id and t.turn = c.turn - 1)
select cast(conv_id as varchar) || '-' || cast(start_turn as varchar) as start_id, cast(conv_id as varchar) || '-' || cast(turn as varchar) as id, position from chain"""

ORACLE["lookup_by_id"] = _with(ACTUALS, COSTCENTERS) + "select * from costcenters where id in (select costcenter_id from employee_actuals)"
ORACLE["resolve_codes"] = _with(COSTCENTERS) + """select 'CC-' || cast(o_custkey as varchar) as code, o_orderkey, c.id as costcenter_id
from orders left join costcenters c on c.code = 'CC-' || cast(o_custkey as varchar)"""
ORACLE["run_by_period"] = _with(ACTUALS, VERSIONS) + """select period_year, period_month, id, status, row_count from import_runs r
where exists (select 1 from forecast_versions v where v.period_year = r.period_year and v.period_month = r.period_month)"""
ORACLE["working_version"] = _with(ALL_VERSIONS) + """select id, label, period_year, period_month, fc_horizon_months, source_version_id from forecast_versions where status = 'working' limit 1"""
ORACLE["list_versions"] = _with(ALL_VERSIONS) + """select id, label, status, period_year, period_month, source_version_id from forecast_versions order by period_year desc, period_month desc"""
ORACLE["actuals_history"] = _with(ACTUALS) + """select a.id, a.employee_id, a.costcenter_id, a.classification_id, a.employee_group_id, cast(a.fte as decimal(38,4)) as fte, r.period_year, r.period_month
from employee_actuals a join import_runs r on r.id = a.import_run_id"""
ORACLE["latest_completed_run"] = _with(ACTUALS) + "select * from import_runs where status = 'completed' order by period_year desc, period_month desc limit 1"
ORACLE["list_import_runs"] = _with(ACTUALS) + "select id, period_year, period_month, status, row_count from import_runs order by period_year desc, period_month desc"
ORACLE["list_active_costcenters"] = _with(COSTCENTERS) + "select id, code, name, level, parent_id from costcenters where is_active order by level, code"
ORACLE["list_lookups"] = """select distinct 'ct-' || substr(o_orderpriority, 1, 1) as id, o_orderpriority as code,
  lower(o_orderpriority) as label,
  cast(substr(o_orderpriority, 1, 1) as integer) as sort_order from orders where o_orderpriority <> '5-LOW'"""

ORACLE["scd2_apply"] = _with(MIXED_FEED) + f"select {FEED_COLUMNS} from feed_rows"
ORACLE["scd2_rejects"] = _with(MIXED_FEED) + """select case when user_id % 10 = 0 then 'B' else 'U' end || cast(user_id as varchar) as subject_key, event_id as seq, m as valid_from,
  case when m = open_from then 'same_month' else 'backdated' end as reason from replay where not accepted and not del"""
ORACLE["scd2_apply_container"] = _with(CONTAINER_FEED) + f"select {FEED_COLUMNS} from feed_rows"
ORACLE["scd2_close"] = _with(MIXED_FEED) + f"select {FEED_COLUMNS} from feed_rows where valid_to is not null"
ORACLE["stream_scd2"] = ORACLE["scd2_apply"]
ORACLE["restore"] = _with(MIXED_FEED) + """select subject_kind, subject_key, costcenter_id, fte, valid_from, valid_to, false as is_deleted,
  cast(null as varchar) as deleted_by, 'by-' || event_type as created_by from feed_rows r
where is_deleted and not exists (select 1 from feed_rows o where o.subject_key = r.subject_key and o.valid_to is null and not o.is_deleted)
qualify row_number() over (partition by subject_key order by valid_from desc, ts desc) = 1"""
ORACLE["soft_delete"] = _with(ENTRIES) + """select id, version_id, valid_from, valid_to,
  is_deleted or hit as is_deleted, case when is_deleted then 'planner' when hit then 'auditor' end as deleted_by
from (select *, version_id = 'v4' and valid_to is null and not is_deleted
        and cast(substr(coalesce(employee_id, container_id), 2) as bigint) in (select c_custkey from customer where c_acctbal < 0) as hit
      from forecast_entries) x"""
ORACLE["rollover_seed"] = _with(ENTRIES) + f"""select id as source_entry_id, 'v5' as version_id, employee_id, container_id, costcenter_id, classification_id, employee_group_id,
  cast(fte as decimal(38,4)) as fte, date '1998-02-01' as valid_from, cast(null as date) as valid_to, false as is_deleted
from forecast_entries where version_id = 'v4' and {ACTIVE.format(month='1998-02-01')}"""
ORACLE["rollover_not_copied"] = _with(ENTRIES) + "select id, valid_from, valid_to from forecast_entries where version_id = 'v4' and not is_deleted and valid_from > date '1998-02-01'"
ORACLE["upsert"] = """with latest as (
  select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select 'c-' || cast(c_custkey as varchar) as key, coalesce(o_orderpriority, c_mktsegment) as value, c_name as description,
  'o-' || cast(o_orderkey as varchar) as updated_by, o_orderkey as updated_seq
from customer left join latest on o_custkey = c_custkey
union all
select 's-' || cast(s_suppkey as varchar), s_name || ' again', 'from a supplier', null, s_suppkey + 1000000000 from supplier"""

TRACKED = ["employee_id", "container_id", "costcenter_id", "classification_id", "employee_group_id", "fte", "valid_from", "valid_to", "is_deleted"]
ORACLE["audit_diff"] = _with(ENTRIES) + """, a as (select *, split_part(id, '-', 2) as k from forecast_entries where version_id = 'v3'),
b as (select *, split_part(id, '-', 2) as k from forecast_entries where version_id = 'v4'),
both_sides as (select """.replace("\n, a as", ", a as") + ", ".join(f"a.{c} as old_{c}, b.{c} as new_{c}" for c in TRACKED) + """, b.k,
  case when not a.is_deleted and b.is_deleted then 'DELETE' when a.is_deleted and not b.is_deleted then 'RESTORE' else 'UPDATE' end as action
  from a join b on a.k = b.k)
""" + "\nunion all ".join(
    f"select k as forecast_entry_id, action, '{c}' as field, cast(old_{c} as varchar) as old, cast(new_{c} as varchar) as new from both_sides where old_{c} is distinct from new_{c}"
    for c in TRACKED
) + """
union all select k, 'INSERT', null, null, null from b where k not in (select k from a)
union all select k, 'DELETE', 'deleted_snapshot', concat_ws('|', id, costcenter_id, cast(fte as varchar), cast(valid_from as varchar), cast(is_deleted as varchar)), null
from a where k not in (select k from b)"""
ORACLE["audit_explode"] = _with(MIXED_FEED, FEED_AUDIT) + "select subject_key, valid_from, action, field, old, new from feed_audit where action <> 'INSERT'"
ORACLE["audit_entry_history"] = _with(MIXED_FEED, FEED_AUDIT) + f"""select subject_key, valid_from, action, changed_by, {TIME_TEXT} as changed_at from feed_audit
where ends_deleted"""


def _id(*parts: str) -> str:
    """The text id that ``hashed_id`` makes of parts: each with its length, null as a mark of its own."""
    text = " || ".join(f"coalesce(cast(length({p}) as varchar) || ':' || {p}, '-')" for p in parts)
    return f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


FEED_LOG = f"""
entry_rows as (
  select *, case when subject_kind = 'employee' then subject_key end as employee_id, case when subject_kind = 'container' then subject_key end as container_id
  from feed_rows),
entry_ids as (
  select *, {_id("''", "'feed'", "employee_id", "container_id", "cast(valid_from as varchar)", "cast(event_id as varchar)")} as id from entry_rows),
feed_log as (
  select id as forecast_entry_id, 'INSERT' as action, 'by-' || event_type as changed_by, ts as changed_at, cast(null as varchar) as as_json from entry_ids
  union all
  select id, 'UPDATE', 'by-' || next_type, next_ts, '{{"valid_to":{{"new":"' || cast(valid_to as varchar) || '"}}}}' from entry_ids where valid_to is not null
  union all
  select id, 'DELETE', 'by-' || next_type, next_ts, '{{"is_deleted":{{"old":"false","new":"true"}}}}' from entry_ids where is_deleted)"""
LOG_ID = _id("a.forecast_entry_id", "a.action", "cast(a.changed_at as varchar)", "a.as_json")
ORACLE["audit_version_feed"] = _with(MIXED_FEED, FEED_LOG) + f"""select a.forecast_entry_id, a.action, a.changed_by, r.employee_id, r.container_id, r.costcenter_id,
  {TIME_TEXT} as changed_at
from feed_log a join entry_ids r on r.id = a.forecast_entry_id
order by a.changed_at desc, a.action, {LOG_ID} desc
limit 200"""

STORED_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
ORACLE["stream_stored_changes"] = _with(MIXED_FEED) + f"""select {FEED_COLUMNS}, 'U' || cast(user_id as varchar) as first_name, event_type as last_name,
  cast(null as varchar) as classification_id, cast(null as varchar) as employee_group_id, cast(null as varchar) as job_description,
  case when is_deleted then {STORED_TIME.format(c='next_ts')} end as deleted_at, {STORED_TIME.format(c='ts')} as created_at
from feed_rows"""
ORACLE["stored_changes"] = ORACLE["stream_stored_changes"].replace(" as created_at", " as created_at, cast(1 as bigint) as n_same_id")
ORACLE["stored_changes_audit"] = _with(MIXED_FEED, FEED_AUDIT) + f"""select subject_key, valid_from, {STORED_TIME.format(c='created')} as created_at,
  action, field, old, new, changed_by, {STORED_TIME.format(c='f.changed_at')} as changed_at, cast(1 as bigint) as n_same_id from feed_audit f"""
ORACLE["stored_changes_rejects"] = _with(MIXED_FEED) + """select case when user_id % 10 = 0 then 'B' else 'U' end || cast(user_id as varchar) as subject_key,
  seq, valid_from, reason from (
    select user_id, event_id as seq, m as valid_from, case when m = open_from then 'same_month' else 'backdated' end as reason from replay where not accepted and not del
    union all
    select user_id, event_id, m, 'already_delivered' from feed cross join (select max(event_id) // 4 as q from events) x
    where event_id > q
    union all
    select user_id, event_id, m, 'already_delivered' from feed cross join (select max(event_id) // 4 as q from events) x
    where event_id > q and event_id <= 2 * q) r"""
ORACLE["publish_soft_delete"] = _with(ENTRIES) + """select id as forecast_entry_id, version_id, 'DELETE' as action, 'auditor' as changed_by, cast(1 as bigint) as n_records
from forecast_entries where version_id = 'v4' and valid_to is null and not is_deleted
  and cast(substr(coalesce(employee_id, container_id), 2) as bigint) in (select c_custkey from customer where c_acctbal < 0)"""

ORACLE["dq_unique"] = _with(ACTUALS) + """select 'lineitem_key' as rule, cast(l_orderkey as varchar) || '/' || cast(l_linenumber as varchar) as key, count(*) as n_rows
from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all select 'orders_key', cast(o_orderkey as varchar), count(*) from orders group by o_orderkey having count(*) > 1
union all select 'actuals_run_employee', import_run_id || '/' || employee_id, count(*) from employee_actuals group by import_run_id, employee_id having count(*) > 1
union all select 'runs_period', cast(period_year as varchar) || '/' || cast(period_month as varchar), count(*) from import_runs group by period_year, period_month having count(*) > 1"""
ORACLE["dq_one_working"] = """select 'one_working_version' as rule, 'working' as key, count(*) as n_rows
from (select distinct date_trunc('month', o_orderdate) from orders where o_orderstatus = 'O') x having count(*) > 1"""
ORACLE["dq_checks"] = "with recursive" + ACTUALS + ENTRIES.replace(ORDER_STATES, "") + "," + ALL_VERSIONS + """
select 'delete_fields' as rule, id as key from forecast_entries where is_deleted
union all select 'one_subject', id from forecast_entries where (employee_id is null) = (container_id is null)
union all select 'end_after_start', id from forecast_entries where valid_to <= valid_from
union all select 'start_on_first', id from forecast_entries where day(valid_from) <> 1
union all select 'actual_fte_range', cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) from lineitem where l_quantity * 0.25 > 10 or l_quantity <= 0
union all select 'archive_fields', id from forecast_versions where status = 'archived'
union all select 'year_range', id from forecast_versions where period_year < 2000
union all select 'year_range', id from import_runs where period_year < 2000"""
ORACLE["dq_foreign_keys"] = "with recursive" + ACTUALS + ENTRIES.replace(ORDER_STATES, "") + "," + COSTCENTERS + "," + VERSIONS + """,
employees as (select 'C' || lpad(cast(c_custkey as varchar), 8, '0') as id from customer where c_acctbal >= 0)
select 'entries_costcenter' as rule, costcenter_id as key, count(*) as n_rows from forecast_entries
where costcenter_id not in (select id from costcenters where is_active) group by costcenter_id
union all select 'entries_employee', employee_id, count(*) from forecast_entries where employee_id not in (select id from employees) group by employee_id
union all select 'entries_version', version_id, count(*) from forecast_entries where version_id not in (select id from forecast_versions) group by version_id
union all select 'actuals_employee', employee_id, count(*) from employee_actuals where employee_id not in (select id from employees) group by employee_id"""


def _rules_sql() -> str:
    """One SELECT for each rule: GROUP BY for a key, NOT IN for a reference, WHERE for a row rule."""
    names = {n: n for n in SOURCES}
    tables = ",\n".join(f"{name} as materialized ({text.format(**names)})" for name, text in RULE_TABLES.items())

    def broken(table, rule, key, rest):
        return f"select '{table}' as \"table\", '{rule}' as rule, {key} as key, count(*) as n_rows from {table} {rest}"

    def text(column):
        return f"coalesce(cast({column} as varchar), '-')"

    found = []
    for table in RULE_TABLES:
        own = schema.PRIMARY_KEY[table]
        for unique in [[own], *schema.UNIQUE_KEYS.get(table, [])]:
            columns = ", ".join(unique)
            found.append(broken(table, "unique_" + "_".join(unique), " || '/' || ".join(map(text, unique)), f"group by {columns} having count(*) > 1"))
        conditions = dict(schema.CHECKS.get(table, {}))
        conditions |= {f"{c}_not_null": f"{c} is not null" for c in schema.NOT_NULL[table]}
        conditions |= {f"{c}_length": f"length({c}) <= {n}" for c, n in schema.TEXT_LIMITS.get(table, {}).items()}
        for rule, condition in conditions.items():
            found.append(broken(table, rule, text(own), f"where not ({condition}) group by {own}"))
    for table, column, parent in schema.FOREIGN_KEYS:
        known = f"select {schema.PRIMARY_KEY[parent]} from {parent} where {schema.PRIMARY_KEY[parent]} is not null"
        found.append(broken(table, f"{column}_in_{parent}", f"cast({column} as varchar)", f"where {column} is not null and {column} not in ({known}) group by {column}"))
    found.append(broken("forecast_versions", "one_working_version", "'working'", "where status = 'working' having count(*) > 1"))
    return f"with {tables}\n" + "\nunion all\n".join(found)


ORACLE["dq_rules"] = _rules_sql()
ORACLE["dq_overlap"] = """with spans as (
  select o_orderkey as id, o_custkey, cast(date_trunc('month', o_orderdate) as date) as m, cast(date_trunc('month', o_orderdate) + interval 3 month as date) as until from orders),
starts as (select o_custkey, m, count(*) as n_rows, max(until) as until from spans group by o_custkey, m),
found as (
  select s.*, (select e.m from spans e where e.o_custkey = s.o_custkey and e.m < s.m order by e.until desc, e.m desc limit 1) as over_from,
    (select max(e.until) from spans e where e.o_custkey = s.o_custkey and e.m < s.m) as over_until from starts s)
select 'orders' as version_id, 'employee' as subject_kind, cast(o_custkey as varchar) as subject_key, m as valid_from, n_rows,
  case when over_until > m then over_from else m end as overlaps_from, case when over_until > m then over_until else until end as overlaps_to
from found where over_until > m or n_rows > 1"""
ORACLE["dq_immutable"] = _with(ACTUALS) + """select id, import_run_id, employee_id, costcenter_id, classification_id, employee_group_id, cast(fte as decimal(38,4)) as fte, period_start
from employee_actuals where employee_group_id = 'EG_F'"""

ORACLE["dq_immutable_audit"] = """select cast(event_id as varchar) as id, cast(day(ts) as varchar) as version_id, event_type as action, cast(user_id as varchar) as changed_by
from events where day(ts) <= 8 and (event_id % 50 = 0 or event_id % 70 = 1)"""

ORACLE["read_import_file"] = """select case when o_orderstatus = 'P' then 'quarantined' else 'loaded' end as outcome, cast(o_orderkey as varchar) as order_id,
  cast(case when o_orderstatus <> 'P' then (o_orderkey % 8 + 1) * 0.125 end as decimal(38,4)) as fte from orders"""
ORACLE["read_csv_file"] = """select case when o_orderstatus = 'P'
    then '"' || cast(o_orderkey as varchar) || '","' || o_orderpriority || chr(10) || 'the ""P"", and","C' || cast(o_custkey as varchar) || '","n/a"'
    else '{"employee_id":"C' || cast(o_custkey as varchar) || '","first_name":"' || o_orderpriority || '\\nthe \\"' || o_orderstatus || '\\", and","last_name":"' || cast(o_orderkey as varchar) || '"}' end as content,
  cast(case when o_orderstatus <> 'P' then (o_orderkey % 8 + 1) * 0.125 end as decimal(38,4)) as fte from orders"""
ORACLE["import_actuals"] = _with(ACTUALS) + """select period_year, period_month, case when period_year < 1999 then 'refused' else 'loaded' end as outcome, row_count as n_rows from import_runs"""
ORACLE["import_run_counts"] = _with(ACTUALS) + "select id, period_year, period_month, status, cast(row_count as integer) as row_count from import_runs"
ORACLE["stream_import"] = _with(ACTUALS) + "select period_year + 10 as period_year, period_month, 'completed' as status, cast(row_count as integer) as row_count from import_runs"
ORACLE["stream_import_held"] = _with(ACTUALS) + """select 'loaded' as outcome, employee_id, costcenter_id, classification_id, employee_group_id, cast(fte as decimal(38,4)) as fte,
  cast(year(period_start) + 10 as integer) as period_year, cast(month(period_start) as integer) as period_month
from employee_actuals where year(period_start) < 1999
union all
select 'month_range,year_range', 'C' || lpad(cast(c_custkey as varchar), 8, '0'), null, null, null, null, 1950, 13 from customer where c_custkey % 50 = 0
union all
select 'open ' || cast(row_count as varchar) || ' of ' || cast(row_count + 1 as varchar), null, null, null, null, null, period_year + 10, period_month
from import_runs where period_year >= 1999"""

ORACLE["version_chain_rows"] = _with(ALL_VERSIONS) + """select *, row_number() over (order by period_year desc, period_month desc) as position from forecast_versions"""
ORACLE["run_by_id"] = _with(ACTUALS) + "select * from import_runs r where exists (select 1 from employee_actuals a where a.import_run_id = r.id and a.fte = 1)"
ORACLE["version_by_id"] = _with(ALL_VERSIONS) + """select * from forecast_versions
where make_date(period_year, period_month, 1) + interval 1 month in (select make_date(period_year, period_month, 1) from forecast_versions where period_year in (1995, 1997))"""
ORACLE["config_value"] = """select cast(c_acctbal as decimal(38,4)) as value from customer where c_custkey = 7
union all select null from customer where c_custkey = 7"""
ORACLE["list_employee_groups"] = """select 'EG_' || o_orderstatus as id, 'EG_' || o_orderstatus as code, 'eg_' || lower(o_orderstatus) as label,
  cast(min(o_orderkey) % 100 as integer) as sort_order from orders where o_orderstatus <> 'P' group by o_orderstatus"""
ORACLE["rollover_published"] = _with(ENTRIES, VERSIONS) + f""", copied as (
  select coalesce(employee_id, container_id) as key, costcenter_id, fte from forecast_entries where version_id = 'v4' and {ACTIVE.format(month='1998-02-01')})
select 'version' as part, label as key, 'archived' as what, cast(period_year * 100 + period_month as varchar) as month, source_version_id as parent,
  case when status = 'working' then 'planner' end as who, cast(null as decimal(38,4)) as fte from forecast_versions
union all select 'version', 'FC 1998-02', 'working', '199802', 'v4', 'planner', null
union all select 'entry', key, costcenter_id, '1998-02-01', null, 'planner', cast(fte as decimal(38,4)) from copied
union all select 'audit', key, 'INSERT', null, null, 'planner', null from copied""".replace("\n, copied", ", copied")
ORACLE["first_version"] = _with(VERSIONS) + """select 'made' as "case", label, status, period_year, period_month, fc_horizon_months, source_version_id, cast(null as varchar) as created_by
from forecast_versions where status = 'archived'
union all select 'made', 'first', 'working', 1999, 2, 12, null, 'planner'
union all select 'kept', label, status, period_year, period_month, fc_horizon_months, source_version_id, null from forecast_versions"""
