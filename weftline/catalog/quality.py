"""Queries on data quality and skew: dangling references, unreadable rows, per-key totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog.registry import query, read
from weftline.operators.dense_counts import busy_keys, dense_totals, rows_with_keys
from weftline.operators.orphans import orphan_references, orphan_report
from weftline.operators.strict_load import rejected_records, strict_load

# ---- references to records that do not exist

_ORPHANS = """with life as (
  select id, arrived_at, max_by(deleted_at, loaded_at) as deleted_at from karate_nodes where id is not null and arrived_at is not null group by all),
node as (select id, min(arrived_at) as first_at from life group by all),
once as (select distinct edge_id, src, dst, seen_at from karate_edges),
ref as (select edge_id, 'src' as endpoint, src as id, seen_at from once where src is not null
        union all select edge_id, 'dst', dst, seen_at from once where dst is not null),
orphan as (
  select edge_id, endpoint, seen_at,
    case when n.id is null then 'missing' when n.first_at > seen_at then 'late' else 'deleted' end as cause
  from ref left join node n using (id)
  where not exists (select 1 from life l where l.id = ref.id and l.arrived_at <= seen_at and (l.deleted_at is null or seen_at < l.deleted_at)))"""


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(
        read(spark, sf, "karate_edges"), ["src", "dst"], read(spark, sf, "karate_nodes"),
        record_id="edge_id", seen_at="seen_at", key="id", begins_at="arrived_at", ends_at="deleted_at", version="loaded_at",
    )


@query(f"{_ORPHANS} select edge_id, endpoint, strftime(seen_at, '%Y-%m') as month_seen, cause from orphan")
def p2_found(spark, sf):
    month = F.substring(F.col("seen_at").cast("string"), 1, 7)
    return _orphans(spark, sf).select("edge_id", "endpoint", month.alias("month_seen"), "cause")


@query(
    f"""{_ORPHANS} select 'karate_edges' as table_name, endpoint, strftime(seen_at, '%Y-%m') as month_seen, cause,
      count(*)::bigint as n_orphans from orphan group by all"""
)
def p2_report(spark, sf):
    return orphan_report(_orphans(spark, sf), table="karate_edges", seen_at="seen_at")


# ---- rows that fail to parse

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_RAW = f"""with body as (
  select line_id, raw_line, regexp_replace(coalesce(raw_line, ''), '(?:\\r\\n|\\n|\\r)\\z', '') as body from lesmis_raw),
told as (select *, regexp_matches(body, '^(?:{_FIELD})(?:,{_FIELD})*\\z', 's') as quoted,
  regexp_matches(body, '\\A{_FIELD},{_FIELD},{_FIELD}\\z', 's') as three,
  regexp_extract(body, '\\A({_FIELD}),({_FIELD}),({_FIELD})\\z', ['a', 'b', 'c'], 's') as f from body),
field as (select *, list_transform([f.a, f.b, f.c],
  lambda x: trim(case when x[1] = '"' then replace(x[2:len(x) - 1], '""', '"') else x end, ' ' || chr(9))) as v from told),
judged as (select *, v[1] <> '' and v[2] <> '' and regexp_full_match(v[3], '[0-9]+')
  and len(ltrim(v[3], '0')) <= 10 and coalesce(try_cast(v[3] as hugeint), 0) <= 2147483647 as valued from field)"""


def _raw(spark, sf):
    return read(spark, sf, "lesmis_raw")


@query(f"{_RAW} select line_id, case when not quoted then 'quoting' when not three then 'columns' else 'value' end as reason from judged where not (quoted and three and valued)")
def p3_found(spark, sf):
    return rejected_records(_raw(spark, sf), offset="line_id", line="raw_line").select("line_id", "reason")


@query(f"{_RAW} select line_id, v[1] as src, v[2] as dst, v[3]::int as weight from judged where quoted and three and valued")
def p3_loaded(spark, sf):
    return strict_load(_raw(spark, sf), offset="line_id", line="raw_line")


# ---- a few keys holding most records


def _totals(spark, sf):
    return dense_totals(read(spark, sf, "lesmis_edges"), ["src", "dst"], "weight")


_TOTALS = """with total as (
  select 'src' as endpoint, src as node_name, count(*)::bigint as n_rows, sum(weight)::bigint as total_weight from lesmis_edges where src is not null group by all
  union all select 'dst', dst, count(*)::bigint, sum(weight)::bigint from lesmis_edges where dst is not null group by all)"""


@query(f"{_TOTALS} select endpoint, node_name from total qualify n_rows >= 0.02 * sum(n_rows) over (partition by endpoint)")
def p5_found(spark, sf):
    per_column = rows_with_keys(read(spark, sf, "lesmis_edges"), ["src", "dst"])
    return busy_keys(_totals(spark, sf), 0.02, per_column).select("endpoint", "node_name")


@query(f"{_TOTALS} select * from total")
def p5_totals(spark, sf):
    return _totals(spark, sf)
