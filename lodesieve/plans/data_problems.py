"""The registered queries of the general data problems: snapshots, orphan references, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, orphan_refs, snapshot_diff
from ..session import table

# fixed values: feeds and compared columns of the two list tables
TARGET_FEEDS = ("opensanctions_sanctions", "opensanctions_peps", "opensanctions_crypto")
UN_FEED = "un_consolidated"
TARGET_COLUMNS = ("entity_schema", "name", "aliases", "birth_date", "countries", "addresses", "identifiers", "sanctions")
UN_COLUMNS = ("record_type", "name", "aliases", "un_list_type", "reference_number", "programs", "nationalities", "listed_on", "comments")
# fixed values: names that are lists of objects in the three nested fields
OBJECT_LISTS = ("best_path", "chain", "evidence", "nodes", "edges", "matches", "variants", "sanctions_detail", "listings", "address_detail", "id_documents")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, un = table(spark, sf_dir, "opensanctions_target"), table(spark, sf_dir, "un_entity")
    feeds = {s: (targets, "entity_id", "ingest_run_id", TARGET_COLUMNS) for s in TARGET_FEEDS}
    return snapshot_diff.snapshot_changes(table(spark, sf_dir, "ingest_run"), feeds | {UN_FEED: (un, "un_id", "ingest_run_id", UN_COLUMNS)})


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("source", "ingest_run_id", "change_kind").agg(F.count(F.lit(1)).alias("n_keys"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = [
        orphan_refs.References("graph_edges", table(spark, sf_dir, "graph_edges"), "id", ("from_node_key", "to_node_key"), "created_at"),
        orphan_refs.References("exposure_index", table(spark, sf_dir, "exposure_index"), "node_key", ("source_risk_node",), "computed_at"),
    ]
    return orphan_refs.orphan_references(children, table(spark, sf_dir, "graph_nodes"), "node_key", "created_at", table(spark, sf_dir, "graph_node_deletions"), "node_key")


def p4_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_refs.orphan_report(p4_found(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, column in (("pipeline_verdict", "txn_id", "dossier"), ("opensanctions_target", "id", "raw")):
        df = table(spark, sf_dir, name)
        plan = nested.plan_tables(nested.schema_graph(df, column, column), column, OBJECT_LISTS)
        rows = nested.shred(df, key, column, plan, with_fields=False)
        parts.append(nested.list_items(rows, plan).withColumn("record_table", F.lit(name)))
    paths = nested.shred_typed(table(spark, sf_dir, "exposure_index"), "node_key", "best_path")
    parts.append(paths.withColumn("record_table", F.lit("exposure_index")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("record_table", "record_key", "parent_path", "item_path").distinct()


def p5_schema_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [nested.schema_graph(table(spark, sf_dir, n), c, c).withColumn("record_table", F.lit(n)) for n, c in (("pipeline_verdict", "dossier"), ("opensanctions_target", "raw"))]
    return parts[0].unionByName(parts[1])


def _child(spark: SparkSession, sf_dir: str, name: str, key: str, column: str, relation: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    plan = nested.plan_tables(nested.schema_graph(df, column, column), column, OBJECT_LISTS)
    return nested.child_table(nested.shred(df, key, column, plan), relation, plan).distinct()


def p5_chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _child(spark, sf_dir, "pipeline_verdict", "txn_id", "dossier", "chain")


def p5_sanction_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _child(spark, sf_dir, "opensanctions_target", "id", "raw", "listings")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_change_counts, p4_found, p4_orphan_report, p5_found, p5_schema_graph, p5_chain_steps, p5_sanction_listings)}


def _canonical_sql(columns: tuple[str, ...], lists: tuple[str, ...]) -> str:
    def one(c: str) -> str:
        if c in lists:
            return f"coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform({c}, lambda x: trim(x)), lambda x: length(x) > 0))), chr(31)), '')"
        return f"coalesce(trim({c}), '')"

    return " || chr(30) || ".join(one(c) for c in columns)


_P2 = f"""
with d as (select source, id as run_id, row_number() over (partition by source order by started_at, id) as seq
           from ingest_run where status = 'ok' and source in {(*TARGET_FEEDS, UN_FEED)}),
r as (select distinct d.source, d.seq, x.k, x.c from d join (
        select ingest_run_id as run_id, 'o' as kind, trim(entity_id) as k, {_canonical_sql(TARGET_COLUMNS, ("aliases", "countries", "addresses", "identifiers", "sanctions"))} as c from opensanctions_target
        union all
        select ingest_run_id, 'u', trim(un_id), {_canonical_sql(UN_COLUMNS, ("aliases", "programs", "nationalities"))} from un_entity
      ) x on x.run_id = d.run_id and (x.kind = 'u') = (d.source = '{UN_FEED}') where x.k is not null and x.k <> ''),
s as (select source, seq, k, string_agg(c, chr(29) order by c) as c from r group by all),
p as (select source, seq + 1 as seq, k, c from s)
select d.source, d.run_id as ingest_run_id, y.record_key, y.change_kind from (
  select coalesce(s.source, p.source) as source, coalesce(s.seq, p.seq) as seq, coalesce(s.k, p.k) as record_key,
         case when p.k is null then 'added' when s.k is null then 'removed' when s.c <> p.c then 'changed' end as change_kind
  from s full join p on s.source = p.source and s.seq = p.seq and s.k = p.k) y
join d on d.source = y.source and d.seq = y.seq where d.seq > 1 and change_kind is not null"""

_P4 = """
with refs as (
  select 'graph_edges' as table_name, id as record_key, 'from_node_key' as ref_field, upper(regexp_replace(from_node_key, '\\s+', '', 'g')) as k, created_at as ts from graph_edges
  union all select 'graph_edges', id, 'to_node_key', upper(regexp_replace(to_node_key, '\\s+', '', 'g')), created_at from graph_edges
  union all select 'exposure_index', node_key, 'source_risk_node', upper(regexp_replace(source_risk_node, '\\s+', '', 'g')), computed_at from exposure_index),
n as (select upper(regexp_replace(node_key, '\\s+', '', 'g')) as k, min(created_at) as born from graph_nodes group by 1),
g as (select distinct upper(regexp_replace(node_key, '\\s+', '', 'g')) as k from graph_node_deletions)
select distinct table_name, record_key, ref_field,
  case when n.k is not null then 'late' when g.k is not null then 'deleted' else 'missing' end as orphan_kind,
  strftime(ts at time zone 'UTC', '%Y-%m') as ref_period
from refs left join n on n.k = refs.k left join g on g.k = refs.k
where refs.k is not null and refs.k <> '' and (n.k is null or n.born > refs.ts)"""


# JSON held in a string is read as if it stood there; plain strings stay
_UNQUOTED = """case when json_type({0}) = 'VARCHAR' and json_valid({0} ->> '$') and json_type(({0} ->> '$')::json) in ('OBJECT', 'ARRAY') then ({0} ->> '$')::json
  when json_type({0}) = 'VARCHAR' and json_valid({0} ->> '$') and json_type(({0} ->> '$')::json) = 'VARCHAR' and json_valid((({0} ->> '$')::json) ->> '$')
    and json_type(((({0} ->> '$')::json) ->> '$')::json) in ('OBJECT', 'ARRAY') then ((({0} ->> '$')::json) ->> '$')::json else {0} end"""

# every value below a record: its path, the element that holds it, whether it is an object that counts as a list element,
# whether it stands in a list itself, and the objects above it
_P5_WALK = f"""
with recursive texts as (
  select 'pipeline_verdict' as record_table, txn_id as record_key, 'dossier' as root, case when json_valid(dossier) then dossier::json end as v from pipeline_verdict
  union all select 'opensanctions_target', id::varchar, 'raw', case when json_valid(raw) then raw::json end from opensanctions_target),
walk as (
  select record_table, record_key, root as above, root as element, root as item_path, false as is_item, false as in_list, [] :: struct(p varchar, e varchar, i boolean)[] as ups, v
  from (select * replace ({_UNQUOTED.format("v")} as v) from texts where v is not null)
  union all
  select w.record_table, w.record_key, case when w.is_list then w.above else w.element end, case when w.is_list then w.element else e.key end,
    w.item_path || case when w.is_list then '[' || e.key || ']' when e.key in {OBJECT_LISTS} and json_type(e.x) = 'OBJECT' then '.' || e.key || '[0]' else '.' || e.key end,
    json_type(e.x) = 'OBJECT' and (w.is_list or e.key in {OBJECT_LISTS}), w.is_list,
    case when w.is_list then w.ups else list_append(w.ups, {{'p': w.item_path, 'e': w.element, 'i': w.is_item}}) end, e.x
  from (select *, json_type(v) = 'ARRAY' as is_list from walk where json_type(v) in ('OBJECT', 'ARRAY')) w,
    lateral (select key, {_UNQUOTED.format("value")} as x from json_each(w.v)) e)
"""
_P5 = (
    _P5_WALK
    + """select distinct record_table, record_key, coalesce(list_filter(ups, lambda u: u.i)[-1].p, '') as parent_path, item_path from walk where is_item
union
select distinct 'exposure_index', node_key, '', 'best_path[' || (i - 1) || ']' from (select node_key, best_path, unnest(range(1, len(best_path) + 1)) as i from exposure_index) where best_path[i] is not null"""
)
_P5_GRAPH = (
    _P5_WALK
    + """select record_table, above as parent, element, case when json_type(v) <> 'OBJECT' then 'field' when in_list then 'list' else 'single' end as kind, count(*) as n
from walk where item_path not in ('raw', 'dossier') and json_type(v) <> 'ARRAY' and (json_type(v) = 'OBJECT' or not in_list) group by all"""
)


def _p5_child(table_name: str, element: str, columns: tuple[str, ...]) -> str:
    """Rows of one element; the row above is the nearest list element, root or shared element."""
    return (
        _P5_WALK
        + f""", own as (select list(element) as es from (select element from walk where record_table = '{table_name}' and json_type(v) = 'OBJECT' group by 1 having count(distinct above) > 1 or bool_or(is_item) or bool_or(len(ups) = 0)))
select distinct record_key, item_path, coalesce(list_filter(ups, lambda u: u.i or list_contains(own.es, u.e))[-1].p, '') as parent_path, {", ".join(f"v ->> '{c}' as {c}" for c in columns)}
from walk, own where record_table = '{table_name}' and element = '{element}' and is_item"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5,
        "p5_schema_graph": _P5_GRAPH,
        "p5_chain_steps": _p5_child("pipeline_verdict", "chain", ("amount", "edge_type", "flow", "label", "node_key", "risk", "step", "type", "via")),
        "p5_sanction_listings": _p5_child("opensanctions_target", "listings", ("page", "ref")),
        "p2_found": _P2,
        "p2_change_counts": f"select source, ingest_run_id, change_kind, count(*) as n_keys from ({_P2}) group by all",
        "p4_found": _P4,
        "p4_orphan_report": f"select table_name, ref_field, orphan_kind, ref_period, count(*) as n_orphans from ({_P4}) group by all",
    }
