"""Position, photo, card, state, manifest and feed views of the driver's tables.

``VIEWS`` is plain SQL that Spark and DuckDB both run; ``{us(x)}`` stands for
microseconds since the epoch and ``{div}`` for integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.operators.stats import assign_segments

ORIGIN_US = 1_704_067_200_000_000

_POSITION = """
  round(cast(46.95 as double) + cast(t_us as double) * cast(0.0000000000117 as double)
    + cast((event_id * 7919) % 11 - 5 as double) * cast(0.00001 as double)
    + case when event_id % 13 = 0 then cast(0.004 as double) else cast(0 as double) end, 7) as lat,
  round(cast(7.44 as double) + cast(subject_id as double) * cast(0.01 as double)
    + cast((event_id * 104729) % 11 - 5 as double) * cast(0.00001 as double), 7) as lon,
  case when event_id % 7 = 0 then null when event_id % 17 = 0 then cast(900 as double)
       else cast(550 + event_id % 9 as double) end as ele,
  case when event_id % 3 = 0 then null else cast(4 + event_id % 9 as double) end as accuracy,
  case when event_id % 3 = 0 then null when event_id % 19 = 0 then cast(122 as double)
       else cast(12 as double) end as ele_accuracy,
  case when event_id % 3 = 0 then null when event_id % 29 = 0 then cast(20.5 as double)
       else cast(1.3 as double) end as speed"""

_FEED = """
select event_id, user_id as subject_id, user_id * 2 + event_id % 2 as track_id,
       ({us(ts)} - 1704067200000000) {div} 1000 as t_us
from events where event_type <> 'purchase'"""

VIEWS = {
    "fixes": f"""
with g as ({_FEED}),
h as (
  select *, t_us - lag(t_us) over (partition by track_id order by t_us, event_id) as gap from g)
select subject_id, track_id,
  sum(case when gap > 240000000 then 1 else 0 end) over (partition by track_id
      order by t_us, event_id rows between unbounded preceding and current row) as segment_no,
  row_number() over (partition by track_id order by t_us, event_id) as seq,
  t_us, {_POSITION}
from h""",
    "photos": """
select event_id as photo_id, user_id as subject_id,
  ({us(ts)} - 1704067200000000) {div} 1000 as t_us,
  concat('DSCF', lpad(cast(event_id % 10000 as varchar(10)), 4, '0'), '.',
    case event_id % 5 when 0 then 'RAF' when 1 then 'JPG' when 2 then 'MOV' when 3 then 'CR3' else 'jpg' end) as name,
  case when event_id % 10 = 9 then null else ts end as exif_local,
  case event_id % 4 when 0 then 7200 when 1 then -19800 else null end as exif_offset_s,
  {us(ts)} + 3600000000 as created_us,
  {us(ts)} + (event_id % 3) * 3600000000 - 1800000000 as modified_us
from events where event_type = 'purchase'""",
    "card_files": """
select o_orderkey {div} 400 as card_id, o_orderkey as file_id,
  case when o_orderkey % 97 = 0 then concat('COVER', case when o_orderkey % 2 = 0 then 'A' else 'B' end, '.JPG')
       else concat('DSCF', lpad(cast((o_orderkey % 400 + 9800) % 10000 as varchar(10)), 4, '0'),
            case when o_orderkey % 3 = 0 then '.JPG' else '.RAF' end) end as name,
  {us(o_orderdate)} + o_orderkey * 1000000 as local_us
from orders where o_orderpriority <> '5-LOW'""",
    "cameras": """
select c_custkey as camera_id,
  case when c_custkey % 11 = 0 then ' ' else c_mktsegment end as make,
  case when c_custkey % 3 = 0 then concat(c_mktsegment, ' EOS  R', cast(c_nationkey as varchar(10)))
       else concat('X-T', cast(c_nationkey as varchar(10))) end as model,
  case when c_custkey % 4 = 0 then null else c_name end as serial
from customer""",
    "settings": """
select subject_id, device, skey, svalue, changed_us from (
  select user_id as subject_id, event_id % 2 as device, event_type as skey, event_id as svalue,
    {us(ts)} {div} 86400000000 as changed_us,
    row_number() over (partition by user_id, event_id % 2, event_type order by ts desc, event_id desc) as rn
  from events) x where rn = 1""",
    "import_states": """
select camera_id, device, last_file, import_no, at_us from (
  select o_custkey as camera_id, o_orderkey % 2 as device,
    concat('DSCF', lpad(cast((o_orderkey * 7) % 10000 as varchar(10)), 4, '0'), '.RAF') as last_file,
    o_orderkey % 40 as import_no, {us(o_orderdate)} as at_us,
    row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderkey) as rn
  from orders) x where rn = 1""",
    "manifests": """
select 'local' as side, concat('p', cast(p_partkey as varchar(10)), '.gpx') as fname,
  cast(null as bigint) as remote_id, md5(concat(p_name, case when p_partkey % 5 = 0 then 'l' else '' end)) as digest
from part where p_partkey % 3 <> 0
union all
select 'remote', concat('p', cast(p_partkey as varchar(10)), '.gpx'), p_partkey,
  md5(concat(p_name, case when p_partkey % 7 = 0 then 'r' else '' end))
from part where p_partkey % 4 <> 0
union all
select 'index', concat('p', cast(p_partkey as varchar(10)), '.gpx'),
  case when p_partkey % 23 = 0 then p_partkey + 1 else p_partkey end, md5(p_name)
from part where p_partkey % 2 = 0
union all
select 'deleted', concat('p', cast(p_partkey as varchar(10)), '.gpx'), null, null
from part where p_partkey % 31 = 0""",
    "deliveries": """
select user_id as device, (({us(ts)} - 1704067200000000) {div} 1000) {div} 900000000 as run,
  event_id as delivery_id, ({us(ts)} - 1704067200000000) {div} 1000 as now_us,
  case when event_id % 2 = 0 then 'gps' else 'fused' end as provider,
  case when event_id % 11 = 0 then null else cast((event_id % 25) * 10 as double) end as accuracy,
  (event_id % 8) * 20000 as age_ms
from events""",
}


def spark_text(sql: str) -> str:
    return _fill(sql, "unix_micros(cast({} as timestamp))", "div")


def duckdb_text(sql: str) -> str:
    return _fill(sql, "epoch_us({})", "//")


def _fill(sql: str, micros: str, div: str) -> str:
    for column in ("ts", "o_orderdate"):
        sql = sql.replace("{us(" + column + ")}", micros.format(column))
    return sql.replace("{div}", div)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables below ``sf_dir``."""
    if name == "fixes":
        return fixes(spark, sf_dir)
    if name == "import_states":
        return import_states(spark, sf_dir)
    sql = spark_text(VIEWS[name])
    source = next(t for t in ("events", "orders", "customer", "part") if f"from {t}" in sql)
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=table(spark, sf_dir, source))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``fixes`` view, numbered by the segment builder instead of by plain windows."""
    sql = spark_text(_FEED).replace("from events", "from {source}")
    feed = spark.sql(sql, source=table(spark, sf_dir, "events"))
    built = assign_segments(
        feed, ["subject_id", "track_id"], ["t_us", "event_id"], break_after_us=240_000_000
    )
    return built.selectExpr(
        "subject_id", "track_id", "segment_no", "seq", "t_us",
        *[_e.strip() for _e in _split_columns(_POSITION)],
    )


def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each camera and device, as an aggregate that combines before it shuffles."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy(
        F.col("o_custkey").alias("camera_id"), (F.col("o_orderkey") % 2).alias("device")
    ).agg(F.min_by(F.struct("o_orderkey", "o_orderdate"), "o_orderkey").alias("f"))
    return first.select(
        "camera_id", "device",
        F.expr("concat('DSCF', lpad(cast((f.o_orderkey * 7) % 10000 as string), 4, '0'), '.RAF')")
        .alias("last_file"),
        (F.col("f.o_orderkey") % 40).alias("import_no"),
        F.expr("unix_micros(cast(f.o_orderdate as timestamp))").alias("at_us"),
    )


def _split_columns(text: str) -> list[str]:
    """The select items of ``text``, cut at the commas outside parentheses."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(text[start:i])
            start = i + 1
    return [*items, text[start:]]
