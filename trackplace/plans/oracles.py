"""The registered queries in plain SQL for DuckDB, written from the rules and not
from the operators: windows over whole keys, theta joins, correlated scans."""

from __future__ import annotations

from trackplace.plans.fixtures import VIEWS, duckdb_text

SEG = "partition by track_id, segment_no order by t_us, seq"
MS = 60_000_000


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _view(name: str) -> str:
    sql = duckdb_text(VIEWS[name])
    if name == "fixes":
        # Sums come out wider than the column is.
        sql = f"select * replace (cast(segment_no as bigint) as segment_no) from ({sql})"
    return f"{name} as ({sql})"


def _dated(name: str) -> str:
    """The same with real dates, but for some recordings."""
    real = "t_us + 1704067200000000"
    if name == "fixes":
        real = f"case when track_id % 10 = 3 then t_us else {real} end"
    inner = _view(name).split(" as (", 1)[1][:-1]
    return f"{name} as (select * replace ({real} as t_us) from ({inner}))"


def _distance(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    h = (
        f"(pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2)"
        f" + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2))"
    )
    return f"2 * 6371000.0 * asin(case when {h} > 1 then 1.0 else sqrt({h}) end)"


def _speed(from_us: str, to_us: str, metres: str) -> str:
    return f"case when ({to_us} - {from_us}) // 1000 > 0 then {metres} / ((({to_us} - {from_us}) // 1000) / 1000.0) end"


STEPPED = f"""stepped as (
  select *, lag(t_us) over w as p_us, {_distance('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as step_m
  from fixes window w as ({SEG}))"""


def _pass(n: int, source: str) -> list[str]:
    """One cleaning pass over ``source``; ``judged{n}`` has a column ``drop_it``."""
    return [
        f"""a{n} as (select *, lag(t_us) over w as p_us, lag(accuracy) over w as p_acc,
      lead(accuracy) over w as n_acc,
      {_distance('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as out_m,
      {_distance('lag(lat) over w', 'lag(lon) over w', 'lead(lat) over w', 'lead(lon) over w')} as across_m
      from {source} window w as ({SEG}))""",
        f"""b{n} as (select *, {_speed('p_us', 't_us', 'out_m')} as speed_in from a{n})""",
        f"""c{n} as (select *, lead(out_m) over w as back_m, lead(speed_in) over w as speed_out,
      case when p_acc is null and accuracy is null and n_acc is null then 60.0
           else greatest(4.0 * greatest(p_acc, accuracy, n_acc), 15.0) end as floor_m
      from b{n} window w as ({SEG}))""",
        f"""d{n} as (select *, coalesce(speed_in is not null and speed_out is not null and out_m >= floor_m
      and back_m >= floor_m and across_m <= 0.4 * greatest(out_m, back_m), false) as suspect from c{n})""",
        f"""e{n} as (select *, case when speed_in is not null and not suspect
      and not coalesce(lag(suspect) over w, false)
      then {{'v': speed_in, 'f': p_us // 1000, 't': t_us // 1000}} end as st
      from d{n} window w as ({SEG}))""",
        f"""f{n} as (select *, list(st) filter (where st is not null) over (
        {SEG} rows between 10 preceding and 11 following) as sts from e{n})""",
        f"""g{n} as (select *, case when suspect then list_transform(list_filter(coalesce(sts, []),
        lambda s: abs(s.f - t_us // 1000) <= 600000 or abs(s.t - t_us // 1000) <= 600000),
        lambda s: s.v) end as speeds from f{n})""",
        f"""h{n} as (select *, case when len(speeds) = 0 then 0.0 else list_median(speeds) end as ordinary
      from g{n})""",
        f"""i{n} as (select *, case when not suspect then null when len(speeds) = 0 then 1.5
        else ordinary + 5.0 * greatest(1.4826 * list_median(list_transform(speeds,
          lambda v: abs(v - ordinary))), 0.3) end as pace_limit from h{n})""",
        f"""j{n} as (select *, greatest(speed_in, speed_out) as fastest,
      coalesce(suspect and greatest(speed_in, speed_out) >= pace_limit, false) as convict,
      row_number() over ({SEG}) as rn from i{n})""",
        f"""k{n} as (select *, rn - coalesce(max(case when not convict then rn end) over (
        {SEG} rows between unbounded preceding and current row), 0) as place,
      coalesce(lead(convict) over ({SEG}), false) as next_convict from j{n})""",
        f"""judged{n} as (select *, convict and not (place % 2 = 0 and next_convict) as drop_it from k{n})""",
        f"""kept{n} as (select subject_id, track_id, segment_no, seq, t_us, lat, lon, ele, accuracy,
      ele_accuracy, speed from judged{n} where not drop_it)""",
    ]


def _cleaning(source: str = "fixes") -> list[str]:
    return [*_pass(1, source), *_pass(2, "kept1"), *_pass(3, "kept2"), f"""elevated as (
  select *, case when ele is null then null when ele_accuracy > 50 then 'ELEVATION_UNTRUSTED'
    when abs(ele - b) >= 100 and abs(ele - a) >= 100 and abs(a - b) <= 0.4 * greatest(abs(ele - b), abs(ele - a))
    then 'ELEVATION_EXCURSION' end as ele_finding
  from (select *, lag(ele) over w as b, lead(ele) over w as a from kept3 window w as ({SEG})))""",
        """cleaned as (select * replace (case when ele_finding is null then ele end as ele) from elevated)"""]


def _excursions(passes: int) -> str:
    picked = "\nunion all\n".join(
        f"select track_id, segment_no, seq, cast({n} as bigint) as drop_pass, round(out_m, 3) as out_m,"
        " round(back_m, 3) as back_m, round(across_m, 3) as across_m, round(fastest, 3) as fastest,"
        f" round(ordinary, 3) as ordinary from judged{n} where drop_it"
        for n in range(1, passes + 1)
    )
    chain = _pass(1, "fixes") if passes == 1 else [*_pass(1, "fixes"), *_pass(2, "kept1"), *_pass(3, "kept2")]
    return _with(_view("fixes"), *chain) + picked


CONTRADICTED = f"""contradicted as (
  select * from (select *, {_speed('p_us', 't_us', 'step_m')} as step_mps from stepped)
  where abs(speed - step_mps) > 5.0)"""

COUNTS = """counts as (
  select t.track_id,
    (select count(*) from judged1 j where j.track_id = t.track_id and drop_it)
    + (select count(*) from judged2 j where j.track_id = t.track_id and drop_it)
    + (select count(*) from judged3 j where j.track_id = t.track_id and drop_it) as position_excursions,
    (select count(*) from elevated e where e.track_id = t.track_id and ele_finding = 'ELEVATION_EXCURSION')
      as elevation_excursions,
    (select count(*) from elevated e where e.track_id = t.track_id and ele_finding = 'ELEVATION_UNTRUSTED')
      as elevations_untrusted,
    (select count(*) from contradicted c where c.track_id = t.track_id) as speed_contradictions
  from (select distinct track_id from fixes) t)"""

COUNTED = [*_cleaning(), STEPPED, CONTRADICTED, COUNTS]


# --- placement ---------------------------------------------------------------


def _locate(points: str, shots: str = "photos", tolerance_us: int | str = MS) -> list[str]:
    return [
        f"""pairs as (select subject_id, track_id, segment_no, t_us as b_us, lat as b_lat, lon as b_lon, ele as b_ele,
    lag(t_us) over w as a_us, lag(lat) over w as a_lat, lag(lon) over w as a_lon, lag(ele) over w as a_ele
    from {points} window w as ({SEG}))""",
        f"""inside as (select s.photo_id, p.* , row_number() over (partition by s.photo_id
      order by b_us - a_us, track_id, segment_no) as nth
    from {shots} s join pairs p on p.subject_id = s.subject_id and p.a_us < s.t_us and s.t_us <= p.b_us)""",
        f"""firsts as (select *, row_number() over ({SEG}) as up,
      row_number() over (partition by track_id, segment_no order by t_us desc, seq desc) as down
    from {points})""",
        f"""ends as (select s.photo_id, f.*, row_number() over (partition by s.photo_id
      order by abs(f.t_us - s.t_us), track_id, segment_no, up) as nth
    from {shots} s join firsts f on f.subject_id = s.subject_id and (up = 1 or down = 1)
    where abs(f.t_us - s.t_us) <= {tolerance_us})""",
        f"""placed as (select s.photo_id, s.subject_id, s.name, s.t_us,
      case when i.photo_id is not null then 'interior' when e.photo_id is not null then 'end' end as placed,
      coalesce(i.track_id, e.track_id) as track_id, coalesce(i.segment_no, e.segment_no) as segment_no,
      case when i.photo_id is null then e.t_us when b_us - a_us < 1000 then a_us else s.t_us end as fix_us,
      case when i.photo_id is null then e.lat else a_lat + (b_lat - a_lat) * f end as lat,
      case when i.photo_id is null then e.lon else a_lon + (b_lon - a_lon) * f end as lon,
      case when i.photo_id is null then e.ele when b_us - a_us < 1000 then a_ele
           when a_ele is not null and b_ele is not null then a_ele + (b_ele - a_ele) * f
           else coalesce(a_ele, b_ele) end as ele,
      case when i.photo_id is not null then {_distance('a_lat', 'a_lon', 'b_lat', 'b_lon')} end as gap_m
    from {shots} s
    left join (select i.*, case when (b_us - a_us) // 1000 = 0 then 0.0
        else cast((s.t_us - a_us) // 1000 as double) / ((b_us - a_us) // 1000) end as f
      from inside i join {shots} s using (photo_id) where nth = 1) i on i.photo_id = s.photo_id
    left join ends e on e.photo_id = s.photo_id and e.nth = 1)""",
    ]


PLACED_COLUMNS = """round(lat, 7) as lat, round(lon, 7) as lon, round(ele, 3) as ele, round(gap_m, 3) as gap_m"""
TYPE = "lower(regexp_extract(name, '\\.([^.]*)$', 1))"
WRITER = f"case when placed is null then null when {TYPE} = 'cr3' then 'exiftool' else 'built-in' end"
LATE = "late as (select * replace (t_us + (subject_id % 2) * 7200000000 as t_us) from photos)"


def _ranges(shots: str) -> str:
    return f"ranges as (select subject_id, min(t_us) as first_us, max(t_us) as last_us from {shots} group by 1)"


BY_SEGMENT = """spans as (select subject_id, track_id * 1000 + segment_no as track_id, min(t_us) as start_us,
  max(t_us) as end_us from fixes group by 1, 2)"""
BY_TRACK = """spans as (select subject_id, track_id, min(t_us) as start_us, max(t_us) as end_us from fixes group by 1, 2)"""
def _choice(reach: str) -> str:
    return f"""choice as (select s.*, r.first_us, r.last_us,
  case when end_us < 631152000000000 then 'undated'
    when end_us >= first_us - {reach} and start_us <= last_us + {reach} then 'used' else 'skipped' end as status
  from spans s left join ranges r using (subject_id))"""


CHOICE = _choice(str(MS))

NEAREST = """nearest as (select subject_id, track_id, away_us from (
  select *, row_number() over (partition by subject_id order by away_us, track_id) as nth from (
    select *, case when end_us < first_us then first_us - end_us when start_us > last_us then start_us - last_us
      else 0 end as away_us,
      count(*) filter (where status = 'used') over (partition by subject_id) as used
    from choice where first_us is not null)
  where used = 0 and status = 'skipped') where nth = 1)"""

USED = "used as (select f.* from fixes f join choice c using (subject_id, track_id) where c.status = 'used')"
PLANNED = [
    _dated("fixes"), _dated("photos"), BY_TRACK, _ranges("photos"), CHOICE, USED,
    *_cleaning("used"), *_locate("cleaned"),
    f"""plan as (select *, {TYPE} as type, {TYPE} <> 'mov' as selected, {WRITER} as writer,
      {TYPE} <> 'mov' and coalesce(gap_m, 0) >= 500 as wide_gap from placed)""",
]
LOCATED = [_view("fixes"), _view("photos"), *_locate("fixes")]


# --- names and cards ---------------------------------------------------------


def _stem(name: str) -> str:
    return f"regexp_replace({name}, '\\.[^.]*$', '')"


def _number(name: str) -> str:
    return f"try_cast(nullif(regexp_extract({_stem(name)}, '(\\d+)\\D*$', 1), '') as integer)"


def _width(name: str) -> str:
    return f"length(regexp_extract({_stem(name)}, '(\\d+)\\D*$', 1))"


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _key(make: str, model: str, serial: str) -> str:
    mk, md, se = _clean(make), _clean(model), _clean(serial)
    rest = (
        f"case when starts_with(lower({md}), lower({mk})) then"
        f" nullif(trim(substr({md}, length({mk}) + 1)), '') else {md} end"
    )
    safe = lambda x: f"nullif(trim(regexp_replace({x}, '[^A-Za-z0-9]+', '-', 'g'), '-'), '')"
    return f"nullif(concat_ws('_', {safe(mk)}, {safe(rest)}, {safe(se)}), '')"


def _label(make: str, model: str, serial: str) -> str:
    mk, md, se = _clean(make), _clean(model), _clean(serial)
    rest = (
        f"case when starts_with(lower({md}), lower({mk})) then"
        f" nullif(trim(substr({md}, length({mk}) + 1)), '') else {md} end"
    )
    return f"concat(concat_ws(' ', {mk}, {rest}), coalesce(' (' || {se} || ')', ''))"


def _later(a: str, b: str) -> str:
    """Whether ``a`` comes after ``b``, by the order of just the two."""
    d = f"({_number(a)} - {_number(b)})"
    m = f"pow(10, greatest({_width(a)}, {_width(b)}))"
    return (
        f"coalesce(case when {d} = 0 then lower({a}) >= lower({b})"
        f" when {d} > 0 then {m} - {d} > {d} else not ({m} + {d} > -{d}) end, false)"
    )


def _ordered(files: str, by: str) -> list[str]:
    return [
        f"""n1 as (select *, {_number('name')} as v, {_width('name')} as w from {files})""",
        f"""n2 as (select *, row_number() over o as pos, v - lag(v) over o as gap,
      count(*) over (partition by {by}) as n from n1 where v is not null
      window o as (partition by {by} order by v, lower(name), file_id))""",
        f"""n3 as (select {by}, arg_max(pos, struct_pack(g := gap, p := -pos)) filter (where gap is not null) as best,
      max(gap) as top, min(v) + least(pow(10, max(w)), 2147483647) - max(v) as around from n2 group by {by})""",
        f"""ordered as (select n2.*, ((pos - case when n < 2 or around > top then 1 else best end + n) % n) + 1 as rank
      from n2 join n3 using ({by}))""",
    ]


NAMED_FILES = """named as (select f.*, make, model, serial from card_files f
  left join cameras c on c.camera_id = case when file_id % 3 = 0 then file_id % 140 end)"""


def _camera_of(by: str) -> str:
    return f"""found as (select * from (
  select *, {_key('make', 'model', 'serial')} as camera_key,
    row_number() over (partition by {by} order by rank desc) as newest from ordered)
  where newest <= 10 and camera_key is not null
  qualify row_number() over (partition by {by} order by {TYPE} not in ('jpg', 'jpeg'), newest) = 1)"""


def _taken_numbers() -> str:
    return """numbered as (select asked.*, row_number() over (partition by name order by created) as k,
    count(*) over (partition by name) as asks from asked),
  free as (select name, n, row_number() over (partition by name order by n) as k from (
    select distinct a.name, unnest(range(2, a.asks + 2 + (select count(*) from taken))) as n
    from (select distinct name, asks from numbered) a)
  where concat(regexp_replace(name, '\\.gpx$', ''), ' (', n, ').gpx') not in (select name from taken))"""


CLASHING = [
    """remote as (select concat('p', p_partkey // 500, '_', p_partkey % 500 % 60, '.gpx') as name, p_partkey as remote_id,
    md5(p_name) as digest, p_partkey as created from part)""",
    """here as (select concat('p', p_partkey // 500, '_', p_partkey % 500, '.gpx') as name, md5(p_name) as digest
    from part where p_partkey % 500 < 60
    union all select concat('p', p_partkey // 500, '_', p_partkey % 500, ' (', p_partkey % 500 % 4 + 2, ').gpx'), md5(p_brand)
    from part where p_partkey % 500 < 60 and p_partkey % 5 = 0)""",
    """synced as (select concat('p', p_partkey // 500, '_', p_partkey % 500, '.gpx') as name, p_partkey + 60 as remote_id,
    md5(concat(p_name, case when p_partkey % 500 % 2 = 0 then 'x' else '' end)) as digest
    from part where p_partkey % 500 < 60 and p_partkey % 3 = 0)""",
]


def _sync(policy: str, skip: str) -> str:
    conflict = "'merge'" if policy == "merge" else "'conflict'"
    forget = "false" if policy == "merge" else "true"
    return _with(
        _view("manifests"),
        "l as (select fname, digest from manifests where side = 'local')",
        "r as (select fname, remote_id, digest from manifests where side = 'remote')",
        "s as (select fname, remote_id, digest from manifests where side = 'index')",
        "d as (select fname from manifests where side = 'deleted')",
        "names as (select distinct fname from manifests)",
        """joined as (select n.fname, l.digest as ld, r.digest as rd, r.remote_id as rid,
      case when r.fname is null or s.remote_id = r.remote_id then s.digest end as last,
      d.fname is not null as gone
    from names n left join l using (fname) left join r using (fname) left join s using (fname)
    left join d using (fname))""",
        f"""cases as (select *, case
      when ld is not null and rid is not null then case
        when ld = rd then case when last = ld and not gone then 'none' else 'record' end
        when gone then 'aside' when ld = last then 'download' when rd = last then 'update' else {conflict} end
      when ld is not null then 'upload'
      when rid is not null then case when gone then 'none' when last is not null and {forget} then 'forget'
        else 'download' end
      else 'prune' end as c from joined where not ({skip}))""",
        """steps as (select unnest([
      ['record', 'record'], ['aside', 'rename_local'], ['aside', 'upload'], ['download', 'download'],
      ['update', 'update'], ['merge', 'merge'], ['conflict', 'rename_local'], ['conflict', 'upload'],
      ['conflict', 'download'], ['upload', 'upload'], ['forget', 'forget'], ['prune', 'prune']]) as p,
      unnest([0, 0, 1, 0, 0, 0, 0, 1, 2, 0, 0, 0]) as no)""",
        """actions as (select cast(0 as bigint) as folder_id, cast(1 as bigint) as phase, fname as name,
      cast(no as bigint) as action_no, p[2] as action,
      case when c in ('aside', 'conflict') and p[2] in ('rename_local', 'upload')
        then replace(fname, '.gpx', ' (2).gpx') end as target,
      case when p[2] in ('record', 'download', 'update', 'merge') then rid end as remote_id,
      case when p[2] = 'record' then ld end as digest
    from cases join steps on p[1] = c)""",
    )


ADMITTED = """heard as (select *, lag(now_us) over (partition by device, run, provider order by now_us, delivery_id) as last
  from deliveries),
usable as (select *, coalesce(accuracy <= 200, false) and not ((last is null or now_us - last > {silence} * 1000)
  and age_ms > 60000) as ok from heard),
written as (select *, max(case when provider = 'gps' and ok then now_us end) over (partition by device, run
  order by now_us, delivery_id rows between unbounded preceding and 1 preceding) as gps_us from usable),
admitted as (select *, case when provider = 'fused' and now_us - gps_us < 90000000 then 'ignored'
  when ok then 'written' else 'dropped' end as outcome from written)"""


def _dms(v: str) -> str:
    e4 = f"cast(floor(abs({v}) * 3600.0 * 10000.0 + 0.5) as bigint)"
    return (
        f"concat({e4} // 36000000, '/1,', ({e4} % 36000000) // 600000, '/1,', {e4} % 600000, '/10000')"
    )


def _half_up(v: str, digits: int) -> str:
    """Rounded by its decimal digits, as a decimal formatter does it."""
    return f"cast(round(cast({v} as decimal(24, 12)), {digits}) as double)"


def _xmp(v: str, pos: str, neg: str) -> str:
    return (
        f"concat(cast(floor(abs({v})) as bigint), ',', printf('%.6f', (abs({v}) - floor(abs({v}))) * 60),"
        f" case when {v} >= 0 then '{pos}' else '{neg}' end)"
    )


def _sidecar() -> str:
    head = (
        '<x:xmpmeta xmlns:x="adobe:ns:meta/">\\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\\n'
        '  <rdf:Description rdf:about=""\\n    xmlns:exif="http://ns.adobe.com/exif/1.0/"\\n'
        '    exif:GPSVersionID="2.3.0.0"\\n    exif:GPSLatitude="'
    )
    altitude = (
        "coalesce(concat('    exif:GPSAltitude=\"', cast(floor(abs(nullif(ele, null)) * 1000 + 0.5) as bigint),"
        " '/1000\"', chr(10), '    exif:GPSAltitudeRef=\"', case when ele < 0 then '1' else '0' end, '\"', chr(10)), '')"
    )
    altitude = f"case when ele is null then '' else {altitude} end"
    return (
        f"concat(e'{head}', {_xmp('lat', 'N', 'S')}, e'\"\\n    exif:GPSLongitude=\"', {_xmp('lon', 'E', 'W')},"
        f" e'\"\\n', {altitude}, e'  />\\n </rdf:RDF>\\n</x:xmpmeta>\\n')"
    )


STATES = f"""states as (select s.camera_id * 2 + s.device as state_order, last_file, import_no,
    case when s.camera_id <> 11 then make end as make, case when s.camera_id <> 11 then model end as model,
    case when s.camera_id <> 11 then serial end as serial
  from import_states s join cameras c on c.camera_id = s.camera_id),
keyed as (select *, {_key('make', 'model', 'serial')} as k from states),
known as (select k, max(state_order) as state_order, arg_max(last_file, state_order) as last_file,
    arg_max(make, state_order) as make, arg_max(model, state_order) as model,
    arg_max(serial, state_order) as serial, min(state_order) as place from keyed group by k),
cards as (select camera_id as card_id,
    case when camera_id % 50 <> 0 then case when camera_id % 7 = 0 then lower(make) else make end end as make,
    case when camera_id % 50 <> 0 then model end as model,
    case when camera_id % 50 <> 0 and camera_id % 5 <> 0 then serial end as serial from cameras),
mine as (select *, {_key('make', 'model', 'serial')} as k from cards)"""

SAME_CAMERA = (
    f"lower({_clean('{a}.make')}) is not distinct from lower({_clean('{b}.make')})"
    f" and lower({_clean('{a}.model')}) is not distinct from lower({_clean('{b}.model')})"
    f" and coalesce(lower({_clean('{a}.serial')}) = lower({_clean('{b}.serial')}), true)"
)


def _same(a: str, b: str) -> str:
    return SAME_CAMERA.replace("{a}", a).replace("{b}", b)


PLACES = f"""imported as (select f.card_id // 8 as place, f.card_id % 8 as import_no, file_id, name, make, model, serial
  from card_files f left join cameras c
  on c.camera_id = case when f.card_id % 3 <> 0
    then f.card_id // 8 % 150 + case when f.card_id % 3 = 1 then 2 else 1 end end)"""


def build() -> dict[str, str]:
    fixes, photos, cards = _view("fixes"), _view("photos"), _view("card_files")
    o: dict[str, str] = {}
    o["numbered_fixes"] = _with(fixes) + "select * replace (cast(segment_no as bigint) as segment_no) from fixes"
    listing = """select track_id, count(*) as fixes, count(distinct segment_no) as segments, min(t_us) as start_us,
  max(t_us) as end_us, max(t_us) - min(t_us) as duration_us from fixes group by track_id"""
    o["track_stats"] = _with(fixes) + listing
    o["track_listing"] = _with(fixes, f"s as ({listing})", """known as (select distinct user_id * 2 + i as track_id
  from events, (values (0), (1)) v(i))""") + """select track_id, coalesce(fixes, 0) as fixes, segments, start_us,
  end_us, duration_us, start_us is not null as timed from known left join s using (track_id)"""
    o["track_distance"] = _with(fixes, STEPPED) + (
        "select track_id, round(coalesce(sum(step_m), 0.0), 3) as metres from stepped group by 1")
    o["live_track_stats"] = _with(fixes, STEPPED, f"s as ({listing})") + (
        "select s.*, metres from s join (select track_id, round(coalesce(sum(step_m), 0.0), 3) as metres"
        " from stepped group by 1) d using (track_id)")
    o["steps"] = _with(fixes, STEPPED) + (
        f"select track_id, segment_no, seq, round(step_m, 3) as step_m,"
        f" round({_speed('p_us', 't_us', 'step_m')}, 3) as speed_mps from stepped")
    e7 = lambda c: f"cast(round({c} * 1e7) as bigint)"
    o["track_lines"] = _with(fixes) + (
        "select track_id, segment_no, cast(0 as bigint) as part_no, count(*) as fixes, string_agg("
        f"concat({e7('lon')}, ' ', {e7('lat')}), ',' order by t_us, seq) as line_e7"
        " from fixes group by track_id, segment_no having count(*) >= 2")
    o["track_heads"] = _with(fixes) + (
        "select track_id, t_us, lat, lon from fixes qualify row_number() over (partition by track_id"
        " order by t_us desc, segment_no desc, seq desc) = 1")
    o["bounds"] = _with(fixes) + (
        "select subject_id, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east,"
        " max(lat) - min(lat) < 1e-6 and max(lon) - min(lon) < 1e-6 as degenerate from fixes group by 1")
    o["in_view"] = _with(fixes) + (
        "select track_id, segment_no, seq, lat, lon from fixes"
        " where lat between 46.95 and 46.97 and lon between 7.5 and 8.5")
    o["in_view_wrapped"] = _with(fixes) + (
        "select track_id, segment_no, seq, lat, lon from fixes"
        " where lat between 46.95 and 46.97 and (lon >= 7.6 or lon <= 7.5)")
    o["view_by_place"], o["view_by_place_wrapped"] = o["in_view"], o["in_view_wrapped"]
    o["as_one_segment"] = _with(fixes) + (
        "select track_id, cast(0 as bigint) as segment_no, row_number() over (partition by track_id"
        " order by t_us, segment_no, seq) as seq, t_us, lat, lon from fixes")
    o["distinct_tracks"] = _with(fixes, """every as (
    select track_id, segment_no, seq, t_us, lat, lon, ele, accuracy, ele_accuracy, speed from fixes
    union all select track_id + 1000000, segment_no, seq, t_us, lat, lon, ele, accuracy, ele_accuracy, speed
    from fixes where track_id % 5 = 0
    union all select track_id + 2000000, segment_no, seq, t_us, lat, lon, case when seq = 1 then 1.0 else ele end,
    accuracy, ele_accuracy, speed from fixes where track_id % 10 = 1)""",
        """whole as (select track_id, list(struct_pack(segment_no, seq, t_us, lat, lon, ele, accuracy, ele_accuracy,
    speed) order by seq) as content from every group by track_id)""") + (
        "select track_id, -track_id as offer_order from whole qualify row_number() over"
        " (partition by content order by -track_id) = 1")

    o["speed_contradictions"] = _with(fixes, STEPPED, CONTRADICTED) + (
        "select track_id, segment_no, seq, speed, round(step_mps, 3) as step_mps from contradicted")
    o["suspects"] = _with(fixes, *_pass(1, "fixes")[:4]) + (
        "select track_id, segment_no, seq, round(out_m, 3) as out_m, round(back_m, 3) as back_m,"
        " round(across_m, 3) as across_m from d1 where suspect")
    o["position_excursions"] = _excursions(1)
    o["all_excursions"] = _excursions(3)
    o["clean_positions"] = _with(fixes, *_cleaning()) + (
        "select track_id, segment_no, seq, t_us, lat, lon from kept3")
    o["clean_elevations"] = _with(fixes, *_cleaning()) + (
        "select track_id, segment_no, seq, ele, ele_finding from elevated where ele_finding is not null")
    o["cleanup_counts"] = _with(fixes, *COUNTED) + "select * from counts"
    measured = ["ele", "ele_before", "ele_after", "ele_accuracy", "speed", "step_mps"]
    nothing = lambda n: ", ".join(f"cast(null as double) as {c}" for c in measured[:n])
    five = ", ".join(["null"] * 5)
    dropped = " union all ".join(
        f"select track_id, segment_no, seq, 'POSITION_EXCURSION' as finding, round(out_m, 3) as out_m,"
        f" round(back_m, 3) as back_m, round(across_m, 3) as across_m, round(fastest, 3) as fastest,"
        f" round(ordinary, 3) as ordinary, {nothing(6)} from judged{n} where drop_it"
        for n in (1, 2, 3))
    o["cleanup_notes"] = _with(fixes, *COUNTED[:-1]) + dropped + (
        f" union all select track_id, segment_no, seq, ele_finding, {five},"
        " case when ele_finding = 'ELEVATION_EXCURSION' then round(ele, 3) end,"
        " case when ele_finding = 'ELEVATION_EXCURSION' then round(b, 3) end,"
        " case when ele_finding = 'ELEVATION_EXCURSION' then round(a, 3) end,"
        " case when ele_finding = 'ELEVATION_UNTRUSTED' then round(ele_accuracy, 3) end, null, null"
        " from elevated where ele_finding is not null"
        f" union all select track_id, segment_no, seq, 'SPEED_CONTRADICTION', {five}, null, null, null, null,"
        " round(speed, 3), round(step_mps, 3) from contradicted")

    o["photo_range"] = _with(photos, _ranges("photos")) + "select * from ranges"
    o["choose_tracks"] = _with(_dated("fixes"), _dated("photos"), BY_SEGMENT, _ranges("photos"), CHOICE) + (
        "select subject_id, track_id, status from choice")
    o["nearest_track"] = _with(_dated("fixes"), _dated("photos"), LATE, BY_SEGMENT, _ranges("late"), CHOICE, NEAREST) + (
        "select * from nearest")
    o["selection_report"] = _with(
        _dated("fixes"), _dated("photos"), LATE, BY_TRACK, _ranges("late"), CHOICE, NEAREST, *COUNTED) + """
select subject_id, count(*) filter (where status = 'used') as used,
  count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'undated') as undated,
  cast(coalesce(sum(position_excursions) filter (where status = 'used'), 0) as bigint) as removed_fixes,
  cast(coalesce(sum(elevation_excursions + elevations_untrusted) filter (where status = 'used'), 0) as bigint)
    as dropped_altitudes,
  any_value(n.track_id) as nearest_track, any_value(n.away_us) as away_us
from choice c join counts using (track_id) left join nearest n using (subject_id) group by subject_id"""
    o["locate_photos"] = _with(*LOCATED) + (
        f"select photo_id, subject_id, placed, track_id, segment_no, fix_us, {PLACED_COLUMNS} from placed")
    o["photo_plan"] = _with(*PLANNED) + (
        "select photo_id, type, selected, writer, wide_gap, placed, track_id, segment_no,"
        f" {PLACED_COLUMNS} from plan")
    o["plan_summary"] = _with(*PLANNED) + """select subject_id, count(*) filter (where selected) as selected,
  count(*) filter (where selected and placed is not null) as will_geotag,
  count(*) filter (where selected and placed is null) as without_fix,
  count(*) filter (where wide_gap) as across_wide_gap from plan group by 1"""
    o["type_counts"] = _with(photos) + (
        f"select {TYPE} as type, count(*) as total, count(*) filter (where {TYPE} <> 'mov') as selected"
        " from photos group by 1")
    o["describe_types"] = _with(cards, f"""t as (select card_id, upper({TYPE}) as t, count(*) as n
  from card_files group by 1, 2)""") + (
        "select card_id, string_agg(concat(n, ' ', t), ', ' order by n desc, t) as types from t group by 1")
    o["geotag_counts"] = _with(*LOCATED, f"""outcomes as (select subject_id, case when placed is null then 'missing'
  when photo_id % 13 = 0 then 'failed' when {WRITER} = 'sidecar' then 'sidecar' else 'embedded' end as o from placed)""") + """
select subject_id, count(*) filter (where o = 'embedded') as embedded, count(*) filter (where o = 'sidecar') as sidecars,
  count(*) filter (where o = 'missing') as missing, count(*) filter (where o = 'failed') as failed,
  count(*) filter (where o in ('embedded', 'sidecar')) as written,
  count(*) filter (where o in ('missing', 'failed')) as untagged from outcomes group by 1"""
    o["tag_table"] = _with(*LOCATED) + f"""select subject_id, photo_id, name, {WRITER} as writer,
  case when lat >= 0 then 'N' else 'S' end as lat_ref, {_dms('lat')} as lat_dms,
  case when lon >= 0 then 'E' else 'W' end as lon_ref, {_dms('lon')} as lon_dms,
  case when ele < 0 then '1' when ele is not null then '0' end as alt_ref,
  cast(floor(abs(ele) * 1000 + 0.5) as bigint) || '/1000' as alt_rational,
  strftime(make_timestamp(fix_us), '%Y:%m:%d') as gps_date, strftime(make_timestamp(fix_us), '%H:%M:%S') as gps_time,
  concat(printf('%+08.4f', {_half_up('lat', 4)}), printf('%+09.4f', {_half_up('lon', 4)}),
    case when ele is not null then printf('%+08.3f', {_half_up('ele', 3)}) else '' end, '/') as iso6709, {_xmp('lat', 'N', 'S')} as xmp_lat, {_xmp('lon', 'E', 'W')} as xmp_lon
from placed where placed is not null"""
    far = """far as (select * replace (-lat as lat, -lon as lon, ele - 600 as ele, case when photo_id % 3 = 0
    then concat(regexp_replace(name, '\\.[^.]*$', ''), '.NEF') else name end as name) from placed)"""
    mirrored = o["tag_table"][len(_with(*LOCATED)):].replace("from placed where", "from far where").replace(
        "= 'cr3'", "in ('cr3', 'nef')")
    o["tag_table_south"] = _with(*LOCATED, far) + mirrored
    o["sidecar_counts"] = _with(*LOCATED, far, f"""outcomes as (select subject_id, case when placed is null then 'missing'
  when photo_id % 13 = 0 then 'failed' when {TYPE} in ('cr3', 'nef') then 'sidecar' else 'embedded' end as o from far)""") + (
        "select" + o["geotag_counts"].rsplit("select", 1)[1])
    o["sidecars"] = _with(*LOCATED) + f"""select subject_id as folder, concat({_stem('name')}, '.xmp') as file,
  {_sidecar()} as document from placed where placed is not null
  qualify row_number() over (partition by subject_id, {_stem('name')} order by name, photo_id) = 1"""
    o["gpx_roundtrip"] = _with(fixes) + (
        "select track_id, cast(segment_no as bigint) as segment_no, seq, t_us, lat, lon, ele, accuracy,"
        " ele_accuracy, speed from fixes")

    file_us = "(least(created_us, modified_us) // 1000) * 1000"
    o["gpx_parts"] = o["gpx_files"] = o["gpx_ranges"] = o["gpx_roundtrip"]
    o["gpx_waypoints"] = _with(fixes, """marks as (select *, seq % 4 = 0 as loose, seq % 10 = 1 as middle from fixes
    where seq % 4 = 0 or seq % 10 = 1)""", """placed as (select *, case when middle then 0
    when seq <= quantile_disc(seq, 0.5) over (partition by track_id) then 1 else 2 end as place from marks)""") + """
select track_id, dense_rank() over (partition by track_id order by place) - 1 as segment_no,
  row_number() over (partition by track_id order by place, t_us, seq) as seq, t_us, lat, lon from placed"""
    o["kml_roundtrip"] = _with(fixes, """every as (select track_id, 0 as place, seq, t_us, lat, lon from fixes
    union all select track_id, 1, 0, min(t_us) - 1000000, 2.5, 1.5 from fixes group by track_id
    union all select track_id, 2, 0, max(t_us) + 1000000, 2.5, 1.5 from fixes group by track_id)""") + """
select track_id, cast(place as bigint) as segment_no,
  row_number() over (partition by track_id order by place, t_us, seq) as seq, t_us, lat, lon from every"""
    o["capture_instant"] = _with(photos) + f"""select photo_id,
  coalesce(epoch_us(exif_local) - cast(exif_offset_s as bigint) * 1000000, epoch_us(exif_local) - 3600000000, {file_us}) - 1500000
    as instant_us,
  coalesce(epoch_us(exif_local), {file_us} + 3600000000) as local_us from photos"""
    o["merge_settings"] = _with(_view("settings")) + (
        "select subject_id, skey, arg_max(svalue, changed_us * 2 + 1 - device) as svalue,"
        " max(changed_us) as changed_us from settings group by 1, 2")
    o["resolve_params"] = _with(_view("settings"), """m as (select subject_id,
    max(svalue) filter (where skey = 'click') as t, max(svalue) filter (where skey = 'view') as c
  from settings group by 1)""") + """select subject_id,
  cast(case when subject_id % 3 = 0 then 5 when t % 4 <> 0 then t else 30 end * 60000 as bigint) as tolerance_ms,
  cast(trunc(case when subject_id % 5 = 0 then -1.25 when c % 4 <> 0 then c else 0 end * 60000) as bigint)
    as clock_offset_ms from m"""

    o["camera_key"] = _with(_view("cameras")) + (
        f"select camera_id, {_key('make', 'model', 'serial')} as camera_key,"
        f" {_label('make', 'model', 'serial')} as camera_label from cameras")
    o["camera_order"] = _with(cards, *_ordered("card_files", "card_id")) + (
        "select card_id, file_id, name, rank from ordered")
    two = [_view("import_states"), "a as (select * from import_states where device = 0)",
           "b as (select * from import_states where device = 1)"]
    o["is_later"] = _with(*two) + (
        f"select camera_id, a.last_file as fa, b.last_file as fb, {_later('a.last_file', 'b.last_file')} as later"
        " from a join b using (camera_id)")
    second = (
        "(a.camera_id is null or coalesce(case when lower(a.last_file) = lower(b.last_file) then b.at_us > a.at_us"
        f" else {_later('b.last_file', 'a.last_file')} end, false))")
    o["merge_import_state"] = _with(*two) + f"""select coalesce(a.camera_id, b.camera_id) as camera_id,
  case when {second} then b.last_file else a.last_file end as last_file,
  greatest(a.import_no, b.import_no) as import_no, case when {second} then b.at_us else a.at_us end as at_us,
  case when {second} then b.device else a.device end as device
from a full outer join b on a.camera_id = b.camera_id"""
    wins = ("coalesce(case when lower(w.last_file) = lower(s.last_file) then s.at_us > w.at_us"
            f" else {_later('s.last_file', 'w.last_file')} end, false)")
    o["merge_device_states"] = f"""with recursive s as (
  select case when o_custkey % 50 <> 0 then o_custkey end as camera_id,
    'DSCF' || lpad(cast((o_orderkey * 7919) % 10000 as varchar), 4, '0') || '.RAF' as last_file,
    o_orderkey % 40 as import_no, epoch_us(o_orderdate) as at_us, o_orderkey as device,
    row_number() over (partition by case when o_custkey % 50 <> 0 then o_custkey end order by o_orderkey) as turn
  from orders),
walk as (
  select camera_id, turn, last_file, import_no, at_us, device from s where turn = 1
  union all
  select s.camera_id, s.turn, case when {wins} then s.last_file else w.last_file end,
    greatest(w.import_no, s.import_no), case when {wins} then s.at_us else w.at_us end,
    case when {wins} then s.device else w.device end
  from walk w join s on s.camera_id is not distinct from w.camera_id and s.turn = w.turn + 1)
select camera_id, last_file, import_no, at_us, device from walk
qualify row_number() over (partition by camera_id order by turn desc) = 1"""
    o["merge_device_settings"] = """
select user_id as subject_id, event_type as skey,
  arg_max(event_id, struct_pack(d := epoch_us(ts) // 86400000000, e := -event_id)) as svalue,
  max(epoch_us(ts) // 86400000000) as changed_us
from events group by 1, 2"""
    by_name = """points as (select card_id, arg_min(lower(name), file_id) filter (where file_id % 5 = 0
    and name like 'DSCF%' and card_id % 7 <> 0) as after_name from card_files group by 1),
hits as (select o.card_id, min(rank) as hit from ordered o join points p using (card_id)
  where lower(name) = after_name group by 1)"""
    o["filter_new_by_name"] = _with(cards, *_ordered("card_files", "card_id"), by_name) + """
select card_id, file_id, name, cast(rank as bigint) as rank, true as placed from ordered join points using (card_id)
  left join hits using (card_id) where after_name is null or rank > hit
union all select card_id, file_id, name, null, false from n1 join points using (card_id)
  where v is null and after_name is null"""
    by_time = """points as (select card_id, case when card_id % 2 = 0
    then max(local_us) filter (where file_id % 5 = 0)
    else min(local_us) + (max(local_us) - min(local_us)) // 3 end as after_us from card_files group by 1),
hits as (select card_id, min(rank) as hit, arg_min(local_us, rank) as hit_us from ordered join points using (card_id)
  where local_us >= after_us group by 1)"""
    o["filter_new_by_time"] = _with(cards, *_ordered("card_files", "card_id"), by_time) + """
select card_id, file_id, name, cast(rank as bigint) as rank, true as placed from ordered join points using (card_id)
  left join hits using (card_id)
  where after_us is null or rank > hit or (rank = hit and hit_us > after_us)
union all select card_id, file_id, name, null, false from n1 join points using (card_id)
  where v is null and (after_us is null or local_us > after_us)"""
    o["camera_of"] = _with(
        cards, _view("cameras"), NAMED_FILES, *_ordered("named", "card_id"), _camera_of("card_id")) + (
        f"select card_id, {_clean('make')} as make, {_clean('model')} as model, {_clean('serial')} as serial,"
        " camera_key from found"
        " union all select distinct card_id, null, null, null, null from ordered"
        " where card_id not in (select card_id from found)")
    o["state_for_camera"] = _with(_view("import_states"), _view("cameras"), STATES) + f"""
select card_id, state_order as state_state_order, last_file as state_last_file from (
  select m.card_id, s.state_order, s.last_file, row_number() over (partition by m.card_id
      order by case when m.k = s.k then 0 else 1 end, s.place) as nth
  from mine m join known s on (m.k is null and s.k is null)
    or (m.k is not null and s.k is not null and (m.k = s.k or ({_same('m', 's')}))))
where nth = 1"""
    o["local_watermark"] = _with(
        cards, _view("cameras"), PLACES, *_ordered("imported", "place, import_no"), _camera_of("place, import_no"),
        """mine as (select place, make, model, serial
    from (select distinct place from imported) p join cameras on camera_id = place % 150 + 1)""",
        "last as (select place, import_no, arg_max(name, rank) as last_file from ordered group by 1, 2)") + f"""
select cast(l.place as bigint) as card_id, import_no as local_no, last_file as local_file
from last l join mine m using (place) left join found f using (place, import_no)
where f.camera_key is null or ({_same('f', 'm')})
qualify row_number() over (partition by l.place order by import_no desc) = 1"""
    o["resume_point"] = _with(
        cards, "picked as (select * from card_files where file_id % 3 = 0 and card_id % 5 <> 0)",
        *_ordered("picked", "card_id"),
        "local as (select card_id, arg_max(name, rank) as local_file from ordered group by 1)",
        """state as (select card_id, case when card_id % 6 = 0 then 'DSCF9000.RAF' else lower(arg_min(name, file_id)) end
    as f from card_files where file_id % 4 = 1 group by 1)""",
        """shared as (select * from state s where exists (select 1 from card_files c where c.card_id = s.card_id
    and lower(c.name) = lower(s.f)))""",
        f"""joined as (select c.card_id, local_file, f, f is not null and (local_file is null
      or {_later('f', 'local_file')}) as ahead
    from (select distinct card_id from card_files) c left join local using (card_id) left join shared using (card_id))""") + """
select card_id,
  case when card_id % 18 = 0 then null when card_id % 9 = 0 then 'DSCF9999.JPG' when ahead then f else local_file end
    as after_name,
  cast(case when card_id % 18 = 0 then 0 end as bigint) as after_us,
  case when card_id % 18 = 0 then 'time' when card_id % 9 = 0 then 'name' when ahead then 'shared'
    when local_file is not null then 'local' else 'none' end as source from joined"""
    o["next_import_no"] = _with(cards, _view("import_states")) + """
select place, max(n) + 1 as next_no from (
  select card_id // 5 as place, case when card_id % 5 = 0 then 0 else card_id end as n from card_files
  union all select camera_id // 5, import_no from import_states) group by 1"""
    o["last_import_of"] = _with(
        cards, "picked as (select * from card_files where file_id % 3 = 0)", *_ordered("picked", "card_id")) + (
        "select card_id, arg_max(name, rank) as last_file from ordered group by 1")
    o["pair_copies"] = _with(cards) + (
        "select card_id % 3 as place, file_id as entry_id, row_number() over (partition by card_id % 3, name"
        " order by file_id) = 1 as copied from card_files where file_id % 11 <> 0")

    o["track_times"] = """select event_id, case event_id % 5
    when 0 then epoch_us(date_trunc('second', ts)) when 1 then epoch_us(date_trunc('second', ts)) - 7200000000
    when 2 then epoch_us(date_trunc('second', ts)) - 32400000000
    when 3 then epoch_us(date_trunc('second', ts)) + 250000 + 19800000000 end as t_us from events"""
    o["track_problems"] = """select o_orderkey as track_id, case o_orderkey % 6 when 1 then 'declares a DOCTYPE'
    when 2 then 'not well formed' when 3 then 'unsupported root element html' when 4 then 'no timestamped points'
    when 5 then 'no timestamped points' end as problem,
  cast(case when o_orderkey % 6 = 0 then 1 else 0 end as bigint) as segments from orders"""
    o["type_lists"] = """select c_custkey, array_to_string(list_filter(['jpg', lower(substr(c_mktsegment, 1, 3)),
  concat('x', c_custkey % 3)], lambda t: t <> ''), '|') as types from customer"""
    o["syncable_names"] = (
        "select p_partkey, p_partkey % 11 <> 0 and p_partkey % 7 > 1 as syncable from part")
    o["narrow_tracks"] = _with(fixes, """named as (select track_id, count(*) as fixes, concat('walk ', track_id % 40) as name
  from fixes group by track_id)""") + """
select *, true as picked from named where name in (select name from named where track_id % 9 = 0)
union all select *, false from named"""
    o["merged_tracks"] = _with(fixes, "m as (select *, 1 - track_id % 2 as part from fixes)") + """
select subject_id, track_id, dense_rank() over (partition by subject_id order by part, track_id, segment_no) - 1
  as segment_no, seq, part from m"""
    o["explain_fixes"] = _with(fixes, *_pass(1, "fixes"), *_pass(2, "kept1"), *_pass(3, "kept2")) + " union all ".join(
        f"select track_id, segment_no, seq, t_us, round(out_m, 3) as out_m from judged{n} where drop_it and seq % 3 = 0"
        for n in (1, 2, 3))
    o["delivered_fixes"] = _with(_view("deliveries")) + """
select device, run, delivery_id, now_us - age_ms * 1000 as t_us,
  cast(case when delivery_id % 3 <> 0 then delivery_id % 900 end as double) as ele, accuracy,
  cast(case when delivery_id % 3 <> 0 then delivery_id % 17 end as double) as ele_accuracy,
  case when delivery_id % 2 = 0 then cast(1.5 as double) end as speed, provider as source from deliveries"""
    o["plan_flips"] = _with(*LOCATED) + f"""select photo_id, {TYPE} as type, {TYPE} not in ('jpg', 'raf') as selected,
  {TYPE} not in ('jpg', 'raf') and coalesce(gap_m, 0) >= 500 as wide_gap from placed"""
    hand = f"case when photo_id % 11 = 0 then photo_id % 2 = 0 else {TYPE} <> 'mov' end"
    o["plan_file_flips"] = _with(*LOCATED) + f"""select photo_id, {TYPE} as type, {hand} as selected,
  {hand} and coalesce(gap_m, 0) >= 500 as wide_gap from placed"""
    card = """card as (select photo_id, photo_id as file_id, subject_id, name,
    t_us + 1704067200000000 as at_us, cast(case photo_id % 4 when 0 then 7200 when 1 then -19800 else 0 end as bigint) as o from photos)"""
    read = """timed as (select *, case when subject_id % 3 <> 0 then (subject_id % 16 + 1) * 60000 else 1800000 end as tolerance_ms,
    at_us + 5000000 as created_us,
    case when photo_id % 10 <> 9 then at_us + o * 1000000
      else least(at_us + 5000000, at_us + cast(photo_id % 3 as bigint) * 10000000 - 10000000) // 1000 * 1000 end as local_us,
    case when photo_id % 10 <> 9 then at_us
      else least(at_us + 5000000, at_us + cast(photo_id % 3 as bigint) * 10000000 - 10000000) // 1000 * 1000 end
    + cast(case when subject_id % 3 <> 0 then subject_id % 5 * 7000 - 14000 else 0 end as bigint) * 1000 as t_us from card)"""
    after = """points as (select subject_id,
    case when subject_id % 3 = 0 then arg_min(lower(name), photo_id) filter (where photo_id % 7 = 0) end as after_name,
    case when subject_id % 3 = 1 then min(created_us) + 600000000 end as after_us from timed group by 1)"""
    hits = """hits as (select subject_id, min(rank) as hit, arg_min(local_us, rank) as hit_us
    from ordered join points using (subject_id)
    where case when after_name is not null then lower(name) = after_name else local_us >= after_us end group by 1)"""
    new = """fresh as (select photo_id, subject_id, name, t_us, tolerance_ms, cast(rank as bigint) as rank
    from ordered join points using (subject_id) left join hits using (subject_id)
    where (after_name is null and after_us is null) or rank > hit or (after_us is not null and rank = hit and hit_us > after_us)
  union all select photo_id, subject_id, name, t_us, tolerance_ms, null from n1 join points using (subject_id)
    where v is null and ((after_name is null and after_us is null) or local_us > after_us))"""
    ranges = """ranges as (select subject_id, min(t_us) as first_us, max(t_us) as last_us,
    max(tolerance_ms) * 1000 as reach from fresh group by 1)"""
    o["import_plan"] = _with(
        _dated("fixes"), _view("photos"), card, read, *_ordered("timed", "subject_id"), after, hits, new, BY_TRACK, ranges,
        _choice("reach"), USED, *_cleaning("used"), *_locate("cleaned", "fresh", "s.tolerance_ms * 1000")) + f"""
select p.photo_id, p.t_us, rank, {TYPE.replace('name', 'p.name')} as type, {TYPE.replace('name', 'p.name')} <> 'mov' as selected,
  {WRITER.replace('name', 'p.name')} as writer,
  {TYPE.replace('name', 'p.name')} <> 'mov' and coalesce(gap_m, 0) >= 500 as wide_gap,
  placed, track_id, segment_no, {PLACED_COLUMNS} from placed p join fresh using (photo_id)"""
    o["usable_states"] = """select case when o_orderkey % 4 <> 0 then concat('M', o_orderkey % 90, '_X') end as camera_key,
  concat('F', o_orderkey) as last_file, o_orderkey % 30 as import_no,
  epoch_us(date_trunc('second', o_orderdate)) as at_us, case when o_orderkey % 2 = 0 then 'pc' else '' end as device
from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 9 <> 0"""
    o["usable_settings"] = _with(_view("settings")) + """
select subject_id, concat(skey, '_', device) as skey, cast(svalue as varchar) as svalue,
  changed_us * 86400000000 as changed_us from settings where svalue % 3 <> 0"""

    o["sync_plan"] = _sync("keep_both", "ends_with(fname, '77.gpx') and ld is not null") + "select * from actions"
    o["sync_plan_merge"] = _sync("merge", "false") + "select * from actions"
    merged = "files as (select p_partkey as k, i from part, (values (0), (1)) v(i)" + """
    where concat('p', p_partkey, '.gpx') in (select name from actions where action = 'merge'))"""
    chosen = _sync("merge", "false").rstrip()
    o["sync_merged_settings"] = f"""{chosen}, {merged} select concat('p', k, '.gpx') as name, cast(i as varchar) as skey,
  case when (k + i) % 4 > (k + i) % 5 then k * 3 + i else k * 2 + i end as svalue,
  greatest((k + i) % 4, (k + i) % 5) as changed_us from files"""
    shot = lambda n: f"concat('DSCF', lpad(cast(({n}) % 10000 as varchar), 4, '0'), '.RAF')"
    o["sync_merged_states"] = f"""{chosen}, {merged}, sides as (select k, i, {shot('k * 7 + i')} as fa,
  {shot('k * 7 + i + k % 3 - 1')} as fb from files), judged as (select *, coalesce(case when fa = fb then k % 4 > k % 5
  else {_later('fb', 'fa')} end, false) as second from sides)
select concat('p', k, '.gpx') as name, case when i = 1 then 'F_X' end as camera_key,
  case when second then fb else fa end as last_file, greatest(k % 40, k % 37) as import_no,
  case when second then k % 4 else k % 5 end as at_us, case when second then 'r' else 'l' end as device from judged"""
    o["sync_again"] = f"""with sides as (
  select p_partkey as k, i, {shot('p_partkey * 7 + i')} as fa, {shot('p_partkey * 7 + i + p_partkey % 3 - 1')} as fb
  from part, (values (0), (1)) v(i)),
judged as (select *, coalesce(case when fa = fb then false else {_later('fb', 'fa')} end, false) as second from sides),
lines as (
  select k, case when i = 1 then 1 else 0 end as nth, case when i = 1 then 'F_X' else '\\N' end || chr(9)
    || case when second then fb else fa end || chr(9) || greatest(k % 40, k % 37) || chr(9) || '1970-01-01T00:00:00'
    || case when k % 5 = 0 then '' else '.00000' || (k % 5) end || 'Z' || chr(9)
    || case when second then 'r' else 'l\\t' end || chr(10) as line
  from judged)
select concat('p', k, '.gpx') as name, md5(string_agg(line, '' order by nth)) as digest, cast(0 as bigint) as "left"
from lines group by k"""
    o["sync_report"] = _sync("keep_both", "false") + """select folder_id,
  count(*) filter (where action in ('upload', 'update', 'merge')) as uploads,
  count(*) filter (where action in ('download', 'merge')) as downloads,
  count(*) filter (where action = 'rename_local') as renames,
  count(*) filter (where action in ('download', 'merge', 'rename_local')) > 0 as changed_locally
from actions group by 1"""
    o["dedupe_remote"] = _with(
        *CLASHING, "ranked as (select *, row_number() over (partition by name order by created, remote_id) as nth from remote)",
        "asked as (select * from ranked where nth > 1)",
        "taken as (select name from here union select name from remote union select name from synced)",
        _taken_numbers()) + """
select r.remote_id, r.name, coalesce(regexp_replace(r.name, '\\.gpx$', '') || ' (' || f.n || ').gpx', r.name) as goes_by,
  (select min(s.name) from synced s join here h on h.name = s.name and h.digest = s.digest
   where s.remote_id = r.remote_id and r.nth > 1) as follows
from ranked r left join numbered k on k.remote_id = r.remote_id left join free f on f.name = k.name and f.k = k.k"""
    o["free_names"] = _with(
        *CLASHING, "asked as (select * from remote)", "taken as (select name from here)", _taken_numbers()) + """
select k.name, created, regexp_replace(k.name, '\\.gpx$', '') || ' (' || f.n || ').gpx' as free_name
from numbered k join free f on f.name = k.name and f.k = k.k"""

    o["admit_fixes"] = _with(_view("deliveries"), ADMITTED.replace("{silence}", "90000")) + (
        "select device, run, delivery_id, outcome from admitted")
    o["admit_stream"] = o["admit_fixes"]
    o["recording_status"] = _with(_view("deliveries"), ADMITTED.replace("{silence}", "180000")) + (
        "select device, run, count(*) filter (where outcome = 'written') as written,"
        " count(*) filter (where outcome = 'dropped') as dropped from admitted group by 1, 2")
    o["recorded_elapsed"] = _with(_view("deliveries"), """spans as (select device, run, max(now_us) - min(now_us) as d,
    run = max(run) over (partition by device) and device % 2 = 0 as open from deliveries group by device, run)""") + (
        "select device as recording_id, cast(sum(d + case when open then 5000000 else 0 end) as bigint)"
        " as recorded_us from spans group by 1")
    o["declutter_grid"] = _with(fixes) + (
        "select subject_id, min(track_id * 1000000 + seq) as ord, count(*) as count from fixes"
        " group by subject_id, floor(lon * 100000 / 64.0), floor(lat * 100000 / 64.0)")
    o["declutter_exact"] = "with recursive " + _with(fixes).removeprefix("with ").rstrip() + """, pt as (
  select *, floor(x / 64.0) as cx, floor(y / 64.0) as cy, row_number() over (partition by subject_id order by ord) as r
  from (select subject_id, track_id * 1000000 + seq as ord, lon * 100000 as x, lat * 100000 as y from fixes)),
walk as (
  select subject_id, cast(0 as bigint) as r, [struct_pack(ord := ord, x := x, y := y, cx := cx, cy := cy)][1:0] as kept
  from pt where r = 1
  union all
  select w.subject_id, p.r, case when len(list_filter(kept, lambda k: greatest(abs(k.x - p.x), abs(k.y - p.y)) < 64.0)) > 0
    then kept else list_append(kept, struct_pack(ord := p.ord, x := p.x, y := p.y, cx := p.cx, cy := p.cy)) end
  from walk w join pt p on p.subject_id = w.subject_id and p.r = w.r + 1),
lead_pt as (
  select subject_id, unnest(k) as k from (
    select subject_id, arg_max(kept, r) as k from walk group by subject_id)),
nearest as (
  select p.subject_id, p.ord, arg_min(k.ord, struct_pack(d := greatest(abs(k.x - p.x), abs(k.y - p.y)),
    sx := k.cx - p.cx, sy := k.cy - p.cy)) as lead_ord
  from pt p join lead_pt l on p.subject_id = l.subject_id and k.ord <= p.ord
    and greatest(abs(k.x - p.x), abs(k.y - p.y)) < 64.0
  group by p.subject_id, p.ord)
select subject_id, lead_ord as ord, count(*) as count from nearest group by subject_id, lead_ord"""
    return o
