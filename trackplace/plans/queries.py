"""Every registered query: an operator over the views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.functions import names, times
from trackplace.functions.geo import in_box, step_speed
from trackplace.operators import catalog, cleanup, declutter, manifest, select, stats, views
from trackplace.operators.locate import locate
from trackplace.plans import placement
from trackplace.plans.fixtures import ORIGIN_US, fixes, table, view
from trackplace.sinks import documents, states
from trackplace.sources import files
from trackplace.session import checkpoint, shared_folder
from trackplace.sources.tracks import fixes_of, parse_tracks, read_tracks
from trackplace.streaming import live, recorder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PLACE_MS = 60_000
SPACING = 64.0


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- tracks ------------------------------------------------------------------


@query
def numbered_fixes(spark, sf):
    return fixes(spark, sf)


@query
def track_stats(spark, sf):
    return stats.track_stats(fixes(spark, sf))


@query
def track_listing(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id")).distinct()
    known = users.select(F.explode(F.array(*[F.col("user_id") * 2 + i for i in (0, 1)])).alias("track_id"))
    return stats.track_listing(known, fixes(spark, sf))


@query
def track_distance(spark, sf):
    return rounded(stats.track_distance(fixes(spark, sf)), 3, "metres")


@query
def steps(spark, sf):
    out = stats.steps(fixes(spark, sf))
    speed = step_speed(F.col("before.t_us"), F.col("t_us"), F.col("step_m"))
    out = out.select("track_id", "segment_no", "seq", "step_m", speed.alias("speed_mps"))
    return rounded(out, 3, "step_m", "speed_mps")


@query
def track_lines(spark, sf):
    lines = documents.track_lines(fixes(spark, sf))
    e7 = lambda c: F.round(c * 1e7).cast("long").cast("string")
    text = F.array_join(F.transform("points", lambda p: F.concat(e7(p["lon"]), F.lit(" "), e7(p["lat"]))), ",")
    return lines.select("track_id", "segment_no", "part_no", "fixes", text.alias("line_e7"))


@query
def track_heads(spark, sf):
    return documents.track_heads(fixes(spark, sf))


@query
def bounds(spark, sf):
    return stats.bounds(fixes(spark, sf), ["subject_id"])


@query
def in_view(spark, sf):
    seen = fixes(spark, sf).filter(in_box(F.col("lat"), F.col("lon"), 46.95, 7.5, 46.97, 8.5))
    return seen.select("track_id", "segment_no", "seq", "lat", "lon")


@query
def in_view_wrapped(spark, sf):
    """A view from 7.6 degrees east round the back of the globe to 7.5."""
    seen = fixes(spark, sf).filter(in_box(F.col("lat"), F.col("lon"), 46.95, 7.6, 46.97, 7.5))
    return seen.select("track_id", "segment_no", "seq", "lat", "lon")


def _stored_view(spark, sf, *box):
    folder = shared_folder(spark, "by_place")
    views.write_by_place(fixes(spark, sf), folder)
    return views.fixes_in_view(spark, folder, *box).select("track_id", "segment_no", "seq", "lat", "lon")


@query
def view_by_place(spark, sf):
    """``in_view`` from fixes stored along a space-filling curve."""
    return _stored_view(spark, sf, 46.95, 7.5, 46.97, 8.5)


@query
def view_by_place_wrapped(spark, sf):
    return _stored_view(spark, sf, 46.95, 7.6, 46.97, 7.5)


@query
def as_one_segment(spark, sf):
    joined = stats.as_one_segment(fixes(spark, sf))
    return joined.select("track_id", "segment_no", "seq", "t_us", "lat", "lon")


@query
def distinct_tracks(spark, sf):
    original = fixes(spark, sf).select(
        "track_id", "segment_no", "seq", "t_us", "lat", "lon", "ele", "accuracy", "ele_accuracy", "speed"
    )
    copies = original.filter("track_id % 5 = 0").withColumn("track_id", F.col("track_id") + 1_000_000)
    # The same again but for one altitude.
    near = original.filter("track_id % 10 = 1").withColumns({
        "track_id": F.col("track_id") + 2_000_000,
        "ele": F.when(F.col("seq") == 1, F.lit(1.0)).otherwise(F.col("ele")),
    })
    every = original.unionByName(copies).unionByName(near)
    tracks = every.select("track_id").distinct().withColumn("offer_order", -F.col("track_id"))
    kept = select.distinct_tracks(tracks, every, ["track_id"])
    return kept.select("track_id", "offer_order")


# --- cleanup -----------------------------------------------------------------


@query
def speed_contradictions(spark, sf):
    found = cleanup.speed_contradictions(fixes(spark, sf))
    return rounded(found.select("track_id", "segment_no", "seq", "speed", "step_mps"), 3, "step_mps")


@query
def suspects(spark, sf):
    out = cleanup.shapes(fixes(spark, sf)).filter("suspect").select(
        "track_id", "segment_no", "seq", "out_m", "back_m", "across_m"
    )
    return rounded(out, 3, "out_m", "back_m", "across_m")


def _excursions(spark, sf, passes):
    judged = cleanup.judge(fixes(spark, sf), cleanup.CleanupOptions(max_passes=passes))
    out = judged.filter("drop_pass > 0").select(
        "track_id", "segment_no", "seq", F.col("drop_pass").cast("long").alias("drop_pass"),
        *[F.col(f"note_{c}").alias(c) for c in ("out_m", "back_m", "across_m", "fastest", "ordinary")],
    )
    return rounded(out, 3, "out_m", "back_m", "across_m", "fastest", "ordinary")


@query
def position_excursions(spark, sf):
    return _excursions(spark, sf, 1)


@query
def all_excursions(spark, sf):
    return _excursions(spark, sf, 3)


@query
def clean_positions(spark, sf):
    judged = cleanup.judge(fixes(spark, sf))
    return judged.filter("drop_pass = 0").select("track_id", "segment_no", "seq", "t_us", "lat", "lon")


@query
def clean_elevations(spark, sf):
    judged = cleanup.judge(fixes(spark, sf)).filter("ele_finding is not null")
    return judged.select("track_id", "segment_no", "seq", "ele", "ele_finding")


@query
def cleanup_counts(spark, sf):
    return cleanup.cleanup_counts(cleanup.judge(fixes(spark, sf)), ["track_id"])


@query
def cleanup_notes(spark, sf):
    found = cleanup.notes(cleanup.judge(fixes(spark, sf)))
    return rounded(found.drop("subject_id", "t_us"), 3, *cleanup.MEASURED)


# --- selection and placement -------------------------------------------------


def _shots(spark, sf):
    return view(spark, sf, "photos").select("photo_id", "subject_id", "t_us", "name")


def _dated(df, placeholder=None):
    """Back from the compressed clock's origin to a real date; recordings that
    match ``placeholder`` keep times no recorder could have had."""
    real = F.col("t_us") + ORIGIN_US
    return df.withColumn("t_us", real if placeholder is None else F.when(placeholder, F.col("t_us")).otherwise(real))


def _dated_fixes(spark, sf):
    return _dated(fixes(spark, sf), F.col("track_id") % 10 == 3)


def _spans_by_segment(spark, sf):
    """Short recordings: each segment stands for a track."""
    return select.track_spans(
        _dated_fixes(spark, sf).withColumn("track_id", F.col("track_id") * 1000 + F.col("segment_no"))
    )


def _late_shots(spark, sf):
    """Photos of every second subject are two hours off."""
    off = (F.col("subject_id") % 2) * 7_200_000_000
    return _dated(_shots(spark, sf)).withColumn("t_us", F.col("t_us") + off)


@query
def photo_range(spark, sf):
    return select.photo_range(_shots(spark, sf))


@query
def choose_tracks(spark, sf):
    choice = select.choose_tracks(
        _spans_by_segment(spark, sf), select.photo_range(_dated(_shots(spark, sf))), PLACE_MS
    )
    return choice.select("subject_id", "track_id", "status")


@query
def nearest_track(spark, sf):
    ranges = select.photo_range(_late_shots(spark, sf))
    return select.nearest_track(select.choose_tracks(_spans_by_segment(spark, sf), ranges, PLACE_MS))


@query
def selection_report(spark, sf):
    points = _dated_fixes(spark, sf)
    choice = select.choose_tracks(
        select.track_spans(points), select.photo_range(_late_shots(spark, sf)), PLACE_MS
    )
    counts = cleanup.cleanup_counts(cleanup.judge(points), ["track_id"])
    report = select.selection_report(choice, counts)
    return report.select(
        "subject_id", "used", "skipped", "undated", "removed_fixes", "dropped_altitudes",
        "nearest_track", "away_us",
    )


def _placed(df):
    out = df.select(
        "photo_id", "subject_id", "placed", "track_id", "segment_no", "fix_us", "lat", "lon", "ele", "gap_m"
    )
    return rounded(rounded(out, 7, "lat", "lon"), 3, "ele", "gap_m")


@query
def locate_photos(spark, sf):
    return _placed(locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS))


def _plan(spark, sf):
    return placement.photo_plan(_dated(_shots(spark, sf)), _dated_fixes(spark, sf), PLACE_MS, ["mov"])


@query
def photo_plan(spark, sf):
    out = _plan(spark, sf).select(
        "photo_id", "type", "selected", "writer", "wide_gap", "placed", "track_id", "segment_no",
        "lat", "lon", "ele", "gap_m",
    )
    return rounded(rounded(out, 7, "lat", "lon"), 3, "ele", "gap_m")


def _params(spark, sf):
    """Tolerances of one to sixteen minutes and clock offsets, for two subjects of three."""
    s = view(spark, sf, "photos").select("subject_id").distinct().filter("subject_id % 3 <> 0")
    return s.select(
        "subject_id", ((F.col("subject_id") % 16 + 1) * 60_000).alias("tolerance_ms"),
        (F.col("subject_id") % 5 * 7_000 - 14_000).alias("clock_offset_ms"))


def _card_photos(spark, sf):
    """Photos with the readings of their cameras' clocks at the real date."""
    p = view(spark, sf, "photos").select("photo_id", "subject_id", "name", "t_us")
    at = F.col("t_us") + ORIGIN_US
    offset = F.when(F.col("photo_id") % 4 == 0, 7200).when(F.col("photo_id") % 4 == 1, -19800)
    local = F.timestamp_micros(at + F.coalesce(offset, F.lit(0)).cast("long") * 1_000_000).cast("timestamp_ntz")
    return p.select(
        "photo_id", "subject_id", "name", F.when(F.col("photo_id") % 10 != 9, local).alias("exif_local"),
        offset.alias("exif_offset_s"), (at + 5_000_000).alias("created_us"),
        (at + (F.col("photo_id") % 3) * 10_000_000 - 10_000_000).alias("modified_us"))


@query
def import_plan(spark, sf):
    photos = _card_photos(spark, sf)
    resume = photos.groupBy("subject_id").agg(
        F.min_by(F.lower("name"), F.when(F.col("photo_id") % 7 == 0, F.col("photo_id"))).alias("name"),
        F.min("created_us").alias("us")).select(
        "subject_id", F.when(F.col("subject_id") % 3 == 0, F.col("name")).alias("after_name"),
        F.when(F.col("subject_id") % 3 == 1, F.col("us") + 600_000_000).alias("after_us"))
    out = placement.import_plan(photos, _dated_fixes(spark, sf), _params(spark, sf), resume, "UTC", ["mov"]).select(
        "photo_id", "t_us", "rank", "type", "selected", "writer", "wide_gap", "placed", "track_id", "segment_no",
        "lat", "lon", "ele", "gap_m",
    )
    return rounded(rounded(out, 7, "lat", "lon"), 3, "ele", "gap_m")


@query
def plan_summary(spark, sf):
    return placement.plan_summary(_plan(spark, sf))


@query
def type_counts(spark, sf):
    placed = placement.finish_plan(locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS), ["mov"])
    return placement.type_counts(placed)


@query
def describe_types(spark, sf):
    return placement.describe_types(view(spark, sf, "card_files"), ["card_id"])


@query
def geotag_counts(spark, sf):
    placed = placement.finish_plan(locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS))
    outcome = (
        F.when(F.col("placed").isNull(), "missing").when(F.col("photo_id") % 13 == 0, "failed")
        .when(F.col("writer") == "sidecar", "sidecar").otherwise("embedded")
    )
    return placement.geotag_counts(placed.withColumn("outcome", outcome), ["subject_id"])


@query
def tag_table(spark, sf):
    placed = placement.finish_plan(locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS))
    return placement.tag_table(placed)


def _mirrored(spark, sf):
    """The placed photos on the far side of the equator and of Greenwich, below
    the sea, a third of them in a format without a built-in writer."""
    placed = locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS)
    return placed.withColumns({
        "lat": -F.col("lat"), "lon": -F.col("lon"), "ele": F.col("ele") - 600,
        "name": F.when(F.col("photo_id") % 3 == 0, F.regexp_replace("name", r"\.[^.]*$", ".NEF")).otherwise(F.col("name")),
    })


@query
def tag_table_south(spark, sf):
    return placement.tag_table(placement.finish_plan(_mirrored(spark, sf)))


@query
def sidecar_counts(spark, sf):
    """Outcomes by writer, with only the writers that are built in."""
    plan = placement.finish_plan(_mirrored(spark, sf), built_in_only=True)
    outcome = (
        F.when(F.col("placed").isNull(), "missing").when(F.col("photo_id") % 13 == 0, "failed")
        .when(F.col("writer") == "sidecar", "sidecar").otherwise("embedded"))
    return placement.geotag_counts(plan.withColumn("outcome", outcome), ["subject_id"])


@query
def sidecars(spark, sf):
    placed = locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS)
    return documents.sidecar_documents(placed.withColumn("folder", F.col("subject_id")))


@query
def gpx_roundtrip(spark, sf):
    written = documents.gpx_documents(fixes(spark, sf))
    files = written.select(
        "track_id", F.col("document").alias("text"), F.lit("gpx").alias("type"),
    )
    back = fixes_of(parse_tracks(files), ["track_id"])
    return back.drop("source")


@query
def gpx_parts(spark, sf):
    """The round trip with a document per 20 fixes."""
    written = documents.gpx_documents(fixes(spark, sf), part_rows=20)
    files = written.select("track_id", F.col("document").alias("text"), F.lit("gpx").alias("type"))
    return fixes_of(parse_tracks(files), ["track_id"]).drop("source")


def _filed_tracks(spark, sf, **sizes):
    """The fixes written to files and read back, with the track number out of the file name."""
    folder = shared_folder(spark, "tracks")
    documents.write_gpx(fixes(spark, sf), folder, part_rows=sizes.pop("part_rows", None))
    tracks, back, _ = read_tracks(spark, folder=folder, **sizes)
    numbers = tracks.select("track_id", F.col("name").cast("long").alias("_number"))
    back = back.join(numbers, "track_id").withColumn("track_id", F.col("_number"))
    return back.drop("source", "_number")


@query
def gpx_files(spark, sf):
    """A file per 30 fixes of a track, listed and read as tracks again."""
    return _filed_tracks(spark, sf, part_rows=30)


@query
def gpx_ranges(spark, sf):
    """A file per track, read by ranges of 4,000 bytes that know nothing of each other."""
    return _filed_tracks(spark, sf, whole_bytes=0, range_bytes=4000)


def _marks(spark, sf):
    """Every fourth fix of a track is loose; each track has one more segment of
    its fixes whose number ends in 1, written between the loose ones."""
    f = fixes(spark, sf)
    return f.withColumns({"loose": F.col("seq") % 4 == 0, "middle": F.col("seq") % 10 == 1}).filter("loose or middle")


@query
def gpx_waypoints(spark, sf):
    """Way points before and after a track come back as segments of their own."""
    mark = lambda tag: F.format_string(
        f'<{tag} lat="%.7f" lon="%.7f"><time>%s</time></{tag}>', "lat", "lon", documents.iso_time(F.col("t_us")))
    rows = _marks(spark, sf)
    middle = rows.groupBy("track_id").agg(F.expr("percentile_disc(0.5) within group (order by seq)").alias("half"))
    rows = rows.join(middle, "track_id")
    place = lambda keep, tag: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(keep, F.struct("seq", mark(tag).alias("x"))))), lambda p: p["x"]), "")
    early, late = F.col("loose") & (F.col("seq") <= F.col("half")), F.col("loose") & (F.col("seq") > F.col("half"))
    texts = rows.groupBy("track_id").agg(
        place(early, "wpt").alias("a"), place(F.col("middle"), "trkpt").alias("b"), place(late, "wpt").alias("c"))
    files = texts.select("track_id", F.lit("gpx").alias("type"), F.concat(
        F.lit("<gpx><!-- <wpt/> -->"), "a", F.lit("<trk><trkseg>"), "b", F.lit("</trkseg></trk>"), "c",
        F.lit("</gpx>")).alias("text"))
    return fixes_of(parse_tracks(files), ["track_id"]).select("track_id", "segment_no", "seq", "t_us", "lat", "lon")


@query
def kml_roundtrip(spark, sf):
    """A KML track per recording with one time too many, a track in a comment,
    and a stamped placemark on either side."""
    f = fixes(spark, sf)
    when = F.concat(F.lit("<when>"), documents.iso_time(F.col("t_us")), F.lit("</when>"))
    coord = F.format_string("<gx:coord>%.7f %.7f</gx:coord>", "lon", "lat")
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("seq", x.alias("x")))), lambda p: p["x"]), "")
    stamp = lambda us: F.concat(
        F.lit("<Placemark><TimeStamp><when>"), documents.iso_time(us),
        F.lit("</when></TimeStamp><Point><coordinates>1.5,2.5</coordinates></Point></Placemark>"))
    texts = f.groupBy("track_id").agg(
        ordered(when).alias("w"), ordered(coord).alias("c"), F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    files = texts.select("track_id", F.lit("kml").alias("type"), F.concat(
        F.lit('<kml xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>'), stamp(F.col("lo") - 1_000_000),
        F.lit("<!-- <gx:Track>"), "w", "c", F.lit("</gx:Track> --><Placemark><gx:Track>"), "w",
        F.lit("<when>2026-01-01T00:00:00Z</when>"), "c", F.lit("</gx:Track></Placemark>"),
        stamp(F.col("hi") + 1_000_000), F.lit("</Document></kml>")).alias("text"))
    return fixes_of(parse_tracks(files), ["track_id"]).select("track_id", "segment_no", "seq", "t_us", "lat", "lon")


# --- capture times and settings ----------------------------------------------


@query
def capture_instant(spark, sf):
    p = view(spark, sf, "photos")
    zone = "Europe/Berlin"
    file_times = (F.col("created_us"), F.col("modified_us"))
    return p.select(
        "photo_id",
        times.capture_us(F.col("exif_local"), F.col("exif_offset_s"), *file_times, zone, -1500)
        .alias("instant_us"),
        times.capture_local_us(F.col("exif_local"), *file_times, zone).alias("local_us"),
    )


@query
def merge_settings(spark, sf):
    s = view(spark, sf, "settings")
    one = catalog.merge_settings(
        s.filter("device = 0").drop("device"),
        s.filter("device = 1").drop("device"), ["subject_id", "skey"],
    )
    return one.select("subject_id", "skey", "svalue", "changed_us")


@query
def resolve_params(spark, sf):
    s = view(spark, sf, "settings")
    last = s.groupBy("subject_id", "skey").agg(F.max("svalue").alias("v"))
    shared = last.select(
        "subject_id",
        F.when(F.col("skey") == "click", "toleranceMinutes").when(F.col("skey") == "view", "clockOffsetMinutes")
        .otherwise(F.col("skey")).alias("skey"),
        F.when(F.col("v") % 4 == 0, F.concat(F.col("v").cast("string"), F.lit("x")))
        .otherwise(F.col("v").cast("string")).alias("svalue"),
    )
    subjects = s.select("subject_id").distinct().select(
        "subject_id",
        F.when(F.col("subject_id") % 3 == 0, F.lit(5).cast("long")).alias("tolerance_min"),
        F.when(F.col("subject_id") % 5 == 0, F.lit(-1.25)).alias("clock_offset_min"),
    )
    return placement.resolve_params(subjects, shared)


# --- cards and imports -------------------------------------------------------


@query
def camera_key(spark, sf):
    parts = [F.col(c) for c in ("make", "model", "serial")]
    return view(spark, sf, "cameras").select(
        "camera_id", names.camera_key(*parts).alias("camera_key"), names.camera_label(*parts).alias("camera_label")
    )


@query
def camera_order(spark, sf):
    ordered = catalog.camera_order(view(spark, sf, "card_files"), ["card_id"])
    return ordered.select("card_id", "file_id", "name", "rank")


def _two_states(spark, sf):
    s = view(spark, sf, "import_states")
    return s.filter("device = 0"), s.filter("device = 1")


@query
def is_later(spark, sf):
    a, b = _two_states(spark, sf)
    pairs = a.select("camera_id", F.col("last_file").alias("fa")).join(
        b.select("camera_id", F.col("last_file").alias("fb")), "camera_id")
    return pairs.select("camera_id", "fa", "fb", names.is_later(F.col("fa"), F.col("fb")).alias("later"))


@query
def merge_import_state(spark, sf):
    return catalog.merge_import_state(*_two_states(spark, sf), key="camera_id")


@query
def merge_device_states(spark, sf):
    """Every order is the state some device has of its customer's camera."""
    o = table(spark, sf, "orders")
    return catalog.fold_states(o.select(
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("camera_id"),
        F.concat(F.lit("DSCF"), F.lpad(((F.col("o_orderkey") * 7919) % 10000).cast("string"), 4, "0"), F.lit(".RAF")).alias("last_file"),
        (F.col("o_orderkey") % 40).alias("import_no"), (F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at_us"),
        F.col("o_orderkey").alias("device"), F.col("o_orderkey").alias("turn")), key="camera_id")


@query
def merge_device_settings(spark, sf):
    """Every event is a change that some device made to a setting of its user."""
    e = table(spark, sf, "events")
    days = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    return catalog.merge_all_settings(e.select(
        F.col("user_id").alias("subject_id"), F.col("event_type").alias("skey"), F.col("event_id").alias("svalue"),
        days.alias("changed_us"), F.col("event_id").alias("turn")), ["subject_id", "skey"])


def _name_points(files):
    hit = (F.col("file_id") % 5 == 0) & F.col("name").startswith("DSCF") & (F.col("card_id") % 7 != 0)
    return files.groupBy("card_id").agg(
        F.min_by(F.lower("name"), F.when(hit, F.col("file_id"))).alias("after_name")
    ).withColumn("after_us", F.lit(None).cast("long"))


@query
def filter_new_by_name(spark, sf):
    files = view(spark, sf, "card_files")
    new = catalog.filter_new(files, _name_points(files), ["card_id"])
    return new.select("card_id", "file_id", "name", "rank", "placed")


@query
def filter_new_by_time(spark, sf):
    files = view(spark, sf, "card_files")
    points = files.groupBy("card_id").agg(
        F.max(F.when(F.col("file_id") % 5 == 0, F.col("local_us"))).alias("x"),
        F.min("local_us").alias("lo"), F.max("local_us").alias("hi"),
    ).select(
        "card_id", F.lit(None).cast("string").alias("after_name"),
        F.expr("case when card_id % 2 = 0 then x else lo + (hi - lo) div 3 end").alias("after_us"),
    )
    new = catalog.filter_new(files, points, ["card_id"])
    return new.select("card_id", "file_id", "name", "rank", "placed")


@query
def camera_of(spark, sf):
    files = view(spark, sf, "card_files")
    named = files.withColumn("camera_id", F.when(F.col("file_id") % 3 == 0, F.col("file_id") % 140))
    return catalog.camera_of(named, ["card_id"], cameras=view(spark, sf, "cameras"))


def _states_by_camera(spark, sf):
    states = view(spark, sf, "import_states")
    known = F.col("camera_id") != 11
    return states.join(view(spark, sf, "cameras"), "camera_id").select(
        (F.col("camera_id") * 2 + F.col("device")).alias("state_order"),
        *[F.when(known, F.col(c)).alias(c) for c in ("make", "model", "serial")], "last_file", "import_no",
    )


@query
def state_for_camera(spark, sf):
    lost = F.col("camera_id") % 50 == 0
    cards = view(spark, sf, "cameras").select(
        F.col("camera_id").alias("card_id"),
        F.when(~lost, F.when(F.col("camera_id") % 7 == 0, F.lower("make")).otherwise(F.col("make"))).alias("make"),
        F.when(~lost, F.col("model")).alias("model"),
        F.when(~lost & (F.col("camera_id") % 5 != 0), F.col("serial")).alias("serial"),
    )
    found = catalog.state_for_camera(cards, _states_by_camera(spark, sf))
    return found.select("card_id", "state_state_order", "state_last_file")


def _imported(spark, sf):
    """Cards as import folders, eight to a place; two cameras wrote a place's cards."""
    files = view(spark, sf, "card_files")
    camera = F.expr("(card_id div 8) % 150") + F.when(F.col("card_id") % 3 == 1, 2).otherwise(1)
    named = files.withColumn("camera_id", F.when(F.col("card_id") % 3 != 0, camera))
    return named.withColumn("import_no", F.col("card_id") % 8).withColumn("card_id", F.expr("card_id div 8"))


@query
def local_watermark(spark, sf):
    places = view(spark, sf, "card_files").select(F.expr("card_id div 8").alias("place")).distinct()
    mine = places.withColumn("camera_id", F.col("place") % 150 + 1).join(
        view(spark, sf, "cameras"), "camera_id").select(F.col("place").alias("card_id"), "make", "model", "serial")
    return catalog.local_watermark(_imported(spark, sf), mine, cameras=view(spark, sf, "cameras"))


@query
def resume_point(spark, sf):
    files = view(spark, sf, "card_files")
    local = catalog.last_import_of(files.filter("file_id % 3 = 0 and card_id % 5 <> 0"), ["card_id"])
    states = files.filter("file_id % 4 = 1").groupBy("card_id").agg(
        F.min_by("name", "file_id").alias("state_last_file"))
    # Every sixth card's shared file is not on it.
    states = states.withColumn(
        "state_last_file",
        F.when(F.col("card_id") % 6 == 0, "DSCF9000.RAF").otherwise(F.lower("state_last_file")),
    )
    shared = catalog.shared_watermark(files, states)
    cards = files.select("card_id").distinct()
    given = cards.filter("card_id % 9 = 0").select(
        "card_id", F.lit("DSCF9999.JPG").alias("start_name"),
        F.when(F.col("card_id") % 18 == 0, F.lit(0).cast("long")).alias("start_us"),
    )
    return catalog.resume_point(cards, local.withColumnRenamed("last_file", "local_file"), shared, given)


@query
def next_import_no(spark, sf):
    folders = view(spark, sf, "card_files").select(
        F.expr("card_id div 5").alias("place"),
        F.when(F.col("card_id") % 5 == 0, "Import x").otherwise(
            names.import_name(F.col("card_id"))).alias("folder"),
    ).distinct()
    states = view(spark, sf, "import_states").select(F.expr("camera_id div 5").alias("place"), "import_no")
    return catalog.next_import_no(folders, states, ["place"])


@query
def last_import_of(spark, sf):
    return catalog.last_import_of(view(spark, sf, "card_files").filter("file_id % 3 = 0"), ["card_id"])


@query
def pair_copies(spark, sf):
    plan = view(spark, sf, "card_files").select(
        (F.col("card_id") % 3).alias("place"), F.col("file_id").alias("entry_id"), "name",
        (F.col("file_id") % 11 != 0).alias("selected"),
    )
    return catalog.pair_copies(plan, ["place"]).select("place", "entry_id", "copied")


# --- readers, narrow choices, settings in text -------------------------------


def _stamps(spark, sf):
    """Times of all events as track files write them: in UTC, with an offset,
    without a zone, with a fraction, and as no time at all."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = lambda form: F.date_format("ts", form)
    form = F.col("event_id") % 5
    return e.select("event_id", F.when(form == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
                    .when(form == 1, text("yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
                    .when(form == 2, text("  yyyy-MM-dd'T'HH:mm:ss"))
                    .when(form == 3, text("yyyy-MM-dd'T'HH:mm:ss'.250-05:30'"))
                    .otherwise(text("dd.MM.yyyy HH:mm")).alias("text"))


@query
def track_times(spark, sf):
    s = _stamps(spark, sf)
    return s.select("event_id", F.unix_micros(times.parse_track_time(F.col("text"), "Asia/Tokyo")).alias("t_us"))


@query
def track_problems(spark, sf):
    """Orders as track files, most of them broken in one way or another."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("track_id"))
    point = '<wpt lat="1" lon="2"><time>2026-07-17T10:00:00Z</time></wpt>'
    kind = F.col("track_id") % 6
    text = (
        F.when(kind == 0, f"<gpx>{point}</gpx>").when(kind == 1, f"<!-- x --><!doctype gpx><gpx>{point}</gpx>")
        .when(kind == 2, f"<gpx>{point}").when(kind == 3, "<html/>")
        .when(kind == 4, '<gpx><wpt lat="1" lon="2"/></gpx>').otherwise(f"<kml><!-- {point} --></kml>"))
    return parse_tracks(o.withColumn("text", text)).select("track_id", "problem", F.size("points").alias("segments").cast("long"))


@query
def type_lists(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat_ws(
        ",", F.lit(" .JPG"), F.concat(F.lit(" ."), F.substring("c_mktsegment", 1, 3)), F.lit(""),
        F.concat(F.lit("x"), (F.col("c_custkey") % 3).cast("string"), F.lit(" ")), F.lit("jpg"))
    return c.select("c_custkey", F.array_join(names.parse_types(text), "|").alias("types"))


@query
def syncable_names(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, "\n").when(F.col("p_partkey") % 7 == 1, "\tx").otherwise(""))
    name = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(name)
    return p.select("p_partkey", names.is_syncable(name).alias("syncable"))


def _named_tracks(spark, sf):
    return fixes(spark, sf).groupBy("track_id").agg(F.count(F.lit(1)).alias("fixes")).withColumn(
        "name", F.concat(F.lit("walk "), (F.col("track_id") % 40).cast("string")))


@query
def narrow_tracks(spark, sf):
    named = _named_tracks(spark, sf)
    picked = named.filter("track_id % 9 = 0").select("name").unionByName(
        named.filter("track_id % 9 = 1").select(F.concat("name", F.lit(" gone")).alias("name")))
    chosen = select.narrow_tracks(named, picked).withColumn("picked", F.lit(True))
    every = select.narrow_tracks(named, picked.filter(F.col("name").isNull())).withColumn("picked", F.lit(False))
    return chosen.unionByName(every)


@query
def merged_tracks(spark, sf):
    f = fixes(spark, sf)
    merged = stats.merge_tracks(f.filter("track_id % 2 = 1"), f.filter("track_id % 2 = 0"))
    return stats.numbered_segments(merged, ["subject_id"]).select(
        "subject_id", "track_id", "segment_no", "seq", F.col("part").cast("long").alias("part"))


@query
def explain_fixes(spark, sf):
    """The removals among every third fix of a track, by time."""
    f = fixes(spark, sf)
    found = cleanup.explain_fix(cleanup.notes(cleanup.judge(f)), f.filter("seq % 3 = 0"))
    return rounded(found.select("track_id", "segment_no", "seq", "t_us", "out_m").orderBy("t_us"), 3, "out_m")


@query
def delivered_fixes(spark, sf):
    d = view(spark, sf, "deliveries")
    raw = d.withColumns({
        "time_us": F.col("now_us") - F.col("age_ms") * 1000, "lat": F.lit(46.5), "lon": F.lit(7.5),
        "msl_altitude": F.when(F.col("delivery_id") % 3 != 0, F.col("delivery_id") % 900),
        "msl_accuracy": F.col("delivery_id") % 17, "speed": F.when(F.col("delivery_id") % 2 == 0, F.lit(1.5)),
    })
    return recorder.to_fix(raw).drop("lat", "lon", "now_us")


def _flip(plan):
    plan = placement.with_type(plan, "MOV", True)
    plan = placement.with_type(plan, "raf", False)
    return plan


@query
def plan_flips(spark, sf):
    placed = placement.finish_plan(locate(_shots(spark, sf), fixes(spark, sf), PLACE_MS), ["mov", "jpg"])
    return _flip(placed).select("photo_id", "type", "selected", "wide_gap")


@query
def plan_file_flips(spark, sf):
    """Every eleventh file picked or left out by hand, whatever its type."""
    shots = _shots(spark, sf)
    placed = placement.finish_plan(locate(shots, fixes(spark, sf), PLACE_MS), ["mov"])
    picks = shots.filter("photo_id % 11 = 0").select("photo_id", (F.col("photo_id") % 2 == 0).alias("selected"))
    return placement.with_files(placed, picks).select("photo_id", "type", "selected", "wide_gap")


def _raw_states(spark, sf):
    """Resume states as text, with fields missing, empty or unreadable."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(
        F.when(key % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("M"), (key % 90).cast("string"))).alias("make"),
        F.when(key % 4 == 0, F.lit(None)).otherwise("X").alias("model"), F.lit(None).cast("string").alias("serial"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("F"), key.cast("string"))).alias("last_file"),
        F.when(key % 7 == 0, "x7").otherwise((key % 30).cast("string")).alias("import_no"),
        F.when(key % 9 == 0, "yesterday").otherwise(text).alias("imported_at"),
        F.when(key % 2 == 0, "pc").alias("device"))


@query
def usable_states(spark, sf):
    return files.usable_import_state(_raw_states(spark, sf)).select(
        "camera_key", "last_file", "import_no", "at_us", "device")


@query
def usable_settings(spark, sf):
    s = view(spark, sf, "settings")
    raw = s.select(
        "subject_id", F.concat_ws("_", "skey", "device").alias("skey"), F.col("svalue").cast("string").alias("svalue"),
        F.when(F.col("svalue") % 3 == 0, "soon").otherwise(
            F.date_format(F.timestamp_seconds(F.col("changed_us") * 86400), "yyyy-MM-dd HH:mm:ss")).alias("changed_at"))
    return files.usable_settings(raw)


# --- manifests ---------------------------------------------------------------


def _sides(spark, sf):
    m = view(spark, sf, "manifests").withColumn("folder_id", F.lit(0).cast("long"))
    side = lambda s, *c: m.filter(F.col("side") == s).select("folder_id", F.col("fname").alias("name"), *c)
    return (
        side("local", "digest"),
        side("remote", "remote_id", "digest", F.col("remote_id").alias("created")),
        side("index", "remote_id", "digest"),
        side("deleted"),
    )


@query
def sync_plan(spark, sf):
    local, remote, index, deleted = _sides(spark, sf)
    skip = local.filter(F.col("name").endswith("77.gpx"))
    plan = manifest.sync_plan(local, remote, index, deleted, ["folder_id"], manifest.KEEP_BOTH, skip)
    return _plan_columns(plan)


@query
def sync_plan_merge(spark, sf):
    return _plan_columns(manifest.sync_plan(*_sides(spark, sf), ["folder_id"], manifest.MERGE))


def _contents(spark, sf, local, columns):
    """Two rows of a state file for each part, as they are on one side."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    rows = p.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.concat(F.lit("p"), F.col("k").cast("string"), F.lit(".gpx"))
    return rows.select(F.lit(0).cast("long").alias("folder_id"), name.alias("name"), *columns(local))


@query
def sync_merged_settings(spark, sf):
    def columns(local):
        return [
            F.col("i").cast("string").alias("skey"), (F.col("k") * (2 if local else 3) + F.col("i")).alias("svalue"),
            ((F.col("k") + F.col("i")) % (5 if local else 4)).alias("changed_us")]

    plan = manifest.sync_plan(*_sides(spark, sf), ["folder_id"], manifest.MERGE)
    merged = manifest.merge_files(
        plan, _contents(spark, sf, True, columns), _contents(spark, sf, False, columns), ["folder_id"],
        lambda a, b, keys: catalog.merge_settings(a, b, [*keys, "skey"]))
    return merged.drop("folder_id")


@query
def sync_merged_states(spark, sf):
    def columns(local):
        at = F.col("k") * 7 + F.col("i") + (0 if local else 1) * (F.col("k") % 3 - 1)
        return [
            F.when(F.col("i") == 1, "F_X").alias("camera_key"),
            F.concat(F.lit("DSCF"), F.lpad((at % 10000).cast("string"), 4, "0"), F.lit(".RAF")).alias("last_file"),
            (F.col("k") % (40 if local else 37)).alias("import_no"),
            (F.col("k") % (5 if local else 4)).alias("at_us"), F.lit("l" if local else "r").alias("device")]

    plan = manifest.sync_plan(*_sides(spark, sf), ["folder_id"], manifest.MERGE)
    merged = manifest.merge_files(
        plan, _contents(spark, sf, True, columns), _contents(spark, sf, False, columns), ["folder_id"],
        lambda a, b, keys: catalog.merge_import_state(a, b, [*keys, "camera_key"]))
    return merged.drop("folder_id")


@query
def sync_again(spark, sf):
    """State files of both sides as written, synced and merged; what a second sync
    of the merged files would still do (nothing), with their digests."""
    def columns(local):
        at = F.col("k") * 7 + F.col("i") + (0 if local else 1) * (F.col("k") % 3 - 1)
        return [
            F.when(F.col("i") == 1, "F_X").alias("camera_key"),
            F.concat(F.lit("DSCF"), F.lpad((at % 10000).cast("string"), 4, "0"), F.lit(".RAF")).alias("last_file"),
            (F.col("k") % (40 if local else 37)).alias("import_no"),
            (F.col("k") % 5).alias("at_us"), F.lit("l\t" if local else "r").alias("device")]

    by = ["folder_id", "name"]
    here, there = (_contents(spark, sf, local, columns) for local in (True, False))
    written = lambda rows: checkpoint(states.state_documents(rows, by))
    remote_of = lambda rows: rows.select(
        *by, F.xxhash64("name").alias("remote_id"), "digest", F.lit(0).cast("long").alias("created"))
    local, remote = written(here), remote_of(written(there))
    none = remote.limit(0)
    plan = manifest.sync_plan(local.select(*by, "digest"), remote, none, none.select(*by), ["folder_id"], manifest.MERGE)
    merged = written(manifest.merge_files(
        plan, here, there, ["folder_id"], lambda a, b, keys: catalog.merge_import_state(a, b, [*keys, "camera_key"])))
    after = remote_of(merged)
    again = manifest.sync_plan(
        merged.select(*by, "digest"), after, after, none.select(*by), ["folder_id"], manifest.MERGE)
    left = again.groupBy(*by).agg(F.count(F.lit(1)).alias("left"))
    return merged.join(left, by, "left").select("name", "digest", F.coalesce("left", F.lit(0)).alias("left"))


def _plan_columns(plan):
    return plan.select(
        "folder_id", "phase", "name", "action_no", "action", "target", "remote_id", "digest"
    ).withColumns({"phase": F.col("phase").cast("long"), "action_no": F.col("action_no").cast("long")})


@query
def sync_report(spark, sf):
    return manifest.sync_report(
        manifest.sync_plan(*_sides(spark, sf), ["folder_id"]), ["folder_id"]
    )


def _clashing(spark, sf):
    # A folder per 500 parts; 60 names each, which its remote files share by remainder.
    p = table(spark, sf, "part").withColumn("folder_id", F.expr("p_partkey div 500"))
    name = lambda k, tail=".gpx": F.concat_ws(
        "", F.lit("p"), F.col("folder_id").cast("string"), F.lit("_"), k.cast("string"), F.lit(tail))
    key = F.col("p_partkey") % 500
    remote = p.select("folder_id", name(key % 60).alias("name"), F.col("p_partkey").alias("remote_id"),
                      F.md5("p_name").alias("digest"), F.col("p_partkey").alias("created"))
    few = p.filter("p_partkey % 500 < 60")
    local = few.select("folder_id", name(key).alias("name"), F.md5("p_name").alias("digest")).unionByName(
        few.filter("p_partkey % 5 = 0").select(
            "folder_id", F.concat(name(key, " ("), (key % 4 + 2).cast("string"), F.lit(").gpx")).alias("name"),
            F.md5("p_brand").alias("digest")))
    index = few.filter("p_partkey % 3 = 0").select(
        "folder_id", name(key).alias("name"), (F.col("p_partkey") + 60).alias("remote_id"),
        F.md5(F.concat("p_name", F.when(key % 2 == 0, "x").otherwise(""))).alias("digest"))
    return remote, local, index, local.select("folder_id", "name").limit(0)


@query
def dedupe_remote(spark, sf):
    out = manifest.dedupe_remote(*_clashing(spark, sf), ["folder_id"])
    return out.select("remote_id", "name", "goes_by", "follows")


@query
def free_names(spark, sf):
    remote, local, _, _ = _clashing(spark, sf)
    asked = remote.select("folder_id", "name", "created")
    return manifest.free_names(asked, local.select("folder_id", "name"), ["folder_id"], ["created"]).select(
        "name", "created", "free_name"
    )


# --- recorder and map --------------------------------------------------------


@query
def admit_fixes(spark, sf):
    return recorder.admit_fixes(view(spark, sf, "deliveries"), 30_000).select(
        "device", "run", "delivery_id", "outcome"
    )


@query
def recording_status(spark, sf):
    return recorder.recording_status(recorder.admit_fixes(view(spark, sf, "deliveries")))


def _drained(stream, folder, name):
    """Works off what has arrived, then ends."""
    running = stream.option("checkpointLocation", f"{folder}/{name}-progress").trigger(availableNow=True).start()
    running.awaitTermination()


def _in_stretches(rows, clock, parts):
    """The rows in stretches of time, as a feed brings them."""
    low, high = rows.agg(F.min(clock), F.max(clock)).first()
    for k in range(parts):
        begin = low + (high - low + 1) * k // parts
        end = low + (high - low + 1) * (k + 1) // parts
        yield rows.filter((F.col(clock) >= begin) & (F.col(clock) < end))


@query
def admit_stream(spark, sf):
    """The deliveries as files of a folder, in three stretches of time, drained
    by the stream each time one has arrived."""
    folder, d = shared_folder(spark, "deliveries"), view(spark, sf, "deliveries")
    if d.isEmpty():
        return recorder.admit_fixes(d, 30_000).select("device", "run", "delivery_id", "outcome")
    d.limit(0).write.parquet(f"{folder}/in")
    feed = spark.readStream.schema(d.schema).parquet(f"{folder}/in")
    admitted = recorder.admit_stream(feed, 30_000, idle_ms=None)
    for stretch in _in_stretches(d, "now_us", 3):
        stretch.write.mode("append").parquet(f"{folder}/in")
        _drained(admitted.writeStream.format("parquet").option("path", f"{folder}/out"), folder, "out")
    return spark.read.parquet(f"{folder}/out").select("device", "run", "delivery_id", "outcome")


@query
def live_track_stats(spark, sf):
    """Fixes in three stretches of time, every seventh of a stretch coming with
    the next one and every eleventh coming again."""
    folder, f = shared_folder(spark, "growing"), fixes(spark, sf).select(
        "track_id", "segment_no", "seq", "t_us", "lat", "lon")
    if f.isEmpty():
        return rounded(stats.track_stats(f).join(stats.track_distance(f), "track_id"), 3, "metres")
    # Numbered once; the stretches are read from there.
    f.write.parquet(f"{folder}/fixes")
    f = spark.read.parquet(f"{folder}/fixes")
    f.limit(0).write.parquet(f"{folder}/in")
    grown = live.live_track_stats(spark.readStream.schema(f.schema).parquet(f"{folder}/in"), interval_fixes=16)
    late = f.limit(0)
    for k, stretch in enumerate(_in_stretches(f, "t_us", 3)):
        held = (F.col("seq") % 7 == 0) if k < 2 else F.lit(False)
        arrived = stretch.filter(~held).unionByName(late)
        arrived.unionByName(stretch.filter(~held & (F.col("seq") % 11 == 0))).write.mode("append").parquet(f"{folder}/in")
        late = stretch.filter(held).unionByName(stretch.filter(~held & (F.col("seq") % 11 == 1)))
        _drained(grown.writeStream.format("parquet").option("path", f"{folder}/out"), folder, "out")
    return rounded(live.latest_stats(spark.read.parquet(f"{folder}/out")), 3, "metres")


@query
def recorded_elapsed(spark, sf):
    d = view(spark, sf, "deliveries")
    spans = d.groupBy("device", "run").agg(F.min("now_us").alias("a"), F.max("now_us").alias("b"))
    # Runs of a device are what lies between its pauses; a last open one ends now.
    open_run = spans.groupBy("device").agg(F.max("run").alias("run")).filter("device % 2 = 0")
    spans = spans.join(open_run.withColumn("open", F.lit(True)), ["device", "run"], "left")
    events = F.array(
        F.struct(F.lit("resume").alias("event"), F.col("a").alias("at_us")),
        F.struct(
            F.when(F.col("open"), "now").otherwise("pause").alias("event"),
            (F.col("b") + F.when(F.col("open"), 5_000_000).otherwise(0)).alias("at_us")),
    )
    runs = spans.select(F.col("device").alias("recording_id"), F.explode(events).alias("e"))
    return stats.recorded_elapsed(runs.select("recording_id", "e.event", "e.at_us"))


def _points(spark, sf):
    return fixes(spark, sf).select(
        "subject_id", (F.col("track_id") * 1_000_000 + F.col("seq")).alias("ord"),
        (F.col("lon") * 100_000).alias("x"), (F.col("lat") * 100_000).alias("y"),
    )


@query
def declutter_grid(spark, sf):
    out = declutter.declutter_grid(_points(spark, sf), SPACING, ["subject_id"])
    return out.select("subject_id", "ord", "count")


@query
def declutter_exact(spark, sf):
    out = declutter.declutter(_points(spark, sf), SPACING, ["subject_id"])
    return out.select("subject_id", "ord", "count")
