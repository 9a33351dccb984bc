"""Recorded tracks out of GPX and KML files, whole folders at a time.

A file is one row from reading to its last fix: segments are cut, sorted and
numbered in the row's own arrays, so ingest needs no shuffle. A file of more
than ``WHOLE_BYTES`` is read by byte ranges instead (``ranges``), with the same
fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackplace.functions.times import parse_track_time
from trackplace.session import checkpoint
from trackplace.sources import ranges
from trackplace.sources.listing import list_entries, with_size, with_text

# Name space of what a recorder says about its own fixes; files of other
# recorders are read by passing theirs.
EVIDENCE_NS = "urn:trackplace:fix-evidence:1"
# File types read.
TRACK_EXTENSIONS = ["gpx", "kml"]
# Largest file that is one row.
WHOLE_BYTES = 32 << 20
# What may stand before the root element, and what is no element inside it.
_PROLOG = r"^(?:\s++|<\?[\s\S]*?\?>|<!--[\s\S]*?-->)*"
_NO_ELEMENT = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>"
# Time of the way point that stands for a track or route between way points.
_BREAK = "|"

# Where a part of a track says how many segments and fixes came before it.
_PART = r'<[\w.-]+:part no="(\d+)" segment="(\d+)" seq="(\d+)"'

_EVIDENCE = "fe_acc string, fe_eleacc string, fe_speed string, fe_src string"
_POINT = f"struct<_lat:string, _lon:string, ele:string, time:string, extensions:struct<{_EVIDENCE.replace(' string', ':string')}>>"
_GPX = (
    f"trk array<struct<trkseg:array<struct<trkpt:array<{_POINT}>>>>>,"
    f" rte array<struct<rtept:array<{_POINT}>>>, wpt array<{_POINT}>, _corrupt_record string"
)
_FIX = (
    "array<struct<t_us:bigint, i:int, lat:double, lon:double, ele:double, accuracy:double,"
    " ele_accuracy:double, speed:double, source:string>>"
)


def track_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, type, size`` of the track files below a folder (or of one file)."""
    found = list_entries(spark, path).select("path", *_name_and_type(), "size")
    return found.filter(F.col("type").isin(TRACK_EXTENSIONS))


def _track_path(path: Column) -> Column:
    """The file a part belongs to, as ``write_gpx`` names parts."""
    return F.regexp_replace(path, r"\.part\d{5,}(\.[^./]*)$", "$1")


def _parsed_files(
    files: DataFrame, zone: str, evidence_ns: str, whole_bytes: int, range_bytes: int,
) -> tuple[DataFrame, DataFrame]:
    """``path, name, problem`` of each of ``files``, and their fixes by ``path``,
    which is the same for all parts of a track."""
    files = checkpoint(files)
    # Read and parsed once: filters on what parsing says would parse again, row by row.
    small = checkpoint(parse_tracks(
        with_text(files.filter(F.col("size") <= whole_bytes).select("path", "name")), zone, evidence_ns))
    small_fixes = fixes_of(small.filter(F.col("problem").isNull()), ["path"])
    said = small.select("path", "name", "problem")
    large = files.filter(F.col("size") > whole_bytes)
    if large.isEmpty():
        return said, small_fixes.withColumn("path", _track_path(F.col("path")))
    begun = checkpoint(ranges.begun_ranges(large, evidence_ns, _PART, range_bytes))
    fixes = checkpoint(ranges.ranged_fixes(begun, zone, _number, _coordinates))
    some = fixes.select(F.col("path").alias("_path")).distinct()
    of_large = begun.filter("range_no = 0").select("path", "problem").join(large.select("path", "name"), "path")
    of_large = of_large.join(some, F.col("path") == F.col("_path"), "left").select("path", "name", F.coalesce(
        "problem", F.when(F.col("_path").isNull(), "no timestamped points")).alias("problem"))
    fixes = small_fixes.unionByName(fixes)
    return said.unionByName(of_large), fixes.withColumn("path", _track_path(F.col("path")))


def _name_and_type() -> list[Column]:
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    return [
        F.regexp_replace(file, r"\.[^.]*$", "").alias("name"), F.lower(F.regexp_extract(file, r"\.([^.]+)$", 1)).alias("type")]


def parse_tracks(files: DataFrame, zone: str = "UTC", evidence_ns: str = EVIDENCE_NS) -> DataFrame:
    """Adds ``points`` (the file's segments, each sorted by time), ``part`` (where
    in its track a part begins, see ``gpx_documents``) and ``problem``, which says
    why a file is no track.

    Segments are tracks, then routes, then runs of loose way points: a track or
    route between two way points ends a run. In KML they are tracks, then runs of
    stamped placemarks.
    """
    text = F.regexp_replace(F.col("text"), "^﻿", "")
    files = files.withColumn("text", text)
    root = F.lower(F.regexp_extract(F.col("text"), _PROLOG + r"<(?:[\w.-]+:)?([\w.-]+)", 1))
    declared = F.upper(F.regexp_extract(F.col("text"), _PROLOG + r"<!([A-Za-z]+)", 1))
    gpx = F.from_xml(_mark_evidence(F.col("text"), evidence_ns), _GPX, {
        "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record",
        "ignoreSurroundingSpaces": "true",
    })
    well_formed = F.from_xml(
        F.col("text"), "_any string, _corrupt_record string",
        {"columnNameOfCorruptRecord": "_corrupt_record"},
    )
    files = files.withColumns({
        "root": root,
        "doctype": declared == "DOCTYPE",
    })
    ok = ~F.col("doctype")
    bare = F.regexp_replace("text", _NO_ELEMENT, "")
    between = rf"<((?:[\w.-]+:)?)(trk|rte)\b(?:[^>]*/>|[^>]*>[\s\S]*?</\1\2\s*>)"
    loose = F.from_xml(
        _mark_evidence(F.regexp_replace(bare, between, f"<wpt><time>{_BREAK}</time></wpt>"), evidence_ns),
        f"wpt array<{_POINT}>", {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "true"})
    number = lambda n: F.regexp_extract("text", _PART, n).cast("long")
    files = files.withColumns({
        "loose": F.when(ok & (F.col("root") == "gpx") & F.col("text").contains("wpt"), loose["wpt"]),
        "part": F.when(F.col("text").rlike(_PART), F.struct(
            number(1).alias("no"), number(2).alias("segment"), number(3).alias("seq"))),
        "gpx": F.when(ok & (F.col("root") == "gpx"), gpx),
        "kml": F.when(ok & (F.col("root") == "kml"), well_formed),
    })
    # One expression per document type, evaluated for files of that type only.
    broken = F.coalesce(F.col("gpx._corrupt_record"), F.col("kml._corrupt_record")).isNotNull()
    segments = F.when(F.col("root") == "gpx", _gpx_segments(F.col("gpx"), F.col("loose"), zone)).when(
        F.col("root") == "kml", _bound(bare, lambda text: _kml_segments(text, zone))
    )
    none = F.array().cast(f"array<{_FIX}>")
    files = files.withColumn("points", F.when(~F.col("doctype") & ~broken, segments).otherwise(none))
    files = files.withColumn("points", F.filter(F.coalesce("points", none), lambda s: F.size(s) > 0))
    problem = (
        F.when(F.col("doctype"), "declares a DOCTYPE")
        .when(~F.col("root").isin(TRACK_EXTENSIONS), F.concat(F.lit("unsupported root element "), "root"))
        .when(broken, "not well formed")
        .when(F.size("points") == 0, "no timestamped points")
    )
    return files.withColumn("problem", problem).drop("text", "root", "doctype", "gpx", "kml", "loose")


def _mark_evidence(text: Column, ns: str) -> Column:
    """Renames the elements of the evidence name space, whatever its prefix, so
    that elements of the same name elsewhere are not taken for them."""
    quoted = ns.replace(".", r"\.").replace("/", r"\/")
    prefix = F.regexp_extract(text, rf"xmlns:([\w.-]+)\s*=\s*[\"']{quoted}[\"']", 1)
    pattern = F.concat(F.lit(r"(<\/?)"), prefix, F.lit(r":(acc|eleacc|speed|src)\b"))
    return F.when(prefix != "", F.regexp_replace(text, pattern, F.lit("$1fe_$2"))).otherwise(text)


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _fix(zone: str):
    def build(p: Column, i: Column) -> Column:
        e = p["extensions"]
        return F.struct(
            F.unix_micros(parse_track_time(p["time"], zone)).alias("t_us"), i.alias("i"),
            _number(p["_lat"]).alias("lat"), _number(p["_lon"]).alias("lon"),
            _number(p["ele"]).alias("ele"), _number(e["fe_acc"]).alias("accuracy"),
            _number(e["fe_eleacc"]).alias("ele_accuracy"), _number(e["fe_speed"]).alias("speed"),
            F.nullif(F.trim(e["fe_src"]), F.lit("")).alias("source"),
        )

    return build


def _usable(points: Column) -> Column:
    return F.array_sort(F.filter(
        points, lambda p: p["t_us"].isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull()
    ))


def _runs(items: Column, is_break) -> Column:
    """The stretches of ``items`` between the elements that are breaks."""

    def cut(items: Column) -> Column:
        at = F.filter(F.transform(items, lambda x, i: F.when(is_break(x), i)), lambda i: i.isNotNull())
        return _bound(at, lambda at: F.transform(
            F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("b"), F.concat(at, F.array(F.size(items))).alias("e")),
            lambda x: F.slice(items, x["b"] + 2, x["e"] - x["b"] - 1)))

    return _bound(items, cut)


def _gpx_segments(doc: Column, loose: Column, zone: str) -> Column:
    none = F.array().cast(f"array<{_POINT}>")
    nothing = F.array().cast(f"array<array<{_POINT}>>")
    tracks = F.coalesce(F.flatten(F.transform(doc["trk"], lambda t: F.coalesce(
        F.transform(t["trkseg"], lambda s: F.coalesce(s["trkpt"], none)), nothing))), nothing)
    routes = F.coalesce(
        F.transform(doc["rte"], lambda r: F.coalesce(r["rtept"], none)), nothing)
    runs = _runs(F.coalesce(loose, none), lambda p: F.coalesce(p["time"] == _BREAK, F.lit(False)))
    return F.transform(
        F.concat(tracks, routes, runs), lambda s: _usable(F.transform(s, _fix(zone)))
    )


def _elements(text: Column, name: str) -> Column:
    """The contents of every element of that local name, in document order."""
    return F.regexp_extract_all(
        text, F.lit(rf"<(?:[\w.-]+:)?{name}\b(?:[^>]*?\/>|[^>]*>([\s\S]*?)<\/(?:[\w.-]+:)?{name}\s*>)"), F.lit(1)
    )


def _coordinates(text: Column, separator: str) -> Column:
    """lon, lat[, alt]; null with fewer than two numbers."""
    numbers = F.filter(
        F.transform(F.split(F.trim(text), separator), _number), lambda n: n.isNotNull()
    )
    return _bound(numbers, lambda n: F.when(F.size(n) >= 2, n))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used:
    functions in arrays are not spared what they repeat."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kml_fix(zone: str, time: Column, at: Column, i: Column) -> Column:
    """``at`` is read for each of its numbers, so it has to be a value by now."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.unix_micros(parse_track_time(time, zone)).alias("t_us"), i.alias("i"),
        F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"),
        F.get(at, F.lit(2)).alias("ele"), none.alias("accuracy"), none.alias("ele_accuracy"),
        none.alias("speed"), F.lit(None).cast("string").alias("source"),
    )


def _outermost_tracks(text: Column) -> Column:
    """The contents of every Track that is in no other one, those within it included."""
    tag = r"<\/?(?:[\w.-]+:)?Track\b"
    whole = rf"{tag}(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    # Text from a tag of a track to the next one.
    parts = F.regexp_extract_all(text, F.lit(rf"{whole}(?:[^<]++|(?!{tag})<)*+"), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        tag_alone = F.regexp_extract(part, f"^{whole}", 0)
        change = F.when(F.startswith(part, F.lit("</")), -1).when(F.endswith(tag_alone, F.lit("/>")), 0).otherwise(1)
        depth = F.greatest(state["depth"] + change, F.lit(0))
        ends = (state["depth"] > 0) & (depth == 0)
        body = F.when(depth == 0, F.lit("")).otherwise(F.concat(state["body"], part))
        return F.struct(
            depth.alias("depth"), body.alias("body"),
            F.when(ends, F.concat(state["done"], F.array(state["body"]))).otherwise(state["done"]).alias("done"))

    begin = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("body"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(parts, begin, step, lambda state: state["done"])


def _kml_segments(text: Column, zone: str) -> Column:
    """Each outermost track is a segment, and so is each run of stamped placemarks."""

    def track(body: Column) -> Column:
        pairs = F.arrays_zip(
            _elements(body, "when").alias("t"),
            F.transform(_elements(body, "coord"), lambda c: _coordinates(c, r"\s+")).alias("c"))
        return _usable(F.transform(pairs, lambda p, i: _kml_fix(zone, p["t"], p["c"], i)))

    def placemark(body: Column, i: Column) -> Column:
        stamp = F.get(_elements(F.get(_elements(body, "TimeStamp"), F.lit(0)), "when"), F.lit(0))
        point = F.get(_elements(body, "Point"), F.lit(0))
        at = _coordinates(F.get(_elements(point, "coordinates"), F.lit(0)), ",")
        return _bound(at, lambda a: _kml_fix(zone, stamp, a, i))

    tracks = F.transform(_outermost_tracks(text), track)
    # Placemarks with a track in them, and tracks outside of any, end a run.
    whole = F.regexp_extract_all(text, F.lit(
        r"<(?:[\w.-]+:)?(Placemark|Track)\b(?:[^>]*?\/>|[^>]*>[\s\S]*?<\/(?:[\w.-]+:)?\1\s*>)"), F.lit(0))
    numbered = F.transform(whole, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    runs = _runs(numbered, lambda p: p["x"].rlike(r"<(?:[\w.-]+:)?Track\b"))
    return F.concat(tracks, F.transform(runs, lambda run: _usable(F.transform(
        run, lambda p: placemark(p["x"], p["i"])))))


def fixes_of(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fix: ``segment_no`` from 0 and ``seq`` from 1 within the file,
    or within the track of which the file says that it is a part."""
    begun = lambda field: (
        F.coalesce(F.col("_part")[field], F.lit(0)) if "part" in parsed.columns else F.lit(0))
    numbered = F.flatten(F.transform(
        F.col("points"), lambda s, n: F.transform(s, lambda p: F.struct(n.alias("n"), p.alias("p")))
    ))
    part = [F.col("part").alias("_part")] if "part" in parsed.columns else []
    rows = parsed.select(*keys, *part, F.posexplode(numbered).alias("at", "e"))
    fields = ["t_us", "lat", "lon", "ele", "accuracy", "ele_accuracy", "speed", "source"]
    return rows.select(
        *keys, (F.col("e.n") + begun("segment")).cast("long").alias("segment_no"),
        (F.col("at") + 1 + begun("seq")).cast("long").alias("seq"),
        *[F.col(f"e.p.{f}").alias(f) for f in fields],
    )


def read_tracks(
    spark: SparkSession,
    named: list[str] = (),
    folder: str | None = None,
    zone: str = "UTC",
    evidence_ns: str = EVIDENCE_NS,
    whole_bytes: int = WHOLE_BYTES,
    range_bytes: int = ranges.RANGE_BYTES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tracks, fixes, quarantine)`` of files named one by one and of a folder.

    A named file is meant to be used: reading its fixes fails when it is no
    track. A file that was only found in the folder is set aside in
    ``quarantine`` with the reason. Named files are offered first, then the
    folder's by name.
    """
    files, fixes = None, None
    for from_, found in ((0, track_files_named(spark, list(named)) if named else None),
                         (1, track_files(spark, folder) if folder is not None else None)):
        if found is None:
            continue
        said, rows = _parsed_files(found, zone, evidence_ns, whole_bytes, range_bytes)
        said, rows = (x.withColumn("_from", F.lit(from_)) for x in (said, rows))
        files = said if files is None else files.unionByName(said)
        fixes = rows if fixes is None else fixes.unionByName(rows)
    files = files.withColumn("track_id", F.xxhash64("_from", _track_path(F.col("path"))))
    fixes = fixes.withColumn("track_id", F.xxhash64("_from", "path"))
    if named:
        # A named file that is no track has no fixes: one row of its own fails when fixes are read.
        fail = F.raise_error(F.concat(F.lit("Could not use "), "path", F.lit(": "), "problem")).cast("bigint")
        bad = files.filter((F.col("_from") == 0) & F.col("problem").isNotNull())
        fixes = fixes.unionByName(bad.select("path", "_from", fail.alias("track_id")), allowMissingColumns=True)
    good = files.filter((F.col("_from") == 0) | F.col("problem").isNull())
    # All parts of a track are one offer, that of the first.
    stem = F.regexp_replace("name", r"\.part\d{5,}$", "")
    tracks = good.select("track_id", stem.alias("name"), "path", F.struct("_from", "name", "path").alias("offer_order"))
    tracks = tracks.groupBy("track_id", "name").agg(F.min("path").alias("path"), F.min("offer_order").alias("offer_order"))
    quarantine = files.filter((F.col("_from") == 1) & F.col("problem").isNotNull())
    return tracks, fixes.select("track_id", *fixes.columns[1:-2]), quarantine.select("path", "problem")


def track_files_named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files named one by one, whatever their extension."""
    named = with_size(spark.createDataFrame([(p,) for p in paths], "path string"))
    return named.select("path", *_name_and_type(), "size")


def read_gpx(
    spark: SparkSession, path: str, zone: str = "UTC", evidence_ns: str = EVIDENCE_NS,
    whole_bytes: int = WHOLE_BYTES, range_bytes: int = ranges.RANGE_BYTES,
) -> DataFrame:
    """Fixes of all readable GPX files below ``path``. Files of more than
    ``whole_bytes`` are read by ranges of ``range_bytes``."""
    return _fixes_by_type(spark, path, "gpx", zone, evidence_ns, whole_bytes, range_bytes)


def read_kml(
    spark: SparkSession, path: str, zone: str = "UTC",
    whole_bytes: int = WHOLE_BYTES, range_bytes: int = ranges.RANGE_BYTES,
) -> DataFrame:
    """Fixes of all readable KML files below ``path``."""
    return _fixes_by_type(spark, path, "kml", zone, EVIDENCE_NS, whole_bytes, range_bytes)


def _fixes_by_type(spark, path, file_type, zone, evidence_ns, whole_bytes, range_bytes) -> DataFrame:
    files = track_files(spark, path).filter(F.col("type") == file_type)
    _, fixes = _parsed_files(files, zone, evidence_ns, whole_bytes, range_bytes)
    return fixes.select(F.xxhash64("path").alias("track_id"), *fixes.columns[1:])
