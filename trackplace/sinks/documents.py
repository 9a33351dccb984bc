"""GPX documents, position sidecars, map lines and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackplace.functions import tags
from trackplace.functions.names import stem
from trackplace.operators.manifest import free_names
from trackplace.operators.ordered import Keyed, Prev, Sum, row_count
from trackplace.operators.stats import SEGMENT, by_segment
from trackplace.session import checkpoint
from trackplace.sinks.folder import write_files
from trackplace.sources.tracks import EVIDENCE_NS


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _point_xml() -> Column:
    def tagged(name: str, form: str, value: Column) -> Column:
        text = F.format_string(f"<tp:{name}>{form}</tp:{name}>", value)
        return F.when(value.isNotNull(), text).otherwise("")

    source = F.when(
        F.col("source").isNotNull(), F.concat(F.lit("<tp:src>"), _escaped(F.col("source")), F.lit("</tp:src>"))
    ).otherwise("")
    evidence = F.concat(
        tagged("acc", "%.1f", F.col("accuracy")), tagged("eleacc", "%.1f", F.col("ele_accuracy")),
        tagged("speed", "%.2f", F.col("speed")), source,
    )
    return F.concat(
        F.format_string('   <trkpt lat="%.7f" lon="%.7f">\n', "lat", "lon"),
        F.when(F.col("ele").isNotNull(), F.format_string("    <ele>%.1f</ele>\n", "ele")).otherwise(""),
        F.lit("    <time>"), iso_time(F.col("t_us")), F.lit("</time>\n"),
        F.when(evidence != "", F.concat(F.lit("    <extensions>"), evidence, F.lit("</extensions>\n"))).otherwise(""),
        F.lit("   </trkpt>\n"),
    )


def iso_time(t_us: Column) -> Column:
    """An instant as text, with three or six decimals only where it has them."""
    time = F.timestamp_micros(t_us)
    form = lambda p: F.date_format(time, p)
    return (
        F.when(t_us % 1_000_000 == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(t_us % 1000 == 0, form("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def gpx_documents(
    fixes: DataFrame, names: DataFrame | None = None, part_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``track_id, part_no, document``: a GPX document per track.

    With ``part_rows``, a track of more fixes becomes several whole documents.
    Each says how many segments and fixes of the track came before it, so that
    ``fixes_of`` numbers them on and a segment cut at a part's edge is one again.
    """
    if "source" not in fixes.columns:
        fixes = fixes.withColumn("source", F.lit(None).cast("string"))
    if part_rows is None:
        placed = fixes.withColumns({
            "_at": F.struct("segment_no", "t_us", "seq"), "part_no": F.lit(0).cast("long")})
    else:
        order = ["segment_no", "t_us", "seq"]
        placed = Keyed(fixes, ["track_id"], limit).running(order, _at=row_count(), _was=Prev(F.col("segment_no")))
        begins = F.coalesce(F.col("_was") != F.col("segment_no"), F.lit(False))
        placed = placed.running(order, _segments=Sum(begins.cast("long"))).rows()
        placed = placed.withColumn("part_no", F.floor((F.col("_at") - 1) / part_rows))
    segments = placed.groupBy("track_id", "part_no", "segment_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_at", _point_xml().alias("xml")))), lambda p: p["xml"]
            ), "",
        ).alias("points")
    )
    break_ = "  </trkseg>\n  <trkseg>\n"
    documents = segments.groupBy("track_id", "part_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("segment_no", "points"))), lambda s: s["points"]
            ), break_,
        ).alias("body")
    )
    part = F.lit("")
    if part_rows is not None:
        begun = placed.groupBy("track_id", "part_no").agg(
            F.min("_segments").alias("_segment"), (F.min("_at") - 1).alias("_seq"))
        documents = documents.join(begun, ["track_id", "part_no"])
        part = F.format_string(
            ' <metadata><extensions><tp:part no="%d" segment="%d" seq="%d"/></extensions></metadata>\n',
            "part_no", "_segment", "_seq")
    if names is None:
        documents = documents.withColumn("name", F.col("track_id").cast("string"))
    else:
        documents = documents.join(names.select("track_id", "name"), "track_id", "left")
    # Fixed format: the elements of GPX 1.1.
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trackplace"'
        f' xmlns="http://www.topografix.com/GPX/1/1" xmlns:tp="{EVIDENCE_NS}">\n'
    )
    document = F.concat(
        F.lit(head), part, F.lit(" <trk>\n  <name>"), _escaped(F.coalesce("name", F.lit(""))), F.lit("</name>\n  <trkseg>\n"),
        F.col("body"), F.lit("  </trkseg>\n </trk>\n</gpx>\n"),
    )
    return documents.select("track_id", "part_no", document.alias("document"))


def write_gpx(
    fixes: DataFrame, folder: str, names: DataFrame | None = None, part_rows: int | None = None, replace: bool = True,
) -> None:
    """One file ``<name>.gpx`` per track in ``folder``, which ``read_gpx`` and
    ``read_tracks`` read back.

    Names are those of ``names``, else track numbers; what a file name cannot
    hold becomes ``_``, and tracks of one name get ``name (2)`` and so on. With
    ``part_rows``, a longer track is ``<name>.part00000.gpx`` and following,
    which the readers take for one track again. No file is seen before all are
    written; ``replace`` says whether files of the same name are replaced.
    """
    documents = gpx_documents(fixes, names, part_rows)
    tracks = fixes.select("track_id").distinct()
    if names is not None:
        tracks = tracks.join(names.select("track_id", "name"), "track_id", "left")
        named = F.coalesce("name", F.col("track_id").cast("string"))
    else:
        named = F.col("track_id").cast("string")
    safe = F.regexp_replace(F.regexp_replace(named, r"[\\/:*?\"<>|\x00-\x1F]", "_"), r"^\.", "_")
    tracks = checkpoint(tracks.select(
        "track_id", F.when(F.trim(safe) == "", "_").otherwise(safe).alias("name"), F.lit(0).alias("folder_id")))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("track_id"))
    turned = tracks.withColumn("_turn", turn)
    first, more = turned.filter("_turn = 1").drop("_turn"), turned.filter("_turn > 1").drop("_turn")
    more = free_names(more, first, ["folder_id"], ["track_id"], whole=True)
    stems = first.select("track_id", F.col("name").alias("stem")).unionByName(
        more.select("track_id", F.col("free_name").alias("stem")))
    part = F.lit("") if part_rows is None else F.format_string(".part%05d", "part_no")
    files = documents.join(stems, "track_id").select(F.concat("stem", part, F.lit(".gpx")).alias("file"), "document")
    write_files(files, folder, replace)


def sidecar_documents(plan: DataFrame) -> DataFrame:
    """``folder, file, document``: an XMP sidecar per shot. Files of the same
    stem (a RAW and its JPEG) share one."""
    lat, lon, ele = F.col("lat"), F.col("lon"), F.col("ele")

    def attribute(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'    exif:{name}="'), value, F.lit('"\n'))

    known = F.concat(
        attribute("GPSAltitude", tags.alt_rational(ele)), attribute("GPSAltitudeRef", tags.alt_ref(ele))
    )
    # Fixed format: the elements and attributes of an XMP packet.
    document = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/">\n'
              ' <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
              '  <rdf:Description rdf:about=""\n    xmlns:exif="http://ns.adobe.com/exif/1.0/"\n'),
        attribute("GPSVersionID", F.lit("2.3.0.0")),
        attribute("GPSLatitude", tags.xmp_coord(lat, "N", "S")),
        attribute("GPSLongitude", tags.xmp_coord(lon, "E", "W")),
        F.coalesce(known, F.lit("")),
        F.lit("  />\n </rdf:RDF>\n</x:xmpmeta>\n"),
    )
    # The first photo of a stem speaks for it.
    placed = plan.filter(F.col("placed").isNotNull()).withColumns({
        "file": F.concat(stem(F.col("name")), F.lit(".xmp")), "document": document,
    })
    return placed.groupBy("folder", "file").agg(
        F.min_by("document", F.struct("name", "photo_id")).alias("document")
    )


def track_lines(fixes: DataFrame, part_rows: int | None = None, limit: int | None = None) -> DataFrame:
    """One line per segment of two fixes or more, as ``points`` of (lon, lat).

    With ``part_rows``, a longer segment comes in parts that begin where the last
    one ended.
    """
    if part_rows is None:
        parts = fixes.withColumns({"_at": F.struct("t_us", "seq"), "part_no": F.lit(0).cast("long")})
        return _lines(parts)
    placed = by_segment(fixes, limit).running(["t_us", "seq"], _at=row_count()).rows()
    at = F.col("_at") - 1
    part = F.floor(at / part_rows)
    # The first fix of a later part also ends the one before.
    joint = (at > 0) & (at % part_rows == 0)
    parts = placed.withColumn(
        "part_no", F.explode(F.when(joint, F.array(part - 1, part)).otherwise(F.array(part)))
    )
    return _lines(parts)


def _lines(parts: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_at", "lon", "lat")))
    return (
        parts.groupBy(*SEGMENT, "part_no")
        .agg(F.count(F.lit(1)).alias("fixes"), ordered.alias("_o"))
        .filter(F.col("fixes") >= 2)
        .withColumn("points", F.transform("_o", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))))
        .drop("_o")
    )


def track_heads(fixes: DataFrame) -> DataFrame:
    """The last fix of each track."""
    last = F.max_by(F.struct("t_us", "lat", "lon"), F.struct("t_us", "segment_no", "seq"))
    return fixes.groupBy("track_id").agg(last.alias("h")).select("track_id", "h.*")


def write_plan(plan: DataFrame, path: str) -> None:
    """The plan as a table, for previews and runs to read alike."""
    plan.write.mode("overwrite").parquet(path)
