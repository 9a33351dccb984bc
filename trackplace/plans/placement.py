"""The import plan: select recordings, clean them, place the photos, route writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.functions import tags, times
from trackplace.functions.names import extension
from trackplace.operators import cleanup
from trackplace.operators.catalog import filter_new
from trackplace.operators.locate import locate
from trackplace.operators.select import choose_tracks, photo_range, track_spans, used_fixes
from trackplace.session import checkpoint

# Metres between two fixes that are worth a warning; defaults of settings.
WIDE_GAP_M = 500.0
DEFAULT_TOLERANCE_MIN = 30
DEFAULT_CLOCK_OFFSET_MIN = 0.0


def resolve_params(subjects: DataFrame, settings: DataFrame) -> DataFrame:
    """Tolerance and clock offset per subject: given, else the shared setting when
    it reads as a number, else the default. The offset is cut to milliseconds.

    ``subjects(subject_id, tolerance_min, clock_offset_min)``, both nullable;
    ``settings(subject_id, skey, svalue)``.
    """
    shared = settings.groupBy("subject_id").agg(
        *[
            F.max(F.when(F.col("skey") == key, F.trim(F.col("svalue").cast("string")))).alias(key)
            for key in ("toleranceMinutes", "clockOffsetMinutes")
        ]
    )
    whole = F.when(F.col("toleranceMinutes").rlike(r"^[+-]?\d+$"), F.col("toleranceMinutes"))
    minutes = F.coalesce(
        F.col("tolerance_min").cast("long"), whole.try_cast("long"),
        F.lit(DEFAULT_TOLERANCE_MIN).cast("long"),
    )
    offset = F.coalesce(
        F.col("clock_offset_min").cast("double"), F.col("clockOffsetMinutes").try_cast("double"),
        F.lit(DEFAULT_CLOCK_OFFSET_MIN),
    )
    return subjects.join(shared, "subject_id", "left").select(
        "subject_id",
        (minutes * 60_000).alias("tolerance_ms"),
        (offset * 60_000).cast("long").alias("clock_offset_ms"),
    )


def photo_plan(
    photos: DataFrame,
    fixes: DataFrame,
    tolerance_ms: int = 1_800_000,
    excluded_types: list[str] = (),
    built_in_only: bool = False,
    options: cleanup.CleanupOptions = cleanup.DEFAULTS,
    limit: int | None = None,
) -> DataFrame:
    """One row per photo: where it would be placed and what would write it.

    Nothing has side effects; previews and runs read the same frame.
    """
    choice = choose_tracks(track_spans(fixes), photo_range(photos), tolerance_ms)
    chosen = used_fixes(fixes, choice)
    # Placement reads the cleaned track more than once; cleaning runs once.
    cleaned = checkpoint(cleanup.clean(cleanup.judge(chosen, options, limit)))
    return finish_plan(locate(photos, cleaned, tolerance_ms, limit), excluded_types, built_in_only)


def import_plan(
    photos: DataFrame,
    fixes: DataFrame,
    params: DataFrame,
    resume: DataFrame,
    zone: str = "UTC",
    excluded_types: list[str] = (),
    built_in_only: bool = False,
    options: cleanup.CleanupOptions = cleanup.DEFAULTS,
    limit: int | None = None,
) -> DataFrame:
    """The whole import: what is new on each subject's card, when and where it was taken.

    ``photos``: ``photo_id, subject_id, name, exif_local, exif_offset_s,
    created_us, modified_us``; ``params`` as ``resolve_params`` gives them;
    ``resume``: at most one row per subject with ``after_name`` or ``after_us``
    (see ``filter_new``). Capture times are corrected by the subject's clock
    offset before anything is matched, recordings are chosen and photos placed
    with the subject's tolerance. Returns the new photos with ``rank`` in their
    card's numbering and the columns of ``photo_plan``.
    """
    default = lambda name, value: F.coalesce(F.col(name), F.lit(value).cast("long"))
    timed = photos.join(params, "subject_id", "left").withColumns({
        "tolerance_ms": default("tolerance_ms", DEFAULT_TOLERANCE_MIN * 60_000),
        "clock_offset_ms": default("clock_offset_ms", int(DEFAULT_CLOCK_OFFSET_MIN * 60_000)),
    })
    file_times = (F.col("created_us"), F.col("modified_us"))
    timed = timed.withColumns({
        "t_us": times.capture_us(
            F.col("exif_local"), F.col("exif_offset_s"), *file_times, zone, F.col("clock_offset_ms")),
        "local_us": times.capture_local_us(F.col("exif_local"), *file_times, zone),
    })
    # Read by the range, by the selection and by the placement.
    new = checkpoint(filter_new(timed, resume, ["subject_id"], "photo_id", limit).select(
        "photo_id", "subject_id", "name", "t_us", "local_us", "rank", "tolerance_ms"))
    ranges = photo_range(new).join(
        new.groupBy("subject_id").agg(F.max("tolerance_ms").alias("tolerance_ms")), "subject_id")
    choice = choose_tracks(track_spans(fixes), ranges, F.col("tolerance_ms"))
    cleaned = checkpoint(cleanup.clean(cleanup.judge(used_fixes(fixes, choice), options, limit)))
    placed = locate(new, cleaned, F.col("tolerance_ms"), limit)
    return finish_plan(placed, excluded_types, built_in_only)


def finish_plan(
    placed: DataFrame, excluded_types: list[str] = (), built_in_only: bool = False
) -> DataFrame:
    ext = extension(F.col("name"))
    selected = ~ext.isin(list(excluded_types)) if excluded_types else F.lit(True)
    return placed.withColumns({
        "type": ext,
        "selected": selected,
        "writer": F.when(F.col("placed").isNotNull(), tags.route_writer(ext, built_in_only)),
        "wide_gap": wide_gap(selected),
    })


def wide_gap(selected: Column) -> Column:
    return selected & (F.coalesce(F.col("gap_m"), F.lit(0.0)) >= WIDE_GAP_M)


def with_type(plan: DataFrame, file_type: str, selected: bool) -> DataFrame:
    """Every file of a type picked, or none."""
    return _picked(plan, F.col("type") == file_type.lower(), selected)


def with_file(plan: DataFrame, photo_id: int, selected: bool) -> DataFrame:
    return _picked(plan, F.col("photo_id") == photo_id, selected)


def with_files(plan: DataFrame, picks: DataFrame) -> DataFrame:
    """Files picked or left out one by one: ``picks(photo_id, selected)``, a row per file."""
    chosen = picks.select("photo_id", F.col("selected").alias("_pick"))
    joined = plan.join(chosen, "photo_id", "left").withColumn("selected", F.coalesce("_pick", "selected"))
    return joined.drop("_pick").withColumn("wide_gap", wide_gap(F.col("selected")))


def _picked(plan: DataFrame, which: Column, selected: bool) -> DataFrame:
    flag = F.when(which, F.lit(selected)).otherwise(F.col("selected"))
    return plan.withColumn("selected", flag).withColumn("wide_gap", wide_gap(F.col("selected")))


def plan_summary(plan: DataFrame, by: list[str] = ("subject_id",)) -> DataFrame:
    found = F.col("placed").isNotNull()
    return plan.groupBy(*by).agg(
        F.count_if("selected").alias("selected"),
        F.count_if(F.col("selected") & found).alias("will_geotag"),
        F.count_if(F.col("selected") & ~found).alias("without_fix"),
        F.count_if("wide_gap").alias("across_wide_gap"),
    )


def type_counts(plan: DataFrame) -> DataFrame:
    """File types on offer, most files first."""
    return plan.groupBy("type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("selected").alias("selected")
    ).orderBy(F.desc("total"), "type")


def describe_types(files: DataFrame, by: list[str]) -> DataFrame:
    """``12 RAF, 3 MOV`` per key."""
    counted = files.groupBy(*by, F.upper(extension(F.col("name"))).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # A handful of types per key, counted before they are gathered.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_t").alias("t"))))
    words = F.transform(ordered, lambda e: F.concat((-e["n"]).cast("string"), F.lit(" "), e["t"]))
    return counted.groupBy(*by).agg(F.array_join(words, ", ").alias("types"))


def geotag_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """How a batch of writes landed; ``outcome`` is embedded, sidecar, missing or failed."""
    per = {
        name: F.count_if(F.col("outcome") == value)
        for name, value in (
            ("embedded", "embedded"), ("sidecars", "sidecar"), ("missing", "missing"), ("failed", "failed")
        )
    }
    return outcomes.groupBy(*by).agg(
        *[c.alias(n) for n, c in per.items()],
        (per["embedded"] + per["sidecars"]).alias("written"),
        (per["missing"] + per["failed"]).alias("untagged"),
    )


def tag_table(plan: DataFrame) -> DataFrame:
    """Every position tag of every placed photo, so all writers write the same numbers."""
    lat, lon, ele = F.col("lat"), F.col("lon"), F.col("ele")
    return plan.filter(F.col("placed").isNotNull()).select(
        "subject_id", "photo_id", "name", "writer",
        tags.lat_ref(lat).alias("lat_ref"), tags.dms_rational(lat).alias("lat_dms"),
        tags.lon_ref(lon).alias("lon_ref"), tags.dms_rational(lon).alias("lon_dms"),
        tags.alt_ref(ele).alias("alt_ref"), tags.alt_rational(ele).alias("alt_rational"),
        tags.gps_date(F.col("fix_us")).alias("gps_date"),
        tags.gps_time(F.col("fix_us")).alias("gps_time"),
        tags.iso6709(lat, lon, ele).alias("iso6709"),
        tags.xmp_coord(lat, "N", "S").alias("xmp_lat"),
        tags.xmp_coord(lon, "E", "W").alias("xmp_lon"),
    )
