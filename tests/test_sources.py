"""Track files, listings and manifests read back from real files."""

import pytest
from pyspark.errors import PySparkException

from trackplace.operators import cleanup  # noqa: F401
from trackplace.sinks import documents
from trackplace.sources import files, tracks

NS = "urn:trackplace:fix-evidence:1"
GPX = '<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:tp="{ns}">{body}</gpx>'


def point(tag="trkpt", lat="46.9", lon="7.4", time="2026-07-17T10:00:00Z", inner=""):
    return f'<{tag} lat="{lat}" lon="{lon}"><time>{time}</time>{inner}</{tag}>'


def folder_of(tmp_path, **texts):
    for name, text in texts.items():
        stem, ext = name.rsplit("_", 1)
        (tmp_path / f"{stem}.{ext}").write_text(text, encoding="utf-8")
    return str(tmp_path)


def read(spark, tmp_path, zone="UTC", **texts):
    _, fixes, bad = tracks.read_tracks(spark, folder=folder_of(tmp_path, **texts), zone=zone)
    return [r.asDict() for r in fixes.orderBy("track_id", "seq").collect()], {
        r.path.rsplit("/", 1)[1]: r.problem for r in bad.collect()}


def test_segments_and_bad_points(spark, tmp_path):
    body = (
        "<trk><trkseg>" + point(time="2026-07-17T10:05:00Z", inner="<ele>501.5</ele>") + point(lat="46.8")
        + point(lat="x") + point(time="never") + point(time="") + "</trkseg><trkseg></trkseg><trkseg>"
        + point(time="2026-07-17T11:00:00+02:00") + "</trkseg></trk><rte>" + point("rtept") + "</rte>"
        + point("wpt", time="2026-07-17T12:00:00Z")
    )
    rows, bad = read(spark, tmp_path, day_gpx=GPX.format(ns=NS, body=body))
    assert not bad
    assert [(r["segment_no"], r["seq"], r["lat"], r["ele"]) for r in rows] == [
        (0, 1, 46.8, None), (0, 2, 46.9, 501.5), (1, 3, 46.9, None), (2, 4, 46.9, None), (3, 5, 46.9, None)]
    assert rows[2]["t_us"] == 1_784_278_800_000_000


def test_evidence_counts_only_in_its_name_space(spark, tmp_path):
    evidence = ("<speed>9</speed><extensions><tp:acc>4.5</tp:acc><tp:eleacc>12</tp:eleacc>"
                "<tp:speed>1.25</tp:speed><tp:src> gps </tp:src><o:acc xmlns:o='urn:other'>99</o:acc></extensions>")
    other = "<extensions><tp:acc>4.5</tp:acc><tp:src> </tp:src></extensions>"
    rows, _ = read(
        spark, tmp_path,
        a_gpx=GPX.format(ns=NS, body="<trk><trkseg>" + point(inner=evidence) + "</trkseg></trk>"),
        b_gpx=GPX.format(ns="urn:other", body="<trk><trkseg>" + point(inner=other) + "</trkseg></trk>"))
    got = sorted((r["accuracy"] or 0, r["ele_accuracy"], r["speed"], r["source"]) for r in rows)
    assert got == [(0, None, None, None), (4.5, 12.0, 1.25, "gps")]


def test_zoneless_times_are_read_in_the_zone(spark, tmp_path):
    body = "<trk><trkseg>" + point(time="2026-07-17T12:00:00") + "</trkseg></trk>"
    rows, _ = read(spark, tmp_path, zone="Europe/Berlin", a_gpx=GPX.format(ns=NS, body=body))
    assert rows[0]["t_us"] == 1_784_282_400_000_000


def test_kml_tracks_and_placemarks(spark, tmp_path):
    kml = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2">
    <Document><Placemark><gx:Track>
      <when>2026-07-17T10:01:00Z</when><when></when><when>2026-07-17T10:00:00Z</when><when>2026-07-17T10:09:00Z</when>
      <gx:coord>7.4 46.9 500</gx:coord><gx:coord>7.5 46.9</gx:coord><gx:coord>7.6 47.0</gx:coord>
    </gx:Track></Placemark>
    <Placemark><TimeStamp><when>2026-07-17T12:00:00Z</when></TimeStamp><Point><coordinates>7.7,46.1,20</coordinates></Point></Placemark>
    <Placemark><Point><coordinates>7.7,46.1,20</coordinates></Point></Placemark></Document></kml>"""
    rows, bad = read(spark, tmp_path, a_kml=kml)
    assert not bad
    assert [(r["segment_no"], r["lon"], r["lat"], r["ele"]) for r in rows] == [
        (0, 7.6, 47.0, None), (0, 7.4, 46.9, 500.0), (1, 7.7, 46.1, 20.0)]


def test_bad_files_are_set_aside_or_fail(spark, tmp_path):
    good = GPX.format(ns=NS, body="<trk><trkseg>" + point() + "</trkseg></trk>")
    rows, bad = read(
        spark, tmp_path, good_GPX=good, doctype_gpx="<!DOCTYPE gpx>" + good,
        cut_gpx=good[:-20], other_kml="<html/>", empty_gpx=GPX.format(ns=NS, body=""), note_txt=good)
    assert len(rows) == 1
    assert bad == {"doctype.gpx": "declares a DOCTYPE", "cut.gpx": "not well formed",
                   "other.kml": "unsupported root element html", "empty.gpx": "no timestamped points"}
    _, fixes, _ = tracks.read_tracks(spark, named=[str(tmp_path / "empty.gpx")])
    with pytest.raises(PySparkException, match="no timestamped points"):
        fixes.collect()
    tables = tracks.read_tracks(spark, named=[str(tmp_path / "good.GPX")], folder=str(tmp_path))
    assert [t.name for t in tables[0].orderBy("offer_order").collect()] == ["good", "good"]
    assert tables[1].count() == 2


def test_written_tracks_read_back(spark, tmp_path):
    schema = ("track_id long, segment_no long, seq long, t_us long, lat double, lon double, ele double,"
              " accuracy double, ele_accuracy double, speed double, source string")
    rows = [(7, i // 3, i + 1, i * 1_500_000, 46.0 + i / 1000, -7.25, None if i % 2 else 500.5,
             4.5 if i % 3 else None, None, 1.25, "a<b&c") for i in range(8)]
    df = spark.createDataFrame(rows, schema)
    out = str(tmp_path / "out")
    documents.write_gpx(df, out, spark.createDataFrame([(7, "x & y")], "track_id long, name string"))
    texts = [(p.name, p.read_text()) for p in (tmp_path / "out").iterdir()]
    assert len(texts) == 1 and texts[0][0] == "x & y.gpx" and "<name>x &amp; y</name>" in texts[0][1]
    parts = documents.gpx_documents(df, part_rows=3).orderBy("part_no").collect()
    assert [p.part_no for p in parts] == [0, 1, 2] and all(p.document.endswith("</gpx>\n") for p in parts)
    whole = documents.gpx_documents(df).selectExpr("track_id", "document as text", "'gpx' as type")
    back = tracks.fixes_of(tracks.parse_tracks(whole), ["track_id"])
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)
    for size in (1, 2, 3, 7):
        cut = documents.gpx_documents(df, part_rows=size).selectExpr("track_id", "document as text", "'gpx' as type")
        joined = tracks.fixes_of(tracks.parse_tracks(cut), ["track_id"])
        assert sorted(map(tuple, joined.select(*df.columns).collect())) == sorted(rows)


def test_runs_of_way_points_do_not_bridge_a_track(spark, tmp_path):
    at = lambda h, tag="wpt": point(tag, time=f"2026-07-17T{h:02}:00:00Z")
    body = (at(0) + at(1) + "<!-- " + at(2) + " --><trk><name>wpt</name><trkseg>" + at(5, "trkpt") + "</trkseg></trk>"
            + at(12) + "<rte/>" + at(13))
    rows, bad = read(spark, tmp_path, a_gpx=GPX.format(ns=NS, body=body))
    hours = lambda n: [r["t_us"] // 3_600_000_000 % 24 for r in rows if r["segment_no"] == n]
    assert not bad and [hours(n) for n in range(4)] == [[5], [0, 1], [12], [13]]


def test_what_kml_comments_out_is_no_track(spark, tmp_path):
    one = "<gx:Track><when>2026-07-17T{0}:00:00Z</when><gx:coord>7.4 46.9</gx:coord></gx:Track>"
    place = ("<Placemark><TimeStamp><when>2026-07-17T{0}:00:00Z</when></TimeStamp>"
             "<Point><coordinates>7.7,46.1</coordinates></Point></Placemark>")
    kml = ('<kml xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>' + place.format("06") + "<!-- " + one.format("01")
           + " --><description><![CDATA[" + one.format("02") + "]]></description><Placemark>" + one.format("09")
           + "</Placemark>" + place.format("12") + place.format("13") + "</Document></kml>")
    rows, bad = read(spark, tmp_path, a_kml=kml)
    assert not bad
    assert [(r["segment_no"], r["t_us"] // 3_600_000_000 % 24) for r in rows] == [(0, 9), (1, 6), (2, 12), (2, 13)]


def test_a_document_type_may_only_stand_before_the_root(spark, tmp_path):
    good = GPX.format(ns=NS, body="<!-- <!DOCTYPE x> --><trk><trkseg>" + point() + "</trkseg></trk>")
    late = "<!--" + " " * 9000 + "--><!doctype gpx>" + good
    rows, bad = read(spark, tmp_path, a_gpx=good, b_gpx=late)
    assert len(rows) == 1 and bad == {"b.gpx": "declares a DOCTYPE"}


def test_lines_come_in_joined_parts(spark):
    rows = [(1, 0, i, i * 1_000_000, 46.0 + i, 7.0) for i in range(7)] + [(1, 1, 9, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "track_id long, segment_no long, seq long, t_us long, lat double, lon double")
    lines = documents.track_lines(df, part_rows=3).orderBy("part_no").collect()
    assert [[p.lat - 46 for p in line.points] for line in lines] == [[0, 1, 2, 3], [3, 4, 5, 6]]


def test_card_and_manifest(spark, tmp_path):
    for name in ("100_FUJI/DSCF0001.RAF", "100_FUJI/thumb.ctg", "100_FUJI/_DSF0001.RAF", "100_FUJI/.x.jpg", "101CANON/a b.jpg", "misc/x.jpg", "top.jpg"):
        path = tmp_path / "card" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    card = files.list_card(spark, str(tmp_path / "card"))
    assert [(r.folder, r.name) for r in card.orderBy("folder", "name").collect()] == [
        ("100_FUJI", "DSCF0001.RAF"), ("100_FUJI", "_DSF0001.RAF"), ("101CANON", "a b.jpg")]
    assert files.list_card(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "card" / ".hidden").write_bytes(b"x")
    found = files.file_manifest(spark, str(tmp_path / "card"), r"\.jpg$").collect()
    assert [(r.name, r.digest) for r in found] == [("top.jpg", "9dd4e461268c8034f5c8564e155c67a6")]
    (tmp_path / "synced").mkdir()
    (tmp_path / "synced" / "_a.gpx").write_text(GPX.format(ns=NS, body="<trk><trkseg>" + point() + "</trkseg></trk>"))
    assert [r.name for r in files.file_manifest(spark, str(tmp_path / "synced")).collect()] == ["_a.gpx"]
    assert tracks.read_gpx(spark, str(tmp_path / "synced")).count() == 1


def test_photo_state_and_settings_tables(spark, tmp_path):
    photos = [(1, 1, "f", "a.jpg", "2026:07:17 12:00:00", "+02:00", None, None, "M", "X", None),
              (2, 1, "f", "b.jpg", "0000:00:00 00:00:00", "nonsense", "2026-07-17 10:00:00", "2026-07-17 09:00:00", None, None, None)]
    path = str(tmp_path / "photos")
    spark.createDataFrame(
        photos, "photo_id long, subject_id long, folder string, name string, exif_date string, exif_zone string,"
        " created string, modified string, make string, model string, serial string").write.parquet(path)
    got = files.read_photos(spark, path).orderBy("photo_id").collect()
    assert str(got[0].exif_local) == "2026-07-17 12:00:00" and got[0].exif_offset_s == 7200
    assert got[1].exif_local is None and got[1].exif_offset_s is None and got[1].modified_us == 1_784_278_800_000_000
    states = spark.createDataFrame(
        [("F", "X", None, "a.RAF", "7", "2026-07-17T10:00:00Z", "pc"), ("F", "X", None, "a.RAF", "no", "2026-07-17T10:00:00Z", None),
         (None, None, None, "b.RAF", "1", "2026-07-17T10:00:00Z", None), (" ", None, None, "b.RAF", "1", "2026-07-17T10:00:00Z", None)],
        "make string, model string, serial string, last_file string, import_no string, imported_at string, device string")
    kept = files.usable_import_state(states).collect()
    assert sorted((k.camera_key or "", k.import_no) for k in kept) == [("", 1), ("F_X", 7)]


def test_a_folder_of_tracks_is_read_back(spark, tmp_path):
    rows = [(t, i // 3, i + 1, i * 1_500_000, 46.0 + i / 1000, -7.25, 500.5, 4.5, None, None, "gps")
            for t in (7, 8, 9, 10) for i in range(8)]
    df = spark.createDataFrame(rows, "track_id long, segment_no long, seq long, t_us long, lat double, lon double, ele double,"
                               " accuracy double, ele_accuracy double, speed double, source string")
    names = spark.createDataFrame([(7, "a/b"), (8, "a_b"), (9, ".x"), (10, None)], "track_id long, name string")
    for size in (None, 3):
        out = str(tmp_path / f"out{size}")
        documents.write_gpx(df, out, names, part_rows=size)
        found, back, bad = tracks.read_tracks(spark, folder=out)
        assert sorted(r.name for r in found.collect()) == ["10", "_x", "a_b", "a_b (2)"] and bad.count() == 0
        by_name = back.join(found.select("track_id", "name"), "track_id").select("name", *df.columns[1:]).collect()
        stems = {7: "a_b", 8: "a_b (2)", 9: "_x", 10: "10"}
        assert sorted(map(tuple, by_name)) == sorted((stems[t], *r) for t, *r in rows)
        assert sorted(map(tuple, tracks.read_gpx(spark, out).select(*df.columns[1:]).collect())) == sorted(r[1:] for r in rows)
        files = sorted(p.name for p in (tmp_path / f"out{size}").iterdir())
        assert len(files) == (4 if size is None else 12) and all(f.endswith(".gpx") for f in files)


def test_no_attempt_is_seen_before_or_twice(spark, tmp_path):
    from trackplace.sinks.folder import _FolderWriter, write_files

    out = tmp_path / "out"
    writer = _FolderWriter(str(out), True)
    row = lambda f, d: type("R", (), {"file": f, "document": d})()
    lost, kept = writer.write(iter([row("a.gpx", "1")])), writer.write(iter([row("a.gpx", "2"), row("b.gpx", None)]))
    assert [p.name for p in out.iterdir() if not p.name.startswith(".")] == []
    writer.commit([kept, None])
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a.gpx": "2", "b.gpx": ""} and lost.folder != kept.folder
    writer = _FolderWriter(str(out), True)
    writer.abort([writer.write(iter([row("a.gpx", "3")]))])
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a.gpx": "2", "b.gpx": ""}
    files = spark.createDataFrame([("a.gpx", "4"), ("c.gpx", "5")], "file string, document string")
    with pytest.raises(PySparkException):
        write_files(files, str(out), replace=False)
    write_files(files, str(out))
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a.gpx": "4", "b.gpx": "", "c.gpx": "5"}
    with pytest.raises(PySparkException):
        write_files(spark.createDataFrame([("../a.gpx", "4")], files.schema), str(out))


def test_a_folder_is_read_and_parsed_once(spark, tmp_path):
    doc = lambda lat: GPX.format(ns=NS, body=f"<trk><trkseg>{point(lat=lat)}</trkseg></trk>")
    found, fixes, bad = tracks.read_tracks(spark, folder=folder_of(tmp_path, a_gpx=doc("1.5"), b_gpx="<gpx/>"))
    folder_of(tmp_path, a_gpx="no track any more", b_gpx=doc("2.5"))
    assert [r.lat for r in fixes.collect()] == [1.5] and [r.name for r in found.collect()] == ["a"]
    assert [r.problem for r in bad.collect()] == ["no timestamped points"]


def test_kml_is_stripped_of_comments_once(spark):
    files = spark.createDataFrame([("a", "kml", "<kml/>")], "path string, type string, text string")
    plan = tracks.fixes_of(tracks.parse_tracks(files), ["path"])._jdf.queryExecution().optimizedPlan().toString()
    # Four times for way points of GPX, once for all that is looked for in KML.
    assert plan.count("CDATA") <= 5
