"""Files read by byte ranges give what the whole files give."""

import random

import pandas as pd
import pytest

from trackplace.sources import ranges, tracks

NS = "urn:trackplace:fix-evidence:1"


def point(tag, k, inner=""):
    return (f"<{tag} lat='4{k % 10}.5' lon=\"7.{k}\">\n <ele> {500 + k} </ele><time>2026-07-17T1{k % 10}:00:{k % 60:02}Z</time>{inner}</{tag}>")


def gpx():
    evidence = "<extensions><fe:acc>4.5</fe:acc><o:acc xmlns:o='urn:o'>9</o:acc><fe:src> g&amp;p </fe:src><fe:speed>1.5</fe:speed></extensions>"
    remark = "<!-- <trkpt lat='1' lon='2'><time>2026-07-17T10:00:00Z</time></trkpt> > ' \" - -->"
    return (
        f'<?xml version="1.0"?>\n{remark}<gpx xmlns:fe="{NS}" xmlns="http://www.topografix.com/GPX/1/1" note="a > b">'
        + point("wpt", 1) + remark + point("wpt", 2)
        + "<trk><name><![CDATA[<trkseg> & ]] > x]]></name><trkseg>" + point("trkpt", 9, evidence) + point("trkpt", 3)
        + "<trkpt lat='1' lon='x'><time>2026-07-17T10:00:00Z</time></trkpt><trkpt lat='1' lon='2'/>"
        + "</trkseg><trkseg/><trkseg>" + point("trkpt", 4, remark) + "</trkseg></trk>" + point("wpt", 5)
        + "<rte>" + "".join(point("rtept", k) for k in range(6, 12)) + "</rte>" + point("wpt", 8) + "<?pi <wpt> ?></gpx>\n")


def kml():
    when = lambda k: f"<when>2026-07-17T10:{k:02}:00Z</when>"
    mark = lambda k: (
        f"<Placemark><name>x</name><TimeStamp>{when(k)}</TimeStamp><Point><coordinates>7.{k},46.{k},20</coordinates></Point></Placemark>")
    return (
        '<kml xmlns:gx="urn:gx"><Document>' + mark(1) + mark(2) + "<!-- <gx:Track> -->"
        + "<Placemark><gx:Track>" + when(9) + "<when/>" + when(7)
        + "<gx:coord>7.1 46.1 500</gx:coord><gx:Track>" + when(5) + "<gx:coord>7.2 46.2</gx:coord></gx:Track>"
        + "<gx:coord>7.3 46.3 5</gx:coord><gx:coord>7.4 46.4</gx:coord></gx:Track></Placemark>" + mark(3)
        + "<gx:Track>" + when(11) + "<gx:coord>7.5 46.5</gx:coord></gx:Track>" + "<Placemark><Point><coordinates>1,2</coordinates></Point></Placemark>"
        + mark(4) + "</Document></kml>")


def rows(spark, folder, **sizes):
    _, fixes, bad = tracks.read_tracks(spark, folder=folder, **sizes)
    columns = sorted(fixes.columns)
    return sorted(map(tuple, fixes.select(columns).collect()), key=str), sorted(
        (r.path.rsplit("/", 1)[1], r.problem) for r in bad.collect())


def test_tracks_inside_tracks_belong_to_the_outermost(spark, tmp_path):
    (tmp_path / "a.kml").write_text(kml())
    got = [(r.segment_no, r.seq, r.lon) for r in tracks.read_kml(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(0, 1, 7.4), (0, 2, 7.3), (0, 3, 7.1), (1, 4, 7.5), (2, 5, 7.1), (2, 6, 7.2), (3, 7, 7.3), (4, 8, 7.4)]


@pytest.mark.parametrize("size", [1, 7, 64, 333, 100_000])
def test_any_cut_gives_the_rows_of_the_whole_file(spark, tmp_path, size):
    good = gpx()
    texts = {
        "a.gpx": good, "b.kml": kml(), "cut.gpx": good[:-30], "crossed.gpx": good.replace("</trkseg></trk>", "</trk></trkseg>"),
        "doctype.gpx": "<!-- x --><!DOCTYPE gpx>" + good, "html.kml": "<html><gpx/></html>", "empty.gpx": "<gpx><trk></trk></gpx>",
        "two.gpx": "<gpx></gpx><gpx></gpx>", "alone.gpx": "<gpx/>", "part.gpx": good.replace(
            "<trk>", '<metadata><extensions><fe:part no="2" segment="3" seq="40"/></extensions></metadata><trk>', 1)}
    if size < 64:
        texts = {k: t for k, t in texts.items() if k in ("a.gpx", "b.kml", "cut.gpx")}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    whole = rows(spark, str(tmp_path))
    assert len(whole[0]) > 15 and rows(spark, str(tmp_path), whole_bytes=0, range_bytes=size) == whole


def test_long_files_and_long_comments(spark, tmp_path):
    rng = random.Random(2)
    body = "".join(
        point("trkpt", rng.randrange(60), rng.choice(["", "<!--" + "x>" * rng.randrange(3000) + "-->", "<desc>" + "é" * 900 + "</desc>"]))
        + ("</trkseg><trkseg>" if rng.random() < 0.05 else "") for _ in range(600))
    (tmp_path / "a.gpx").write_text(f"<gpx><trk><trkseg>{body}</trkseg></trk></gpx>", encoding="utf-8")
    whole = rows(spark, str(tmp_path))
    assert len(whole[0]) == 600 and rows(spark, str(tmp_path), whole_bytes=0, range_bytes=5000) == whole


def test_ranges_of_small_files_go_together(tmp_path):
    n = 40
    for k in range(n):
        (tmp_path / f"{k:02}.gpx").write_text("<gpx><trk><trkseg>" + point("trkpt", 7) + "</trkseg></trk></gpx>", encoding="utf-8")
    cut = pd.DataFrame([(str(tmp_path / f"{k:02}.gpx"), i, i * 64, (i + 1) * 64) for k in range(n) for i in range(3)],
                       columns=["path", "range_no", "begin", "end"])
    said = list(ranges._summaries(NS, tracks._PART)(iter([cut])))
    begun = list(ranges._all_begun(iter(said)))
    assert len(said) == len(begun) == 1 and len(begun[0]) == 3 * n and begun[0]["problem"].isna().all()
    found = list(ranges._events(iter([begun[0][:50], begun[0][50:]])))
    assert len(found) == 1 and sorted(found[0]["path"]) == sorted(set(cut["path"]))
