"""Track files of any size, read by byte ranges.

A range does not know where in the document it begins: within a comment, within
a tag, how deep. So every range is first gone through for each place the text
could be in at its first byte (most of these meet again at the next tag), which
gives what the range does to the open elements: how many it ends, which it
leaves open. Put together in order, these say where each range begins. A second
pass then reads the ranges apart from each other; an element belongs to the
range its tag begins in, and positions in the file name segments and tracks, so
no range has to count what came before it.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.functions.times import parse_track_time
from trackplace.operators.ordered import Keyed, Prev, Sum, row_count
from trackplace.session import checkpoint

RANGE_BYTES = 16 << 20
_AHEAD = 1 << 16
_ROWS = 20_000
# Characters of summaries that go together.
_SAID = 1 << 20
# Where the text can be at a byte: between tags, or inside of one of these.
TEXT, COMMENT, CDATA, INSTRUCTION, DECLARATION, TAG, IN_DOUBLE, IN_SINGLE = range(8)
_ENDS = {COMMENT: b"-->", CDATA: b"]]>", INSTRUCTION: b"?>", DECLARATION: b">"}
_BEGINS = ((b"<!--", COMMENT), (b"<![CDATA[", CDATA), (b"<?", INSTRUCTION), (b"<!", DECLARATION))
_REST = re.compile(rb"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_QUOTED = re.compile(rb"(?:[^\"']++|\"[^\"]*+\"|'[^']*+')*+")
_TAG = re.compile(rb"<(/?)([^\s/>\"'<]+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(rb"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
# Elements that make a fix or a half of one, and what ends a run of loose fixes.
_POINTS = {"trkpt": (0, ["gpx", "trk", "trkseg"]), "rtept": (1, ["gpx", "rte"]), "wpt": (2, ["gpx"])}
_FIELDS = {"ele": "ele", "time": "time"}
_EVIDENCE = {"acc": "acc", "eleacc": "eleacc", "speed": "speed", "src": "src"}
_BREAKS = {"gpx": ("trk", "rte"), "kml": ("Track",)}
# Kinds of rows of a KML file, next to those of points: halves of a track's fixes
# and of a placemark's, and placemarks with a track in them.
TRACK_TIME, TRACK_PLACE, MARK_TIME, MARK_PLACE, MARK_WITH_TRACK = range(10, 15)

_BEGUN = (
    "path string, range_no long, `begin` long, `end` long, inside int, open string, namespace string, last_break long,"
    " root string, part_segment long, part_seq long, problem string"
)
_DOES = ["path", "range_no", "begin", "end", "does"]
_EVENTS = (
    "path string, kind int, segment long, mark long, at long, time string, lat string, lon string, ele string,"
    " acc string, eleacc string, speed string, src string, place string"
)


def _local(name: bytes) -> str:
    return name.rsplit(b":", 1)[-1].decode("utf-8", "replace")


class _Bytes:
    """A stretch of a file that can be read on. ``lead`` bytes stand before it,
    for ends of comments that straddle the border."""

    def __init__(self, path: str, begin: int, end: int):
        system, inside = fs.FileSystem.from_uri(path)
        self._file = system.open_input_file(inside)
        self.size = self._file.size()
        self.start, self.lead = max(0, begin - 2), begin - max(0, begin - 2)
        self.limit = min(end, self.size) - self.start
        self.data = b""
        self.more(self.limit + 16)

    def more(self, size: int = _AHEAD) -> bool:
        """Reads on; false at the end of the file."""
        got = self._file.read_at(size, self.start + len(self.data))
        self.data += got
        return bool(got)


def _resume(text: _Bytes, inside: int) -> int | None:
    """Where text begins again in a range that begins ``inside``; None if not in it."""
    data, lead, limit = text.data, text.lead, text.limit
    if inside == TEXT:
        return lead
    if inside in _ENDS:
        at = data.find(_ENDS[inside], lead if inside == DECLARATION else 0)
        end = at + len(_ENDS[inside])
        return end if at >= 0 and end <= limit else None
    at = lead
    if inside != TAG:
        at = data.find(b'"' if inside == IN_DOUBLE else b"'", lead) + 1
        if not at:
            return None
    m = _REST.match(data, at, limit)
    return m.end() if m else None


def _left_inside(text: _Bytes, inside: int) -> int:
    """Where the range ends if what it begins inside of does not end in it."""
    if inside in _ENDS:
        return inside
    at = text.lead
    if inside != TAG:
        at = text.data.find(b'"' if inside == IN_DOUBLE else b"'", text.lead, text.limit) + 1
        if not at:
            return inside
    return _quote(text.data, at, text.limit)


def _quote(data: bytes, at: int, limit: int) -> int:
    end = _QUOTED.match(data, at, limit).end()
    return TAG if end >= limit else IN_DOUBLE if data[end:end + 1] == b'"' else IN_SINGLE


def _tokens(text: _Bytes, at: int, going: Callable[[int], bool]) -> Iterator[tuple]:
    """``kind, begin, end, match`` of what stands between texts, as long as
    ``going`` says so of where it begins. ``end`` is None where the file ends first."""
    while True:
        begin = text.data.find(b"<", at)
        while begin < 0 and going(len(text.data)) and text.more():
            begin = text.data.find(b"<", at)
        if begin < 0 or not going(begin):
            return
        if len(text.data) - begin < 9:
            text.more()
        kind = next((k for mark, k in _BEGINS if text.data.startswith(mark, begin)), TAG)
        while True:
            if kind == TAG:
                match = _TAG.match(text.data, begin)
                end = match.end() if match else None
            else:
                match, found = None, text.data.find(_ENDS[kind], begin + (4 if kind == COMMENT else 2))
                end = found + len(_ENDS[kind]) if found >= 0 else None
            # What a comment says is of no use to the range it begins in.
            if end is not None or kind != TAG and not going(len(text.data)) or not text.more():
                break
        yield kind, begin, end, match
        if end is None:
            return
        at = end


def _summary(text: _Bytes, at: int, namespace: bytes, part: re.Pattern) -> dict:
    """What a range does from the place on where its text begins."""
    closes, opens, broken = [], [], False
    out = {"inside": TEXT, "namespace": None, "part": None, "breaks": {}, "doctype": None}
    for kind, begin, end, match in _tokens(text, at, lambda begin: begin < text.limit):
        if kind == DECLARATION and text.data[begin:begin + 9].upper() == b"<!DOCTYPE" and out["doctype"] is None:
            out["doctype"] = text.start + begin
        if end is None or end > text.limit:
            out["inside"] = kind if kind != TAG else _quote(text.data, begin + 1, text.limit)
        if kind != TAG:
            continue
        if match is None:
            broken = True
            break
        name, rest = match[2], match[3]
        if match[1]:
            if not opens:
                closes.append(name.decode("utf-8", "replace"))
            elif opens.pop()[0] != name.decode("utf-8", "replace"):
                broken = True
                break
            continue
        if namespace in rest and out["namespace"] is None:
            of = [k for k, a, b in _ATTRIBUTE.findall(rest) if (a or b) == namespace and k.startswith(b"xmlns:")]
            out["namespace"] = of[0][6:].decode() if of else None
        if out["part"] is None and (said := part.match(match[0].decode("utf-8", "replace"))):
            out["part"] = [int(said[2]), int(said[3])]
        for root, names in _BREAKS.items():
            if _local(name) in names:
                out["breaks"][root] = text.start + begin
        out.setdefault("first", [text.start + begin, name.decode("utf-8", "replace")])
        if not rest.endswith(b"/"):
            opens.append([name.decode("utf-8", "replace"), text.start + begin])
        elif not opens and "empty" not in out:
            out["empty"] = len(closes)
    return out | {"closes": closes, "opens": opens, "broken": broken}


def _summaries(namespace: str, part: str):
    """Per range, what it does for each place its first byte can be in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, length = [], 0
            for row in batch.itertuples(index=False):
                text, seen, found = _Bytes(row.path, row.begin, row.end), {}, []
                for inside in range(8):
                    at = _resume(text, inside)
                    if at is None:
                        found.append({"inside": _left_inside(text, inside), "closes": [], "opens": [], "broken": False,
                                      "namespace": None, "part": None, "breaks": {}, "doctype": None})
                        continue
                    # From the same next tag on, all goes the same way.
                    next_ = text.data.find(b"<", at)
                    if next_ not in seen:
                        seen[next_] = _summary(text, at, namespace.encode(), re.compile(part))
                    found.append(seen[next_])
                held.append((row.path, row.range_no, row.begin, row.end, json.dumps(found)))
                length += len(held[-1][-1])
                # Short rows go together: a table of its own costs more than a small file does.
                if length >= _SAID:
                    yield pd.DataFrame(held, columns=_DOES)
                    held, length = [], 0
            if held:
                yield pd.DataFrame(held, columns=_DOES)

    return run


def _all_begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each range of each file begins; the rows come sorted by file and range."""
    columns = [c.split()[0].strip("`") for c in _BEGUN.split(", ")]
    rows = (row for batch in batches for row in batch.itertuples(index=False))
    held: list[list] = []
    for _, ranges in groupby(rows, key=attrgetter("path")):
        held += _begun(ranges)
        if len(held) >= _ROWS:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _begun(ranges: Iterable) -> list[list]:
    """Where each range of a file begins: what all ranges before it did, in order.
    A file has one short row per range."""
    inside, open_, namespace, last, root, part, problem, ended = TEXT, [], None, {}, None, [0, 0], None, False
    rows = []
    for row in ranges:
        rows.append([row.path, row.range_no, row.begin, row.end, inside, json.dumps(open_), last.get(root, -1)])
        does = json.loads(row.does)[inside]
        inside = does["inside"]
        first = does.get("first")
        if does["doctype"] is not None and root is None and (first is None or does["doctype"] < first[0]):
            problem = problem or "declares a DOCTYPE"
        if root is None and first:
            root = first[1].rsplit(":", 1)[-1].lower()
            if root not in _BREAKS:
                problem = problem or f"unsupported root element {root}"
        broken = does["broken"] or len(does["closes"]) > len(open_)
        for name in does["closes"]:
            broken = broken or not open_ or open_.pop()[0] != name
        ended = ended or root is not None and not open_ and bool(does["closes"])
        broken = broken or ended and bool(does["opens"])
        if broken:
            problem = problem or "not well formed"
        open_ = open_ + does["opens"]
        namespace = namespace or does["namespace"]
        part = part if part != [0, 0] or not does["part"] else does["part"]
        last = last | does["breaks"]
    if open_ or inside != TEXT:
        problem = problem or "not well formed"
    if root is None:
        problem = problem or "unsupported root element "
    # The root may come after the first range, its name space with it.
    return [[*row[:-1], namespace, row[-1], root, *part, problem] for row in rows]


class _Reader:
    """The elements of one range that make fixes."""

    def __init__(self, row):
        self.row, self.text = row, _Bytes(row.path, row.begin, row.end)
        self.open = [(n.encode(), at) for n, at in json.loads(row.open)]
        self.last_break = row.last_break
        self.unit: dict | None = None
        self.depth = 0
        held = [k for k, (name, _) in enumerate(self.open) if _local(name) in self._units()]
        self.foreign = held[0] if held else None

    def _units(self) -> tuple:
        return tuple(_POINTS) if self.row.root == "gpx" else ("when", "coord", "coordinates")

    def _names(self) -> list[str]:
        return [_local(n) for n, _ in self.open]

    def _first(self, name: str) -> int | None:
        return next((at for n, at in self.open if _local(n) == name), None)

    def _start(self, name: bytes, attributes: bytes, at: int) -> dict | None:
        """A row that the start tag alone makes."""
        local, path = _local(name), self._names()
        if local in _BREAKS[self.row.root]:
            self.last_break = at
            mark = self._first("Placemark")
            if local == "Track" and mark is not None:
                return {"kind": MARK_WITH_TRACK, "mark": mark, "at": at}
        if self.unit is not None or self.foreign is not None or local not in self._units():
            return None
        if self.row.root == "gpx":
            kind, around = _POINTS[local]
            if path == around:
                said = {_local(k): (a or b).decode("utf-8", "replace") for k, a, b in _ATTRIBUTE.findall(attributes)}
                segment = self.last_break if kind == 2 else self.open[-1][1]
                self.unit = {"kind": kind, "segment": segment, "at": at, "lat": said.get("lat"), "lon": said.get("lon")}
        else:
            track, mark = self._first("Track"), self._first("Placemark")
            if local in ("when", "coord") and track is not None:
                self.unit = {"kind": TRACK_TIME if local == "when" else TRACK_PLACE, "segment": track, "at": at}
            elif mark is not None and track is None and (
                    local == "when" and "TimeStamp" in path or local == "coordinates" and "Point" in path):
                self.unit = {"kind": MARK_TIME if local == "when" else MARK_PLACE, "segment": self.last_break,
                             "mark": mark, "at": at}
        self.depth = len(self.open)
        return None

    def _field(self, name: bytes, said: str) -> None:
        """What an ended element says about the unit it stands in."""
        inside = self._names()[self.depth + 1:]
        if self.row.root == "kml":
            if len(self.open) == self.depth:
                self.unit["time" if self.unit["kind"] in (TRACK_TIME, MARK_TIME) else "place"] = said
        elif not inside and len(self.open) == self.depth + 1 and _local(name) in _FIELDS:
            self.unit[_FIELDS[_local(name)]] = said
        elif inside == ["extensions"] and self.row.namespace is not None:
            prefix, _, local = name.decode("utf-8", "replace").partition(":")
            if prefix == self.row.namespace and local in _EVIDENCE:
                self.unit[_EVIDENCE[local]] = said

    def rows(self) -> Iterator[dict]:
        text = self.text
        at = _resume(text, self.row.inside)
        if at is None:
            return
        said, last = [], at
        going = lambda begin: begin < text.limit or self.unit is not None
        for kind, begin, end, match in _tokens(text, at, going):
            said.append(text.data[last:begin])
            if end is None:
                return
            last = end
            if kind == CDATA and self.row.root == "gpx":
                said.append(text.data[begin + 9:end - 3].replace(b"&", b"&amp;"))
            if kind != TAG:
                continue
            name, body = match[2], html.unescape(b"".join(said).decode("utf-8", "replace"))
            said = []
            if match[1]:
                self.open.pop()
                if self.foreign is not None and len(self.open) <= self.foreign:
                    self.foreign = None
                if self.unit is not None:
                    self._field(name, body)
                    if len(self.open) == self.depth:
                        yield self.unit
                        self.unit = None
                continue
            row = self._start(name, match[3], text.start + begin)
            if row is not None:
                yield row
            if not match[3].endswith(b"/"):
                self.open.append((name, text.start + begin))
            elif self.unit is not None and self.unit["at"] == text.start + begin:
                yield self.unit
                self.unit = None


def _events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _EVENTS.split(", ")]

    def table(rows):
        out = pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)
        return out.assign(**{c: out[c].astype("Int64") for c in ("kind", "segment", "mark", "at")})

    held = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            for found in _Reader(row).rows():
                held.append(found | {"path": row.path})
                if len(held) == _ROWS:
                    yield table(held)
                    held = []
    if held:
        yield table(held)


def begun_ranges(
    files: DataFrame, namespace: str, part: str, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The byte ranges of ``path, size`` and where in its document each begins."""
    shuffle = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.greatest(F.expr(f"(size - 1) div {range_bytes}"), F.lit(0).cast("long"))
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range_no")).select(
        "path", "range_no", (F.col("range_no") * range_bytes).alias("begin"),
        ((F.col("range_no") + 1) * range_bytes).alias("end"))
    ranges = ranges.repartition(shuffle, "path", "range_no")
    done = ranges.mapInPandas(
        _summaries(namespace, part), "path string, range_no long, `begin` long, `end` long, does string")
    return done.repartition("path").sortWithinPartitions("path", "range_no").mapInPandas(_all_begun, _BEGUN)


def ranged_fixes(
    begun: DataFrame, zone: str, number: Callable[[Column], Column], coordinates: Callable[[Column, str], Column],
    limit: int | None = None,
) -> DataFrame:
    """``path, segment_no, seq`` and the fields of a fix, as the whole files give
    them, numbered however long a file is."""
    shuffle = int(begun.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = begun.filter(F.col("problem").isNull()).repartition(shuffle, "path", "range_no")
    # Counted and read by kind below; the files are read once.
    events = checkpoint(good.mapInPandas(_events, _EVENTS))
    none = F.lit(None).cast("string")
    points = events.filter(F.col("kind") <= 2)
    # The i-th time of a track goes with its i-th place.
    numbered = lambda kind: Keyed(
        events.filter(F.col("kind") == kind).select("path", "segment", "at", "time", "place"), ["path", "segment"], limit,
    ).running(["at"], _i=row_count()).rows()
    places = numbered(TRACK_PLACE).select("path", "segment", "_i", F.col("place").alias("_place"))
    in_track = numbered(TRACK_TIME).join(places, ["path", "segment", "_i"])
    in_track = in_track.select(
        "path", F.lit(0).alias("kind"), "segment", "at", "time", coordinates(F.col("_place"), r"\s+").alias("c"))
    first = lambda kind, of: F.min_by(of, F.when(F.col("kind") == kind, F.col("at")))
    marks = events.filter(F.col("kind") >= MARK_TIME).groupBy("path", "mark").agg(
        first(MARK_TIME, "time").alias("time"), first(MARK_PLACE, "place").alias("place"),
        F.max("segment").alias("segment"), F.max("kind").alias("most"))
    marks = marks.filter(F.col("most") != MARK_WITH_TRACK).select(
        "path", F.lit(2).alias("kind"), "segment", F.col("mark").alias("at"), "time",
        coordinates(F.col("place"), ",").alias("c"))
    placed = in_track.unionByName(marks).select(
        "path", "kind", "segment", "at", "time", F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lon"),
        F.get("c", F.lit(2)).alias("ele"), *[none.cast("double").alias(c) for c in ("acc", "eleacc", "speed")], none.alias("src"))
    points = points.select(
        "path", "kind", "segment", "at", "time", *[number(F.col(c)).alias(c) for c in ("lat", "lon", "ele", "acc", "eleacc", "speed")],
        F.nullif(F.trim("src"), F.lit("")).alias("src"))
    fixes = points.unionByName(placed).withColumn("t_us", F.unix_micros(parse_track_time(F.col("time"), zone)))
    fixes = fixes.filter(F.col("t_us").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    order = ["kind", "segment", "t_us", "at"]
    rows = Keyed(fixes, ["path"], limit).running(order, seq=row_count(), _was=Prev(F.struct("kind", "segment")))
    turns = F.coalesce(F.col("_was") != F.struct("kind", "segment"), F.lit(False)).cast("long")
    rows = rows.running(order, segment_no=Sum(turns)).rows()
    parts = begun.filter("range_no = 0").select(F.col("path").alias("_path"), "part_segment", "part_seq")
    return rows.join(parts, F.col("path") == F.col("_path")).select(
        "path", (F.col("segment_no") + F.col("part_segment")).alias("segment_no"),
        (F.col("seq") + F.col("part_seq")).alias("seq"), "t_us", "lat", "lon", "ele",
        F.col("acc").alias("accuracy"), F.col("eleacc").alias("ele_accuracy"), "speed", F.col("src").alias("source"))
