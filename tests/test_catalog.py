"""Cards and imports: order round the counter, resuming, cameras, shared state."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trackplace.functions import names
from trackplace.operators import catalog

FILES = "card_id long, file_id long, name string, local_us long"


def card(spark, files, card_id=1):
    return spark.createDataFrame(
        [(card_id, i, f, i * 1_000_000) if isinstance(f, str) else (card_id, i, *f) for i, f in enumerate(files)], FILES)


def ordered(spark, files, limit=None):
    rows = catalog.camera_order(card(spark, files), ["card_id"], limit=limit).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [r.name for r in rows]


def number(name):
    stem = name.rsplit(".", 1)[0]
    digits, i = "", len(stem)
    while i and not stem[i - 1].isdigit():
        i -= 1
    while i and stem[i - 1].isdigit():
        digits, i = stem[i - 1] + digits, i - 1
    return (int(digits), len(digits)) if digits and int(digits) <= 2**31 - 1 else None


def sequential(files):
    parsed = sorted((number(f)[0], f.lower(), i) for i, f in enumerate(files) if number(f))
    files_in_order = [files[p[2]] for p in parsed]
    if len(parsed) < 2:
        return files_in_order
    modulus = 10 ** max(number(f)[1] for f in files if number(f))
    best, start = -1, 0
    for i in range(len(parsed) - 1):
        if parsed[i + 1][0] - parsed[i][0] > best:
            best, start = parsed[i + 1][0] - parsed[i][0], i + 1
    if parsed[0][0] + modulus - parsed[-1][0] > best:
        start = 0
    return files_in_order[start:] + files_in_order[:start]


def test_order_wraps_and_takes_the_last_digits(spark):
    assert ordered(spark, ["DSCF0001.RAF", "DSCF9999.RAF", "DSCF0002.RAF", "DSCF9998.RAF"]) == [
        "DSCF9998.RAF", "DSCF9999.RAF", "DSCF0001.RAF", "DSCF0002.RAF"]
    assert ordered(spark, ["101_FUJI_0007.JPG", "README", "x99999999999.JPG"]) == ["101_FUJI_0007.JPG"]
    assert ordered(spark, ["DSCF0002.RAF", "dscf0002.JPG", "DSCF0001.RAF"]) == [
        "DSCF0001.RAF", "dscf0002.JPG", "DSCF0002.RAF"]


@pytest.mark.parametrize("limit", [None, 40])
def test_order_agrees_with_sequential_restatement(spark, limit):
    rng = random.Random(1)
    for _ in range(3 if limit else 6):
        width = rng.choice([1, 2, 4])
        files = [f"IMG{rng.randrange(10 ** width):0{width}d}.{rng.choice(['JPG', 'raf'])}" for _ in range(90)]
        files = list(dict.fromkeys(files))
        assert ordered(spark, files, limit) == sequential(files)


def test_later_is_the_order_of_two(spark):
    rng = random.Random(2)
    pairs = [tuple(f"D{rng.randrange(10 ** w):0{w}d}.JPG" for w in (rng.choice([1, 2, 4]), rng.choice([2, 4])))
             for _ in range(400)] + [("README", "D1.JPG"), ("d5.RAF", "D5.JPG"), ("D5.JPG", "D5.RAF")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.x for r in df.select(names.is_later(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [len(s := sequential([b, a])) == 2 and s[-1] == a for a, b in pairs]


def new(spark, files, name=None, us=None, limit=None):
    resume = spark.createDataFrame([(1, name, us)], "card_id long, after_name string, after_us long")
    rows = catalog.filter_new(card(spark, files), resume, ["card_id"], limit=limit).orderBy("rank", "name").collect()
    return [r.name for r in rows if r.placed], [r.name for r in rows if not r.placed]


@pytest.mark.parametrize("limit", [None, 2])
def test_resuming(spark, limit):
    files = [("DSCF0001.RAF", 30), ("DSCF0002.RAF", 10), ("DSCF0003.RAF", 20), ("DSCF0004.RAF", 5), ("COVER.JPG", 25)]
    assert new(spark, files, limit=limit)[0] == [f"DSCF000{i}.RAF" for i in (1, 2, 3, 4)]
    assert new(spark, files, name="dscf0002.raf", limit=limit) == (["DSCF0003.RAF", "DSCF0004.RAF"], [])
    assert new(spark, files, name="DSCF0009.RAF", limit=limit) == ([], [])
    assert new(spark, files, us=30, limit=limit) == (["DSCF0002.RAF", "DSCF0003.RAF", "DSCF0004.RAF"], [])
    assert new(spark, files[1:], us=15, limit=limit) == (["DSCF0003.RAF", "DSCF0004.RAF"], ["COVER.JPG"])
    assert new(spark, files, us=99, limit=limit) == ([], [])


def test_camera_key_and_label(spark):
    rows = [("Canon", "Canon EOS R5", " 1 2 "), ("FUJIFILM\x00", "X-T2", "81M"), (" ", None, ""), (None, "X  T", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    got = df.select(names.camera_key(*cols).alias("k"), names.camera_label(*cols).alias("l")).collect()
    assert [r.k for r in got] == ["Canon_EOS-R5_1-2", "FUJIFILM_X-T2_81M", None, "X-T"]
    assert got[0].l == "Canon EOS R5 (1 2)"


def test_camera_of_asks_readable_types_of_the_newest_first(spark):
    rows = [(1, i, f"DSCF{i:04d}.{'JPG' if i in (3, 12) else 'RAF'}", "F", f"m{i}", None) for i in range(15)]
    schema = "card_id long, file_id long, name string, make string, model string, serial string"
    assert catalog.camera_of(spark.createDataFrame(rows, schema), ["card_id"]).first().model == "m12"


def test_files_that_name_no_camera_are_spread_and_only_the_newest_ten_looked_up(spark):
    files = spark.range(4000).selectExpr(
        "id div 400 as card_id", "id as file_id", "concat('DSCF', lpad(id % 400, 4, '0'), '.RAF') as name",
        "case when id % 400 = 395 and id < 2000 then id div 400 when id % 400 = 395 and id < 2400 then 99"
        " when id % 400 < 300 then 7 end as camera_id")
    cameras = spark.range(8).selectExpr("id as camera_id", "'F' as make", "concat('m', id) as model", "null as serial")
    with_conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        found = catalog.with_cameras(files.filter("camera_id is null"), cameras)
        tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
        got = catalog.camera_of(files, ["card_id"], cameras=cameras).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 994 and max(r["count"] for r in tasks) < 300
    # Card 5 names a camera that nobody knows, later ones none among the newest ten.
    assert {r.card_id: r.model for r in got} == {c: f"m{c}" if c < 5 else None for c in range(10)}



STATE = "camera_key string, last_file string, import_no long, at_us long, device string"


def test_states_merge_per_camera(spark):
    a = spark.createDataFrame([("A", "DSCF9990.RAF", 4, 1, "pc"), (None, "X1.JPG", 1, 1, "pc"), ("B", "D5.JPG", 2, 9, "pc")], STATE)
    b = spark.createDataFrame([("A", "DSCF0010.RAF", 3, 2, "tab"), (None, "X1.jpg", 5, 1, "tab"), ("C", "E1.JPG", 1, 1, "tab")], STATE)
    got = {r.camera_key: (r.last_file, r.import_no, r.device) for r in catalog.merge_import_state(a, b).collect()}
    assert got == {"A": ("DSCF0010.RAF", 4, "tab"), None: ("X1.JPG", 5, "pc"), "B": ("D5.JPG", 2, "pc"), "C": ("E1.JPG", 1, "tab")}
    assert [r.camera_key for r in catalog.ordered_state(catalog.merge_import_state(a, b)).collect()] == [None, "A", "B", "C"]


def test_state_for_camera_falls_back(spark):
    state = "state_order long, make string, model string, serial string, last_file string"
    card_schema = "card_id long, make string, model string, serial string"
    cards = spark.createDataFrame([(1, "F", "X", "1"), (2, "f", "x", "9"), (3, "F", "X", None), (4, None, None, None), (5, "Q", "Z", None)], card_schema)
    states = spark.createDataFrame([(0, "F", "X", "2", "two"), (1, "F", "X", "1", "one"), (2, "F", "X", None, "blank"), (3, None, None, None, "unknown")], state)
    found = {r.card_id: r.state_last_file for r in catalog.state_for_camera(cards, states).collect()}
    assert found == {1: "one", 2: "blank", 3: "blank", 4: "unknown"}
    lone = catalog.state_for_camera(cards, states.filter("make is null"))
    assert {r.state_last_file for r in lone.collect()} == {"unknown"} and lone.count() == 5


def test_settings(spark):
    schema = "subject_id long, skey string, svalue string, changed_us long"
    a = spark.createDataFrame([(1, "zone", "A", 5), (1, "tol", "1", 5), (1, "x", "same", 7)], schema)
    b = spark.createDataFrame([(1, "zone", "B", 6), (1, "tol", "2", 5)], schema)
    got = {r.skey: r.svalue for r in catalog.merge_settings(a, b, ["subject_id", "skey"]).collect()}
    assert got == {"zone": "B", "tol": "1", "x": "same"}
    changes = spark.createDataFrame([(1, "x", "same", 9), (1, "zone", "C", 9)], schema)
    now = {r.skey: (r.svalue, r.changed_us) for r in catalog.set_value(a, changes, ["subject_id", "skey"]).collect()}
    assert now == {"x": ("same", 7), "zone": ("C", 9), "tol": ("1", 5)}


def test_types_and_folders(spark):
    df = spark.createDataFrame([("jpg, .MOV,, jpg",)], "t string")
    assert df.select(names.parse_types(F.col("t")).alias("x")).first().x == ["jpg", "mov"]
    folders = spark.createDataFrame([(1, "Import 07"), (1, "Import x"), (2, "Photos")], "p long, folder string")
    states = spark.createDataFrame([(1, 9)], "p long, import_no long")
    got = {r.p: r.next_no for r in catalog.next_import_no(folders, states, ["p"]).collect()}
    assert got == {1: 10, 2: 1}


def test_many_devices_are_one_fold_in_order(spark):
    rng = random.Random(12)
    fields = ["camera_key", "last_file", "import_no", "at_us", "device"]
    schema = "camera_key string, last_file string, import_no int, at_us long, device string"
    rows = [(rng.choice(["A", "B", None]), rng.choice(["DSCF%04d.RAF", "dscf%04d.raf", "X%05d.JPG"]) % rng.randrange(0, 10000, 700),
             rng.randrange(50), rng.randrange(9), f"d{k}") for k in range(1000)] + [("C", "no number", 1, 1, "d")]
    every = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema + ", turn int").repartition(5)
    whole = {r.camera_key: tuple(r) for r in catalog.fold_states(every).select(fields).collect()}
    want = {}
    for row in rows:
        want[row[0]] = row if row[0] not in want else later_of(want[row[0]], row)
    assert whole == want
    for size in (7, 100):
        cut = catalog.fold_states(every, fold_rows=size).select(fields).collect()
        assert {r.camera_key: tuple(r) for r in cut} == want
    a, b, c = [r for r in rows if r[0] == "A"][:3]
    merged = catalog.merge_all_states([spark.createDataFrame([r], schema) for r in (a, b, c)]).select(fields)
    assert [tuple(r) for r in merged.collect()] == [later_of(later_of(a, b), c)]


def later_of(a, b):
    """The pairwise rule on two states, one number at a time."""
    def number(name):
        digits = re.findall(r"\d+", name.rsplit(".", 1)[0])
        return (int(digits[-1]), len(digits[-1])) if digits else None

    x, y = number(b[1]), number(a[1])
    if a[1].lower() == b[1].lower():
        wins = b[3] > a[3]
    elif x is None or y is None:
        wins = False
    else:
        d, size = x[0] - y[0], 10 ** max(x[1], y[1])
        wins = b[1].lower() >= a[1].lower() if d == 0 else 2 * d < size if d > 0 else 2 * d <= -size
    last = b if wins else a
    return (a[0], last[1], max(a[2], b[2]), last[3], last[4])


def test_names_are_taken_apart_once_per_state(spark):
    states = spark.createDataFrame(
        [("c", "DSCF9999.RAF", 3, 5, "a", 0), ("c", "DSCF0001.RAF", 1, 4, "b", 1), ("c", None, None, 9, "d", 2),
         ("c", "dscf0001.raf", 2, 6, "e", 3), (None, None, None, None, "f", 0)],
        "camera_key string, last_file string, import_no long, at_us long, device string, turn long")
    folded = catalog.fold_states(states)
    assert sorted(map(tuple, folded.collect()), key=str) == [
        ("c", "dscf0001.raf", 3, 6, "e"), (None, None, None, None, "f")]
    # Number and width of a name, not those of both names at every meeting.
    assert folded._jdf.queryExecution().optimizedPlan().toString().count("(?!.*") <= 3
