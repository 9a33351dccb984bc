import hashlib
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackplace.llm import boosting
from trackplace.llm.personal import find_personal

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in twice) % 10 == 0


def brute(text):
    text, spans = text or "", []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
    return [(FORMS[k][0], s, e) for s, k, e in sorted(spans)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def check(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "track_id long, document string")
    for r in find_personal(frame).collect():
        want = brute(texts[r.track_id])
        assert r.base_sha256 == digest(want), texts[r.track_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x, _ in FORMS]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))
    return find_personal(frame)


TEXTS = [
    "write to a.b+c@mail.example.com. or x@y, z@w..v, a@b.c@d.e and é@x.y", "@a.b a@-.- a..b@c.d.e.",
    "1.2.3.4.5 256.1.1.1 0001.02.255.0 1.2.3", "4539578763621486 4539-5787-6362-1486 4539  5787 63621486 453957876362148",
    "+1 (269) 555-3296 then +49 30 1234567, +1 2, +1234567890123456 and +(1) 2", "🚲 a@b.cd 🚲 +1 (269) 555-3296",
    None, "", "\x01a@b\x01c.d 4539\x015787", "a.b.c@d.e-f.g_h@i.j", "12-34 56--78 9 0-1-2-3-4-5-6-7-8-9-0",
]


def test_base_spans(spark):
    check(spark, TEXTS)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a.@+ -()1205_é", max_size=50), min_size=40, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    check(spark, texts)


def test_a_number_lost_in_a_longer_stretch_is_added(spark):
    texts = [f"note +1 ({200 + i}) 555-{1000 + i} today" for i in range(60)]
    texts += [f"serial +1 {i} 2 3" for i in range(20)] + ["ring +1 (269) 555-3296 4539578763621486 now"]
    rows = {r.track_id: r for r in check(spark, texts).collect()}
    assert "phone:5:22" in rows[80].spans and rows[80].n_phone == 0 and rows[80].n_added == 1


def test_spans_within_added_spans_are_left_out(spark):
    from trackplace.llm.personal import _outermost

    rows = spark.sql("""select array(named_struct('start', 5L, 'kind', 3, 'end', 22L), named_struct('start', 8L, 'kind', 3, 'end', 22L),
        named_struct('start', 5L, 'kind', 2, 'end', 9L), named_struct('start', 20L, 'kind', 1, 'end', 30L)) as added""")
    assert [tuple(x) for x in _outermost(rows).first().added] == [(5, 3, 22), (20, 1, 30)]


def test_boosting_and_thresholds():
    import numpy as np

    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    cases, plus = np.array([50.0] * 4), np.array([1.0, 2, 3, 48])
    p = boosting.probability(boosting.fit(x, cases, plus, 30, 2), x)
    assert p[3] > 0.9 > 0.2 > max(p[:3])
    assert boosting.threshold(p, cases, plus, 0.9) == p[3]
    assert boosting.threshold(p, cases, plus * 0, 0.9) > 1


def test_odd_rows(odd, none):
    rows = find_personal(odd).collect()
    assert len(rows) == 12 and find_personal(none).count() == 0
    assert all(r.base_sha256 == digest(brute(t.document)) for r, t in zip(
        sorted(rows, key=lambda r: (r.track_id or 0, r.base_sha256)),
        sorted(odd.collect(), key=lambda t: (t.track_id or 0, digest(brute(t.document)))), strict=True))


def test_long_runs_take_linear_time_and_no_stack(spark):
    texts = ["1 " * 60_000, "0" * 200_000, "a." * 60_000, "a@" + "b." * 60_000 + "c", "1.2.3.4 " * 5_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "track_id long, document string")
    rows = {r.track_id: r for r in find_personal(frame).collect()}
    assert rows[4].n_ip == 5_000 and rows[3].n_email == 1


def test_rare_feature_vectors_are_learned_from(spark):
    from trackplace.llm.personal import RANGES, _counted, _features, _model, KINDS
    from pyspark.sql import functions as F

    # 5,125 vectors that pass, twice each, and one that fails, once.
    slim = spark.sql("""select false as held, array(
        named_struct('f', array(3, d, l, 1, 1, s, 0, 0), 'positive', 1L), named_struct('f', array(3, d, l, 1, 1, s, 0, 0), 'positive', 1L)) as labelled
        from (select explode(sequence(0, 24)) d), (select explode(sequence(0, 40)) l), (select explode(sequence(0, 4)) s)
        union all select false, array(named_struct('f', array(3, 3, 3, 1, 0, 0, 0, 0), 'positive', 0L))""")
    found = _counted(slim)
    assert len(found) == 5126 and found["code"].is_unique and found["cases"].sum() == 10_251
    fitted, limits = _model(slim, 10, 2, 0.9)
    assert boosting.probability(fitted, np.array([[3, 3, 3, 1, 0, 0, 0, 0.0]]))[0] < boosting.probability(
        fitted, np.array([[3, 3, 3, 1, 1, 0, 0, 0.0]]))[0] and limits[3] <= 1
    # No feature leaves its range, whatever the span is.
    odd = spark.createDataFrame([("1" * 90, "a" * 24, "b"), ("+" + "-" * 60, "", ""), ("", "tel. ", " x")], "text string, before string, after string")
    for kind in KINDS:
        for row in odd.select(_features(kind, F.struct("text", "before", "after")).alias("f")).collect():
            assert all(0 <= v < n for v, n in zip(row.f, RANGES, strict=True))
