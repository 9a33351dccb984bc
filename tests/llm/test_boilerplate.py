import random
import re

from trackplace.llm.boilerplate import dedup_lines


def brute(rows, least=3):
    lines = [(i, s or "\0", at, x.strip(" \t\n\x0b\x0c\r")) for i, (_, t, s) in enumerate(rows) if t is not None
             for at, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x[3])]
    sites, first = {}, {}
    for i, s, at, x in lines:
        sites.setdefault(x, set()).add(s)
        place = (rows[i][0] is None, rows[i][0], at)
        first[x] = min(first.get(x, place), place)
    gone = {(i, at) for i, s, at, x in lines
            if len(sites[x]) >= least and (rows[i][0] is None, rows[i][0], at) != first[x]}
    return {d: None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone)
            for i, (d, t, _) in enumerate(rows)}


def test_lines_are_those_of_brute_force(tracks_of):
    rng = random.Random(4)
    pool = [f"line {i} has a few words" for i in range(40)] + ["short one", "", "  line 1 has a few words\t"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), f"s{d * d % 9 if d % 3 else 0}")
            for d in range(60)]
    got = {r.track_id: r.document for r in dedup_lines(tracks_of(rows)).collect()}
    assert got == brute(rows)


def test_lists_too_long_to_send_change_nothing(tracks_of, monkeypatch):
    monkeypatch.setattr("trackplace.llm.boilerplate.BROADCAST_LINES", 0)
    test_lines_are_those_of_brute_force(tracks_of)


def test_wide_spread_is_told_from_the_sketch(tracks_of):
    rows = [(d, f"All rights reserved by us\nNotice\nonly here {d} and there", f"site{d}") for d in range(500)]
    out = {r.track_id: (r.document, r.n_removed) for r in dedup_lines(tracks_of(rows)).collect()}
    assert out[0][0].startswith("All rights") and all(n == 2 * (d > 0) for d, (_, n) in out.items())


def test_threshold_is_exact(tracks_of):
    rows = [(d, f"carried by {n} sources here", f"s{k}") for n in (2, 3, 4) for k in range(n) for d in [10 * n + k]]
    removed = {r.track_id: r.n_removed for r in dedup_lines(tracks_of(rows)).collect()}
    assert [d for d, n in sorted(removed.items()) if n] == [31, 32, 41, 42, 43]


def test_odd_rows(odd, none):
    out = dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == 12 and dedup_lines(none).count() == 0
    assert set(odd.columns) - {"document"} <= set(out.columns)
    by = {r.track_id: r for r in rows}
    assert by[2].document is None and by[3].document == "" and by[6].document == "word " * 30_000
    assert {r.document for r in rows if r.track_id == 5} == {
        r.document for r in odd.collect() if r.track_id == 5}
