import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackplace.llm.quality_rules import judge_tracks, measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(inside))


def counted(frame):
    return [tuple(r) for r in frame.select(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#|é\x1f", max_size=60), min_size=1, max_size=20))
def test_counts_are_those_of_brute_force(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "track_id long, document string")
    rows = measures(frame).orderBy("track_id")
    assert counted(rows) == [brute(t) for t in texts]


def test_windows_that_overlap_count_their_words_once(tracks_of):
    text = "a b c d e a b c d e a b c d e"
    assert counted(measures(tracks_of([(1, text)]))) == [brute(text)] == [(15, 15, 0, 0, 15)]


def test_odd_rows(odd, none):
    rows = judge_tracks(odd).collect()
    assert len(rows) == 12 and judge_tracks(none).count() == 0
    by = {r.track_id: r for r in rows}
    assert by[2].base_failed and by[3].base_failed and by[4].n_words == 0 and not by[2].kept
    assert by[6].n_repeat_words == 30_000 and by[6].base_failed
    assert by[7].word_chars == 200_000
    assert by[None].n_words == 17 and not by[None].base_failed


def test_the_table_decides(tracks_of):
    good = "The way to the pass is long and it is not for the tired or the old"
    rows = {r.track_id: r.kept for r in judge_tracks(tracks_of([
        (1, good), (2, good.upper()), (3, good.replace(" ", " #")), (4, good.replace(" ", "!! "))])).collect()}
    assert rows == {1: True, 2: False, 3: False, 4: False}
