import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackplace.llm import search
from trackplace.llm.search import Best, ItemTiles, impacts, search_tracks, text_terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, top):
    """All documents scored for each distinct item, in whole numbers."""
    lists = [(key, Counter(terms(text)), len(terms(text))) for key, text in documents]
    n_docs, n_terms = sum(n > 0 for *_, n in lists), sum(n for *_, n in lists)
    df = Counter(t for _, tf, _ in lists for t in tf)
    out = []
    for item_id, text in set(items):
        found = []
        for key, tf, n in lists:
            score = 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item_id, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "track_id", "score").collect()), key=str)


@pytest.mark.parametrize("block_terms", [100_000, 5])
def test_ranks_as_brute_force(spark, tracks_of, monkeypatch, block_terms):
    monkeypatch.setattr(search, "TILE_DOCUMENTS", 7)
    rng = random.Random(block_terms)
    names = ["Ridge", "pass", "ÉTAPE", "étape", "hut", "2024", "漢字", "col", "gpx", "way-point", "a_b", "x" * 40]
    documents = [(k % 90, " ".join(rng.choices(names, k=rng.randrange(12)))) for k in range(100)]
    documents += [(None, "ridge pass"), (None, "hut"), (200, None), (201, ""), (202, "ridge " * 3000)] + [(k, "col hut") for k in range(300, 340)]
    items = [(k, " ".join(rng.choices([*names, "unseen"], k=rng.randrange(9)))) for k in range(12)]
    items += [(3, "ridge ridge"), (3, "hut"), (3, "hut"), (None, "pass"), (50, None), (51, ""), (52, "col hut")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = search_tracks(tracks_of(documents).repartition(5), frame, top=20, block_terms=block_terms)
    assert rows(got) == brute(documents, [(k, t) for k, t in items if terms(t)], 20)


def test_pieces_of_a_long_text_end_between_terms(monkeypatch):
    monkeypatch.setattr(search, "_PIECE", 10)
    text = "Ridge pass, ÉTAPE 漢字 hut " * 30 + "x" * 200
    assert [t.decode() for piece in text_terms(text) for t in piece] == terms(text)


@pytest.mark.parametrize("exact", [2**53, 40 * search.IMPACT_LIMIT, 5 * search.IMPACT_LIMIT])
def test_tiles_stay_exact(exact):
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 30, (50, 9)) * rng.integers(0, 2, (50, 9))
    term, item = np.nonzero(dense)
    tiles = ItemTiles(item, term, dense[term, item], 9, tile=8, exact=exact)
    for column, r, c, v in tiles.tiles:
        right = np.zeros((len(column), 9))
        right[r, c] = v
        assert len(column) <= 8 and right.sum(0).max() * search.IMPACT_LIMIT < exact
    left = rng.integers(0, search.IMPACT_LIMIT, (20, 50)) * rng.integers(0, 2, (20, 50))
    row, at = np.nonzero(left)
    assert (tiles.scores(row, at, left[row, at], 20, 50) == left @ dense).all()
    assert impacts(np.array([10**9]), np.array([75])).max() < search.IMPACT_LIMIT


def test_best_keeps_ties_by_id():
    best = Best(1, 3)
    for ids in ([9, 8, 7, 6, 5], [4, 3], [2, 1, 0]):
        best.add(np.full((len(ids), 1), 10), np.array(ids), np.array([i == 0 for i in ids]))
    assert best.rows[0][2].tolist() == [1, 2, 3]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "The rider", "x"), (2, "1 2 é Ω", "x")], "item_id long, text string, score string")
    got = rows(search_tracks(odd, items))
    documents = [(r.track_id, r.document) for r in odd.collect()]
    assert got == brute(documents, [(1, "The rider"), (2, "1 2 é Ω")], 20) and len(got) > 5
    assert rows(search_tracks(none, items)) == [] and rows(search_tracks(odd, items.limit(0))) == []
