import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackplace.llm.infill import FenwickTree, UnitIndex, fill_in_middle, restored

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 64, 100])
def test_descent_finds_the_block(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(0, 4, (2, n))
    tree, ends = FenwickTree(counts), np.cumsum(counts[0])
    for rank in range(int(counts[0].sum())):
        block, before = tree.descend(rank)
        assert block == np.searchsorted(ends, rank, side="right")
        assert before.tolist() == counts[:, :block].sum(1).tolist()


def test_cuts_of_many_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "Z", " ", "\n", "é", "漢", "🚲", "1", "\r\n", "@", "[", "`", "{"]) for _ in range(rng.randrange(40)))
        units = UNIT.findall(text)
        index = UnitIndex(text.encode(), rng.choice([1, 2, 3, 7, 4096]))
        assert (index.n_units, index.n_points) == (len(units), len(text))
        assert [index.cut(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def both(frame):
    out = fill_in_middle(frame).withColumn("restored", restored(F.col("output"), F.col("form")))
    return [tuple(r) for r in out.collect()]


def test_track_documents_are_cut_as_by_hand(tracks_of):
    rng = random.Random(5)
    parts = ["<trkpt", ' lat="1.5"', "<", ">", "S>", "<M", "\n", "é", "P>", "ridge", "<S>" if rng.random() < 0.5 else "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]
    rows = both(tracks_of(list(enumerate(texts))))
    assert len(rows) == len(texts)
    for key, *got, back in rows:
        assert tuple(got) == brute(key, texts[key]) and back == texts[key]
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows(odd, none):
    want = sorted(((r.track_id, *brute(r.track_id, r.document), r.document or "") for r in odd.collect()), key=str)
    assert sorted(both(odd), key=str) == want and both(none) == []
