import math
import random

import numpy as np
import pytest

from trackplace.llm import languages
from trackplace.llm.languages import SYMBOLS, Trees, identify_languages, plain_bytes


def brute_bits(train, text):
    """Code length by the definition, one symbol at a time."""
    counts = {}
    for t in train:
        padded = b"   " + t
        for i in range(3, len(padded)):
            for order in range(4):
                table = counts.setdefault(padded[i - order:i], {})
                table[padded[i]] = table.get(padded[i], 0) + 1
    known, bits, padded = None, 0.0, b"   " + text
    for i in range(3, len(padded)):
        for order in range(3, -1, -1):
            table = counts.get(padded[i - order:i], {})
            total, kinds = sum(table.values()), len(table)
            if padded[i] in table:
                bits -= math.log2(table[padded[i]] / (total + kinds))
                break
            if total:
                bits += math.log2((total + kinds) / kinds)
        else:
            bits += math.log2(SYMBOLS)
    return bits, known


def model(texts):
    used = sorted({b for t in texts for x in t for b in x})
    symbol_of = np.full(256, SYMBOLS - 1, np.int64)
    symbol_of[used] = range(len(used))
    counts = []
    for train in texts:
        table = {}
        for t in train:
            s = [int(symbol_of[b]) for b in b"   " + t]
            for i in range(3, len(s)):
                key = ((s[i - 3] * 64 + s[i - 2]) * 64 + s[i - 1]) * 64 + s[i]
                table[key] = table.get(key, 0) + 1
        counts.append(table)
    return Trees(symbol_of, ["a", "b"], counts)


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    sets = [[plain_bytes(" ".join(word(x) for _ in range(30))) for _ in range(5)] for x in ("abcde", "cdefg")]
    trees = model(sets)
    texts = [plain_bytes(" ".join(word("abcdefg") for _ in range(n))) for n in (1, 5, 60)] + [plain_bytes("")]
    want = [[brute_bits(train, t)[0] for train in sets] for t in texts]
    assert trees.lengths(texts) == pytest.approx(np.array(want))
    monkeypatch.setattr(languages, "PIECE", 7)
    assert trees.lengths(texts) == pytest.approx(np.array(want))


def test_held_out_documents_are_told_apart(tracks_of):
    rng = random.Random(8)
    stems = {"en": ["the", "river", "ridge", "of", "with", "thing", "sheep"], "de": ["der", "fluss", "und", "grat", "nicht", "schaf"]}
    rows = [(i, " ".join(rng.choice(stems[k]) for _ in range(12)), "gps", k)
            for i, k in enumerate(rng.choice(["en", "de"]) for _ in range(120))]
    got = {r.track_id: r for r in identify_languages(tracks_of(rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, _, lang in rows if got[i].held_out)
    assert any(r.held_out for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())


def test_a_second_training_is_not_answered_by_the_first(tracks_of):
    texts = {"aa": "river ridge sheep thing with the", "bb": "fluss grat schaf nicht und der"}
    rows = [(i, texts["ab"[i % 2] * 2], "gps", "ab"[i % 2] * 2) for i in range(60)]
    swapped = [(i, t, s, "bb" if k == "aa" else "aa") for i, t, s, k in rows]
    for frame in (rows, swapped):
        got = {r.track_id: r.lang_pred for r in identify_languages(tracks_of(frame)).collect()}
        assert got == {i: k for i, _, _, k in frame}


def test_odd_rows(odd, none, tracks_of):
    rows = identify_languages(odd).collect()
    assert len(rows) == 12 and identify_languages(none).count() == 0
    by = {r.track_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 8))
    assert by[9].lang_pred in ("en", "de")
    alone = identify_languages(tracks_of([(1, "no language is known", "gps")])).collect()
    assert alone[0].lang_pred == "und"
