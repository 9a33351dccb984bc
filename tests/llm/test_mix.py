import hashlib
import math
import re
from collections import Counter

import pytest

from trackplace.llm.mix import GOLDEN, POINTS, mix_sources, mixed_documents, mixed_texts, source_targets


def level(sizes, weights=(5, 2, 1)):
    """Targets by pouring out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        goal = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 2, "c": 3000, None: 5}, {"é": 7, "z": 100, "Z": 0, "": 3}, {"a": 9}])
def test_targets_are_those_of_pouring_out(spark, sizes):
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = level(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(want)


def test_sources_come_near_their_targets(tracks_of):
    docs = tracks_of([(i, "w " * (i * 37 % 101), "abcde"[i * i % 5]) for i in range(300)])
    rows = mixed_documents(docs, block_words=16).collect()
    assert len(rows) == 300
    for source in "abcde":
        mine = [r for r in rows if r.source == source]
        if mine:
            assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert sorted(rows) == sorted(mixed_documents(docs.repartition(7), block_words=16).collect())


def test_pieces_are_stretches_of_their_documents_and_spread(tracks_of):
    docs = tracks_of([(i, "w " * 64, "ab"[i % 2]) for i in range(100)])
    pieces, _ = mix_sources(docs, block_words=16)
    rows = pieces.collect()
    assert all(0 <= p.first and p.first + p.words <= 64 and p.words > 0 for p in rows)
    # Five of seven slots go to the first source in every stretch of the schedule.
    firsts = sorted({(p.slot, p.source) for p in rows})
    for start in range(0, len(firsts) - 70, 70):
        part = [s for _, s in firsts[start:start + 70]]
        assert abs(part.count("a") - 50) <= 4


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slot_by_slot(rows, block):
    """The pieces ``(slot, track_id, text)`` of a mix, one slot after the other."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = {s: math.floor(t + 1e-9) for s, t in level(sizes).items()}
    streams = {}
    for s in names:
        mine = sorted((hashlib.md5(f"mix:{'' if k is None else k}".encode()).hexdigest(), k is None, k or 0, len(WORD.findall(t or "")), t or "")
                      for k, t, x in rows if x == s)
        streams[s] = [(None if none else k, m.start(), m.end(), t) for _, none, k, _, t in mine for m in WORD.finditer(t)]
    blocks = {}
    for s in names:
        left, whole = goal[s], streams[s]
        takes = []
        while left > 0 and whole:
            part = whole[:left]
            takes += [part[i:i + block] for i in range(0, len(part), block)]
            left -= len(part)
        blocks[s] = takes
    total, high, spans = sum(map(len, blocks.values())), 0, []
    for s in names:
        low, high = high, 0
        high = sum(goal[x] for x in names[:names.index(s) + 1]) * POINTS // max(1, sum(goal.values()))
        spans.append((s, low, high))
    used, order = Counter(), []
    for slot in range(total):
        point = slot % POINTS * GOLDEN % POINTS
        s = next(s for s, low, high in spans if low <= point < high)
        if used[s] < len(blocks[s]):
            order.append((slot, blocks[s][used[s]]))
            used[s] += 1
    order += [(total, b) for s in names for b in blocks[s][used[s]:]]
    out = []
    for slot, words in order:
        texts = {}
        for key, start, end, text in words:
            first, _ = texts.get((key, text), (start, 0))
            texts[key, text] = (first, end)
        out += [(slot, key, text if len(WORD.findall(text)) == len(WORD.findall(text[a:b])) else text[a:b]) for (key, text), (a, b) in texts.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4, 16, 512])
def test_the_mix_is_that_of_going_slot_by_slot(tracks_of, block):
    rows = [(i, " ".join(f"{i}.{k}" + "\n" * (k % 5 == 0) for k in range(i * 37 % 41)), "abcd"[i * i % 4]) for i in range(60)]
    rows += [(None, "no id here", "a"), (70, None, "b"), (71, " \n ", None), (72, " of no source\t", None)]
    got = [(r.slot, r.track_id, r.document) for r in mixed_texts(tracks_of(rows).repartition(3), block_words=block).collect()]
    assert sorted(got, key=str) == slot_by_slot(rows, block)


def test_equal_rows_take_part_each_time(tracks_of):
    rows = [(1, "a b c d e", "x")] * 3 + [(2, "f g", "x")]
    got = mixed_texts(tracks_of(rows), block_words=4).collect()
    assert sum(r.words for r in got) == 17 and Counter(w for r in got for w in r.document.split()) == {
        **{w: 3 for w in "abcde"}, "f": 1, "g": 1}
    assert {r.first_slot is None for r in mixed_documents(tracks_of(rows)).collect()} == {False}


def test_every_stretch_of_the_schedule_is_even(tracks_of):
    docs = tracks_of([(i, "w " * 64, "abc"[i % 3]) for i in range(300)])
    pieces, sizes = mix_sources(docs, block_words=16)
    goal = {r.source: r.target for r in sizes.select("source", "target").distinct().collect()}
    share = {s: g / sum(goal.values()) for s, g in goal.items()}
    slots = sorted({(p.slot, p.source) for p in pieces.collect()})
    seen = Counter()
    for n, (_, source) in enumerate(slots, 1):
        seen[source] += 1
        # A golden-section lattice strays by little, and by less than its logarithm.
        assert all(abs(seen[s] - n * share[s]) <= 2 + math.log2(n) for s in share)


def test_odd_rows(odd, none):
    rows = mixed_documents(odd, block_words=64).collect()
    assert len(rows) == 12 and mixed_documents(none).count() == 0
    assert {r.size for r in rows if r.track_id in (2, 3, 4)} == {0}
    texts = mixed_texts(odd, block_words=64).collect()
    assert sum(len(r.document.split()) for r in texts) == sum(r.taken for r in rows) and mixed_texts(none).count() == 0
    assert all(r.taken <= 3 * r.size for r in rows)
