import random

import xxhash

from trackplace.llm.near import (
    BKTree, distinct_documents, fingerprint, near_duplicates, similar_documents, tree_links)
from trackplace.llm.words import most_frequent


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values):
    """Least id reachable over links of at most two bits, by trying all pairs."""
    low = {i: i for i in values}
    changed = True
    while changed:
        changed = False
        for i in values:
            for j in values:
                if (values[i] ^ values[j]).bit_count() <= 2 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprints(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 200):
        text = " \t".join(rng.choice(["The", "RIVER", "é", "a b", "É", "x"]) for _ in range(n))
        assert fingerprint(text) % 2**64 == brute_fingerprint(text)
    assert fingerprint(None) == 0


def test_long_texts_are_hashed_in_pieces():
    text = " ".join(str(i % 977) for i in range(70_000))
    words = text.split()
    ones = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    assert fingerprint(text) % 2**64 == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)


def test_a_tree_finds_what_a_scan_finds():
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    tree, values = BKTree(), sorted(values)
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.within(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]
    assert len(tree_links(values)) < len(values)


def test_groups_with_trees_and_with_neighbourhoods(spark, monkeypatch):
    from trackplace.llm import near

    rng = random.Random(11)
    values, centre = {}, rng.getrandbits(64)
    for i in range(160):
        if i % 4 == 0:
            centre = rng.getrandbits(64)
        values[i] = centre if i % 4 == 0 else values[i - 1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in values.items()]
    frame = spark.createDataFrame(signed, "track_id long, fp long")
    monkeypatch.setattr(near, "fingerprints", lambda tracks: frame)
    want = brute_groups(values)
    for tree_size in (1024, 1):
        rows = near.near_duplicates(None, tree_size).collect()
        assert {r.track_id: r.component_id for r in rows} == want
        assert {r.track_id: r.fingerprint for r in rows} == {i: f"{v:016x}" for i, v in values.items()}


def test_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == 12 and near_duplicates(none).count() == 0
    by = {r.track_id: r for r in rows}
    assert by[2].fingerprint == "0" * 16 and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert by[None].component_id == 5


def brute_similar(texts, least=0.8):
    """Least index reachable over pairs of five-word Jaccard ``least`` or more."""
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if low[j] < low[i] and len(a & b) >= least * len(a | b) - 1e-9:
                    low[i], changed = low[j], True
    return low


def test_documents_alike_in_most_shingles_are_one_group(spark):
    rng = random.Random(8)
    texts = ["", " \n", "one two", "ONE two"]
    for size in (30, 60, 100, 200):
        for _ in range(6):
            words = [f"w{rng.randrange(400)}" for _ in range(size)]
            for lost in (0, 1, 1, 2, 3, 4):
                copy = list(words)
                for _ in range(lost):
                    copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "track_id long, document string").repartition(3)
    want = brute_similar(texts)
    for list_size in (64, 8, 1):
        got = {r.track_id: r.component_id for r in similar_documents(docs, list_size=list_size).collect()}
        assert got == dict(enumerate(want))


def test_trees_find_pairs_that_are_compared(spark, monkeypatch):
    from trackplace.llm import near

    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(600)]
    texts = [" ".join(words)] + [" ".join([*words[:i], "new", *words[i + 1:]]) for i in (1, 300, 598)] + ["one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "track_id long, document string")
    names = near._set_names(docs, 5).select("track_id", "fp", "bits")
    assert {r.bits % 2**64 for r in names.collect()} == {
        sum(1 << b for b in range(64) if 2 * sum(int(g) >> b & 1 for g in s) > len(s)) for s in map(near.shingle_set, texts)}
    values = [r.bits for r in names.collect()]
    for a, b in near.nearest_links(values):
        assert ((a ^ b) % 2**64).bit_count() == min(
            ((a ^ v) % 2**64).bit_count() for v in values[:values.index(a)]) <= near.SET_RADIUS
    # Trees alone tie copies that differ in a word, and leave to the join what they miss.
    met = []
    similar = near._similar
    monkeypatch.setattr(near, "_similar", lambda pairs, *more: met.append(similar(pairs, *more)) or met[-1])
    got = {r.track_id: r.component_id for r in similar_documents(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4} and met[0].count() > 0


def test_pairs_that_trees_miss_are_joined(spark, monkeypatch):
    from trackplace.llm import near

    monkeypatch.setattr(near, "set_fingerprint", lambda grams: int(grams[0]) if len(grams) else 0)
    test_documents_alike_in_most_shingles_are_one_group(spark)


def test_similar_odd_rows(odd, none):
    rows = similar_documents(odd).collect()
    assert len(rows) == 12 and similar_documents(none).count() == 0
    by = {r.track_id: r.component_id for r in rows}
    assert {by[i] for i in (2, 3, 4)} == {2} and by[None] == 5


def test_one_document_of_a_group_stays(spark, odd, none):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [
        (3, text, "b"), (3, text, "a"), (3, text, "a"), (4, text.replace("w59", "x"), "a"), (3, "another text of id three", "a"),
        (None, text, "a"), (None, "a text without an id", "a"), (None, "a text without an id", "a"), (7, None, "a"), (8, " ", "a"),
        (9, "alone", "z"),
    ]
    docs = spark.createDataFrame(rows, "track_id long, document string, source string").repartition(3)
    got = sorted(map(tuple, distinct_documents(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[4], rows[6], rows[8], rows[10]], key=str)
    kept = distinct_documents(odd)
    assert kept.columns == odd.columns and distinct_documents(none).count() == 0
    assert sorted(r.track_id or 0 for r in kept.collect()) == [1, 2, 5, 6, 7, 8, 9]


def test_most_frequent_needs_no_sort(spark):
    counts = spark.createDataFrame([(str(i), i) for i in range(1, 200)], "word string, n long")
    top = sorted(r.n for r in most_frequent(counts, 50).collect())
    assert top and len(top) <= 50 and top == list(range(top[0], 200))
    assert most_frequent(counts, 0).count() == 0 and most_frequent(counts, 1000).count() == 199
