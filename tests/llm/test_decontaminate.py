import itertools
import random
import re

from trackplace.llm.decontaminate import FORMS, MASKS, SPAN, WINDOW, clean_tracks, contaminated


def brute(docs, items):
    """Pairs with a good window on some alignment; all of an item too short for the masks."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = cut(text), cut(item)
        for shift in range(-len(b) + 1, len(a)):
            same = [a[x] == b[x - shift] for x in range(max(0, shift), min(len(a), shift + len(b)))]
            n = min(WINDOW, len(b))
            least = n if n < SPAN else 0.8 * n - 1e-9
            good = any(sum(same[s:s + n]) >= least for s in range(len(same) - n + 1))
            if good:
                found.add((d, i))
    return found


def test_any_two_substitutions_leave_a_mask_whole():
    for lost in itertools.combinations(range(WINDOW), 2):
        assert any(
            all(s + p not in lost for p in m) for m in MASKS for s in range(WINDOW - SPAN + 1))


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["river", "pass", "ridge", "the", "of", "hut", "way", "north", "Café", "12", "stone", "lake"]
    write = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, write(rng.choice([8, 11, 14, 20, 40]))) for i in range(12)]
    docs = []
    for d in range(60):
        words = write(60)
        if d % 2:
            part = list(items[d % 12][1])
            for _ in range(d % 7):
                part[rng.randrange(len(part))] = "other"
            words[20:20] = part
        docs.append((d, "  ".join(words)))
    items = [(i, ", ".join(w).upper()) for i, w in items]
    rows = contaminated(
        spark.createDataFrame(docs, "track_id long, document string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.track_id, r.item_id) for r in rows} == brute(docs, items)
    assert all(r.same <= r.overlap for r in rows)


def test_items_of_few_tokens_can_be_left_out(spark):
    docs = spark.createDataFrame([(1, "the way to the hut"), (2, "a lake")], "track_id long, document string")
    items = spark.createDataFrame([(7, "the"), (8, "to the hut")], "item_id long, text string")
    pairs = lambda n: {(r.track_id, r.item_id) for r in contaminated(docs, items, least_tokens=n).collect()}
    assert pairs(1) == {(1, 7), (1, 8)} and pairs(2) == {(1, 8)} and pairs(4) == set()


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "and CAME to the river, with the sun still low the rider left the town at dawn"),
         (2, None), (3, ""), (None, "The rider left the town at dawn and came to the river with"), (2, "too short")],
        "item_id long, text string")
    rows = contaminated(odd, items).collect()
    assert {(r.track_id, r.item_id) for r in rows} == {(1, None), (None, None), (5, None)}
    assert contaminated(none, items).count() == 0 and contaminated(odd, items.limit(0)).count() == 0
    kept = clean_tracks(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r.track_id for r in kept.collect()) == [2, 3, 4, 6, 7, 8, 9]


def test_every_pattern_that_counts_has_a_seed():
    for n in range(SPAN, WINDOW + 1):
        for lost in itertools.combinations(range(n), n - -(-4 * n // 5)):
            assert any(all(s + p not in lost for p in f) for f in FORMS for s in range(n - f[-1])), (n, lost)


def test_pairs_are_those_of_the_declared_rule(spark):
    items, docs = [], []
    for n in (11, 12, 13, 15, 16, 20):
        items.append((n, " ".join(f"i{n}x{k}" for k in range(n))))
        for lost in itertools.islice(itertools.combinations(range(n), 3 if n >= 15 else 2), 0, None, 3 if n < 15 else 17):
            words = items[-1][1].split()
            for k in lost:
                words[k] = "other"
            docs.append((len(docs), "before " + " ".join(words) + " after"))
    items += [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in (1, 4, 10)]
    docs += [(1000 + n, f"so {t.upper()}, then") for n, t in items[-3:]] + [(2000, "s4x0 s4x1 s4x2 s10x3"), (2001, items[-1][1][:-1])]
    docs.append((2002, items[-2][1]))

    def counts(text, item):
        a, b = re.findall(r"[^\W_]+", text.lower()), re.findall(r"[^\W_]+", item.lower())
        n = min(WINDOW, len(b))
        need = n if len(b) < SPAN else -(-4 * n // 5)
        return any(
            sum(x == y for x, y in zip(a[s:s + n], b[k:k + n], strict=True)) >= need
            for s in range(len(a) - n + 1) for k in range(len(b) - n + 1))

    want = {(d, i) for d, t in docs for i, item in items if counts(t, item)}
    rows = contaminated(
        spark.createDataFrame(docs, "track_id long, document string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.track_id, r.item_id) for r in rows} == want and {(1001, 1), (1004, 4), (1010, 10), (2002, 4)} <= want
