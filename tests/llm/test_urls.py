import itertools
import math
import random
import re
from collections import Counter

import pytest

from trackplace.llm import urls
from trackplace.llm.urls import Rule, filter_urls, split_name, split_names, word_counts

RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]
URLS = [
    "https://WWW.Example.com/en/1", "https://m.example.com/en/1?x#y", "http://example.com", "http://example.com?/en/",
    "ftp://x.net/fr/a#b", "ftp://x.net/FR/a", "http://notexample.com/en/", "example.com/en/", "", None, "://", "a://b://c/d",
    "http://com/", "http://x.com:80/", "https://casinowin.org/en/7", "http://É.com/é",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>casino win</p>", "x") for i, u in enumerate(URLS)],
                                  "page_id long, url string, html string, host string")
    rows = filter_urls(pages, RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)
    assert filter_urls(pages.limit(0), RULES).count() == 0


def test_names_are_split_into_words():
    counts = {"casino": 50, "win": 40, "wins": 5, "in": 30, "trail": 20, "map": 20}
    assert split_name("casinowin", counts, 165) == ["casino", "win"]
    assert split_name("trailmap", counts, 165) == ["trail", "map"]
    assert split_name("", counts, 165) == [] and split_name("zz", {}, 0) == ["zz"]


def cheapest(name, counts, total):
    """The least cost of any split, by trying all of them."""
    unknown, best = math.log2(total + 1) + 4, math.inf
    for cuts in itertools.product([0, 1], repeat=max(0, len(name) - 1)):
        words, word = [], name[:1]
        for letter, cut in zip(name[1:], cuts, strict=True):
            words, word = (words + [word], letter) if cut else (words, word + letter)
        best = min(best, sum(cost(w, counts, total, unknown) for w in [*words, word] if w))
    return best


def cost(word, counts, total, unknown):
    return -math.log2(counts[word] / (total + 1)) if word in counts else unknown + 2.0 * len(word)


def test_splits_are_the_cheapest_of_all():
    rng = random.Random(1)
    for _ in range(60):
        counts = {"".join(rng.choices("abc", k=rng.randrange(2, 5))): rng.randrange(1, 50) for _ in range(8)}
        name, total = "".join(rng.choices("abc", k=rng.randrange(1, 10))), sum(counts.values()) + 20
        words = split_name(name, counts, total)
        assert "".join(words) == name
        assert sum(cost(w, counts, total, math.log2(total + 1) + 4) for w in words) == pytest.approx(cheapest(name, counts, total))


def brute_scores(pages, rules):
    """Scores by going through all pages with the whole dictionary at hand."""
    counts = Counter(w for _, _, html in pages for w in re.split(r"[\W\d_]+", re.sub(r"<[^>]*>", " ", (html or "").lower())) if 2 <= len(w) <= 24)
    total, learned, decided, found = sum(counts.values()), {}, Counter(), []
    for _, url, _ in pages:
        host, path, rule = brute(url)
        tokens = [(part, w) for part, text in (("h", host), ("p", path.lower())) for name in re.findall(r"[^\W\d_]+", text)
                  for w in split_name(name, {k: n for k, n in counts.items() if k in name}, total)]
        found.append(tokens)
        if rule is not None:
            decided[rule.verdict] += 1
            for t in tokens:
                learned.setdefault(t, Counter())[rule.verdict] += 1
    if not decided["block"] or not decided["allow"]:
        return [float((decided["block"] > 0) - (decided["allow"] > 0))] * len(pages)
    sums = {v: sum(c[v] for c in learned.values()) + len(learned) for v in ("block", "allow")}
    weight = {t: math.log((c["block"] + 1) / sums["block"]) - math.log((c["allow"] + 1) / sums["allow"]) for t, c in learned.items()}
    prior = math.log(decided["block"] / decided["allow"])
    return [prior + sum(weight.get(t, 0.0) for t in tokens) for tokens in found]


@pytest.mark.parametrize("listed", [50_000, 0])
def test_scores_are_those_of_going_through_all_pages(spark, monkeypatch, listed):
    monkeypatch.setattr(urls, "BROADCAST_ROWS", listed)
    rng = random.Random(3)
    stems = ["trail", "map", "casino", "win", "hut", "col", "ridge", "en", "es", "fr"]
    pages = [(k, f"https://{rng.choice(['www.', 'm.', ''])}{''.join(rng.choices(stems, k=rng.randrange(1, 4)))}.{rng.choice(['com', 'net', 'org'])}"
              f"/{rng.choice(['en', 'es', 'fr'])}/{''.join(rng.choices(stems, k=2))}-{k}", " ".join(rng.choices(stems, k=30))) for k in range(80)]
    pages += [(None, u, "hut") for u in URLS] + pages[:3] + [(900, "http://x.org/" + "trailmap" * 400, None)]
    want = brute_scores(pages, RULES)
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), RULES).collect()
    assert sorted((str(r.page_id), r.host, r.path, round(r.score, 6)) for r in got) == sorted(
        (str(k), *brute(u)[:2], round(x, 6)) for (k, u, _), x in zip(pages, want, strict=True))
    assert all(r.verdict == (r.rule and brute(f"x://{r.host}{r.path}")[2].verdict or ("block" if r.score > 0 else "allow")) for r in got)


def test_no_word_is_lost_to_the_size_of_the_table(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    pages = [(k, f"http://{w}hut.org/x", f"<p>{w} hut</p>") for k, w in enumerate(words)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    names = frame.selectExpr("regexp_extract(url, '//([a-z]+)', 1) as name").distinct()
    got = {r["name"]: r.words for r in split_names(names, word_counts(frame)).collect()}
    assert got == {f"{w}hut": [w, "hut"] for w in words}


def test_classes_learn_from_what_rules_decide(spark):
    words = "casino win trail map " * 50
    rows_in = [(i, f"http://casinowin{i % 7}.net/es/{i}", words) for i in range(30)]
    rows_in += [(100 + i, f"http://trailmap{i % 7}.com/en/{i}", words) for i in range(30)]
    rows_in += [(500, "http://wincasino.org/x", words), (501, "http://maptrail.org/x", words)]
    rows = {r.page_id: r for r in filter_urls(
        spark.createDataFrame(rows_in, "page_id long, url string, html string"), RULES).collect()}
    assert (rows[500].rule, rows[500].verdict) == (None, "block")
    assert (rows[501].rule, rows[501].verdict) == (None, "allow")
