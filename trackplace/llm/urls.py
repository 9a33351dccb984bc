"""URL filter: rules first, then naive Bayes over segmented host names and path words.

The dictionary are the words of all pages, with their counts. A name can only be
split into words that it contains, so each name is met with the counts of its own
substrings, and neither the dictionary nor the classifier has to fit anywhere as
a whole. The project has no records with addresses, so the operator is general.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.llm.words import ascii_lower
from trackplace.session import checkpoint

LONGEST_WORD = 24
# Weights are added up as whole numbers of this fraction, in any order alike.
UNIT = 2.0**-32
# Rows of a table that go to every task at most.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, addresses whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Both are empty without ``://`` or for a null address."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The shortest is tried last, so it is written first.
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable split of a name into words under unigram counts (Viterbi).

    A stretch no word covers costs more the longer it is, so known words win; of
    equal splits the one whose last words begin first is taken.
    """
    unknown = math.log2(total + 1) + 4
    bits = {w: -math.log2(n / (total + 1)) for w, n in counts.items()}
    best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            cost = best[start] + bits.get(word, unknown + 2.0 * len(word))
            if cost < best[end]:
                best[end], back[end] = cost, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end]:end])
        end = back[end]
    return words[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n``: how often each word stands in all pages' texts, markup left out."""
    bare = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " "))
    word = F.explode(F.split(bare, r"[^\p{L}]+")).alias("word")
    return pages.select(word).filter(F.length("word").between(2, LONGEST_WORD)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


def _names(host: Column, path: Column) -> Column:
    """The names of an address: runs of letters, of the host (``h``) and of the path (``p``)."""
    of = lambda text, part: F.transform(
        F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda x: F.struct(F.lit(part).alias("part"), x.alias("name")))
    return F.concat(of(host, "h"), of(F.lower(path), "p"))


def _substrings(name: Column) -> Column:
    """All substrings of two to ``LONGEST_WORD`` letters."""
    size = F.length(name)
    none = F.array().cast("array<string>")
    from_ = lambda at: F.transform(
        F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), size - at + 1)), lambda n: F.substr(name, at, n))
    return F.when(size < 2, none).otherwise(
        F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), from_))))


def _meet(rows: DataFrame, listed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with what is listed for their key, once per key. The list goes to
    every task only while it is counted to be short; else both are shuffled, and
    what many rows have is split by the adaptive skew join."""
    return rows.join(F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed, on, how)


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` for distinct names, under the counts of all words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = names.select("name", F.explode(_substrings(F.col("name"))).alias("word"))
    # Few substrings are words, so what is left after the join is short.
    own = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [
                split_name(name, {} if found is None else {f["word"]: f["n"] for f in found}, total)
                for name, found in zip(batch["name"], batch["known"], strict=True)]
            yield pd.DataFrame({"name": batch["name"], "words": words})

    return names.join(own, "name", "left").mapInPandas(split, "name string, words array<string>")


def _weights(tokens: DataFrame, decided: DataFrame) -> tuple[DataFrame, int]:
    """Log odds of ``block`` per token and of the classes, in ``UNIT``; with a
    class that has no address, no token counts and the other class is likelier."""
    sizes = decided.agg(
        *[F.coalesce(F.sum(F.when(F.col("decided") == word, F.col("times"))), F.lit(0)).alias(word)
          for word in ("block", "allow")]).first()
    if not min(sizes):
        return tokens.select("part", "word", F.lit(0).cast("long").alias("weight")), round(
            ((sizes["block"] > 0) - (sizes["allow"] > 0)) / UNIT)
    sums = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    odds = (F.log((F.col("block") + 1) / F.lit(float((sums["block"] or 0) + sums["n"])))
            - F.log((F.col("allow") + 1) / F.lit(float((sums["allow"] or 0) + sums["n"]))))
    return tokens.select("part", "word", F.round(odds / UNIT).cast("long").alias("weight")), round(
        math.log(sizes["block"] / sizes["allow"]) / UNIT)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Verdict on each address.

    In: ``page_id, url, html``. Out, one row for each row in: ``page_id, host,
    path, rule, verdict, score``. The longest fitting rule decides; ``rule`` is
    null where none fits, and the class with the higher naive Bayes score
    (``score``: log odds of ``block``) decides instead, ``default`` on a tie or
    when rules decided no address to learn from. The classes learn from what the
    rules decide, with add-one counts over all tokens of decided addresses; other
    tokens say nothing. A null address, or one without ``://``, has empty parts
    and no rule. Repeated rows and null ids count and come out each time; a long
    address is split name by name. An empty table gives none.
    """
    host, path = address_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": verdict})
    # Addresses of equal parts have one rule and one score.
    addresses = checkpoint(rows.groupBy("host", "path", "decided").agg(F.count(F.lit(1)).alias("times")))
    found = addresses.select(
        "host", "path", "decided", "times", F.explode(_names(F.col("host"), F.col("path"))).alias("x")).select(
        "host", "path", "decided", "times", "x.part", "x.name")
    names = found.select("name").distinct()
    words = checkpoint(split_names(names, checkpoint(word_counts(pages.select("html")))))
    times = lambda word: F.sum(F.when(F.col("decided") == word, F.col("times")).otherwise(0)).alias(word)
    learned = found.filter(F.col("decided").isNotNull()).groupBy("part", "name").agg(times("block"), times("allow"))
    tokens = learned.join(words, "name").select("part", F.explode("words").alias("word"), "block", "allow")
    tokens = checkpoint(tokens.groupBy("part", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    weights, prior = _weights(tokens, addresses)
    parts = found.select("part", "name").distinct().join(words, "name").select("part", "name", F.explode("words").alias("word"))
    of_name = checkpoint(_meet(parts, checkpoint(weights), ["part", "word"]).groupBy("part", "name").agg(
        F.sum("weight").alias("weight")))
    of_address = _meet(found.select("host", "path", "part", "name"), of_name, ["part", "name"]).groupBy("host", "path").agg(
        F.sum("weight").alias("weight"))
    scored = rows.join(of_address, ["host", "path"], "left").withColumn(
        "score", (F.coalesce("weight", F.lit(0)) + F.lit(prior)) * F.lit(UNIT))
    chosen = F.when(F.col("score") > 0, "block").when(F.col("score") < 0, "allow").otherwise(default)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", chosen).alias("verdict"), "score")
