"""Near-duplicate track documents: SimHash fingerprints linked through BK-trees.

Two fingerprints that differ in at most two of 64 bits agree in at least two of
four blocks of 16 bits. So fingerprints meet in six shards, one per pair of
blocks, keyed by the 32 bits of that pair; each shard value has a BK-tree of its
own (children by Hamming distance to the parent), and a search follows only the
edges within the radius. The trees go to where their keys are: sending all of
them everywhere would take every fingerprint through the driver.

``similar_documents`` groups by the Jaccard similarity of shingle sets itself.
SimHash fingerprints of the sets meet in the same trees, in a wider radius, and
each candidate they give is compared exactly. Fingerprints may be further apart
than a shard allows, so what is not in one group after that is met as well: two
sets that similar share one of their first shingles in any order common to all
sets, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackplace.llm.words import most_frequent, track_documents
from trackplace.session import checkpoint

RADIUS = 2
SHINGLE = 3
SEED = 42
# Fingerprints of one shard value that a tree is grown for; fuller values are
# linked through one-bit neighbourhoods instead, which has no groups that grow.
TREE_SIZE = 1024
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_PIECE = 1 << 16
# Groups by similarity: words of a shingle and the least Jaccard similarity.
SET_SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
SIMILARITY = 0.8
# Bits in which fingerprints of sets may differ to be candidates; pairs beyond
# what their shards bring together are left to the exact join.
SET_RADIUS = 8
# Documents that share a first shingle and are compared pair by pair; where more
# do, they are compared with a few of them first.
LIST_SIZE = 64
CENTRES = 8
# The order of shingles is learned from one document in so many, and has so many
# places for frequent ones. Any order gives the same groups; it only saves time.
ORDER_SHARE = 16
ORDER_SHINGLES = 100_000
# Bits that stand for a set before whole sets are compared; a power of two.
MARKS = 2048
FEW_MARKS = 1024
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit number; 0 for a text without words."""
    # bytes.lower() changes A-Z only, bytes.split() parts at the six spaces.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _PIECE):
        part = words[start:start + _PIECE + shingle - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [
            b" ".join(words)]
        h = np.array([digest(g, SEED) for g in grams], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


class BKTree:
    """Numbers under Hamming distance; ``within`` visits only edges in reach."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            todo.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)
        return found


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A link from each value to the least one it reaches within the list, one
    per value at most: enough to connect what is connected."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value & (2**64 - 1), radius):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
        tree.add(value & (2**64 - 1))
    return [(value, values[root(i)]) for i, value in enumerate(values) if root(i) != i]


def nearest_links(values: list[int], radius: int = SET_RADIUS) -> list[tuple[int, int]]:
    """A link from each value to the nearest of those before it, if one is within
    the radius: candidates that are compared themselves, so none goes by way of others."""
    tree, links = BKTree(), []
    for value in values:
        bits = value & (2**64 - 1)
        found = tree.within(bits, radius)
        if found:
            links.append((value, values[min(found, key=lambda j: ((tree.values[j] ^ bits).bit_count(), j))]))
        tree.add(bits)
    return links


def _shards(values: DataFrame) -> DataFrame:
    block = lambda i: F.shiftright("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [
        F.struct(F.lit(n).alias("shard"), F.shiftleft(block(a), 16).bitwiseOR(block(b)).alias("key"))
        for n, (a, b) in enumerate(PAIRS)]
    return values.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.shard", "k.key")


def _grow_trees(links_of):
    """Links within each (shard, key), as ``links_of`` a list of values gives them;
    the rows come sorted by shard and key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None

        def flush(links):
            links.extend(links_of(held))
            held.clear()

        for batch in batches:
            links: list[tuple[int, int]] = []
            for shard, key, fp in zip(batch["shard"], batch["key"], batch["fp"], strict=True):
                if (shard, key) != at:
                    flush(links)
                    at = (shard, key)
                held.append(int(fp))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        links = []
        flush(links)
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _neighbourhood_links(values: DataFrame) -> DataFrame:
    """Links within two bits, exactly, for any number of values: two of them are
    that close if and only if some number is within one bit of both. At most 65
    values share such a number, so no group grows."""
    flips = F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.get(F.array(*[F.lit(-(2**63) if b == 63 else 1 << b) for b in range(64)]), i))))
    balls = values.select("fp", F.explode(flips).alias("near"))
    least = balls.groupBy("near").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return balls.join(least, "near").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")


def near_links(values: DataFrame, tree_size: int = TREE_SIZE, links_of=tree_links) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``fp`` within
    ``RADIUS`` bits, at most one per value and shard."""
    shards = _shards(values)
    sizes = shards.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = checkpoint(shards.join(sizes, ["shard", "key"]))
    few = shared.filter(F.col("n") <= tree_size).select("shard", "key", "fp")
    links = few.repartition("shard", "key").sortWithinPartitions("shard", "key", "fp").mapInPandas(
        _grow_trees(links_of), "a long, b long")
    many = shared.filter(F.col("n") > tree_size).select("fp").distinct()
    return links.unionByName(_neighbourhood_links(many)).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked number, ``root`` being the least it reaches.

    Rounds of large and small stars: each node's neighbours are tied to the
    least among them, until nothing changes. Every round is one table in the
    checkpoint folder.
    """
    edges = checkpoint(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    stamp = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = stamp(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, stamp(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprints(tracks: DataFrame) -> DataFrame:
    """``track_id, fp`` for each track document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "track_id": batch["track_id"].astype("Int64").values,
                "fp": np.array([fingerprint(t) for t in batch["document"]], np.int64)})

    return track_documents(tracks).mapInPandas(run, "track_id long, fp long")


def near_duplicates(tracks: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Groups of near-duplicate track documents.

    In: ``track_id, document``. Out, one row for each row in: ``track_id,
    fingerprint`` (16 lowercase hex digits) and ``component_id``, the least
    ``track_id`` reachable over links of at most two differing bits (null where
    no document of the group has an id). A null or empty document has the
    fingerprint zero and is linked like any other; a text of fewer than three
    words is one shingle; repeated rows share a group. Equal fingerprints are
    reduced to one before they are linked. An empty table gives none.
    """
    rows = checkpoint(fingerprints(tracks))
    values = checkpoint(rows.groupBy("fp").agg(F.min("track_id").alias("low")))
    joined = _grouped(rows, values, connected(near_links(values.select("fp"), tree_size)))
    return joined.select(
        "track_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(rows: DataFrame, values: DataFrame, tied: DataFrame) -> DataFrame:
    """``rows`` with ``component_id``, the least id among the values tied to theirs."""
    grouped = tied.join(values, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("m"))
    rooted = grouped.join(values, F.col("root") == F.col("fp")).select("root", F.least("m", "low").alias("of_group"))
    named = tied.join(rooted, "root").select("node", "of_group").unionByName(
        rooted.select(F.col("root").alias("node"), "of_group"))
    owner = values.join(named, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("of_group", "low").alias("component_id"))
    return rows.join(owner, F.col("fp") == F.col("_fp")).drop("_fp")


def shingle_set(text: str | None, shingle: int = SET_SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order; none for a text without words.

    Each word is hashed once; a shingle mixes the hashes of its words in turn."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    of_words = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    grams = np.full(n, width, np.uint64)
    for k in range(width):
        grams = (grams ^ (grams >> np.uint64(29))) * MIX + of_words[k:k + n]
    grams = (grams ^ (grams >> np.uint64(32))) * MIX
    return np.unique((grams ^ (grams >> np.uint64(29))).view(np.int64))


def _key(grams: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(grams.tobytes(), SEED)


def _sets(tracks: DataFrame, shingle: int) -> DataFrame:
    """``fp, grams``: the shingle set of each document and its 128-bit name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 256):
                sets = [shingle_set(t, shingle) for t in batch["document"][part:part + 256]]
                yield pd.DataFrame({"fp": [_key(g) for g in sets], "grams": sets})

    return track_documents(tracks).mapInPandas(run, "fp binary, grams array<long>")


def set_fingerprint(grams: np.ndarray) -> int:
    """The SimHash of a shingle set as a signed 64-bit number; 0 for an empty one."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(grams), _PIECE):
        bits = np.unpackbits(grams[start:start + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)[0])


def _set_names(tracks: DataFrame, shingle: int) -> DataFrame:
    """``track_id, digest, fp, bits``: 64 bits of each document, the name of its
    shingle set and the set's fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named = [(_key(g), set_fingerprint(g)) for g in (shingle_set(t, shingle) for t in batch["document"])]
            yield pd.DataFrame({
                "track_id": batch["track_id"].astype("Int64").values, "digest": batch["digest"],
                "fp": [n for n, _ in named], "bits": np.array([b for _, b in named], np.int64)})

    rows = tracks.select("track_id", "document", F.xxhash64("document").alias("digest"))
    return rows.mapInPandas(run, "track_id long, digest long, fp binary, bits long")


def _first_shingles(tracks: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``gram, fp, size, at``: of each set the shingles, rare ones first, of which
    a set that similar must have one; those only that two documents have. And
    ``fp, marks``: which of ``FEW_MARKS`` places the shingles of each set fall on."""
    some = tracks.filter(F.pmod(F.xxhash64("document"), F.lit(ORDER_SHARE)) == 0)
    counts = _sets(some, shingle).select(F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = most_frequent(checkpoint(counts), ORDER_SHINGLES).toPandas().sort_values("gram")
    order = tracks.sparkSession.sparkContext.broadcast(
        (known["gram"].to_numpy(np.int64), known["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, often = order.value
        for batch in batches:
            for part in range(0, len(batch), 256):
                rows = []
                for text in batch["document"][part:part + 256]:
                    grams = shingle_set(text, shingle)
                    rank = np.zeros(len(grams), np.int64)
                    if len(listed) and len(grams):
                        place = np.minimum(np.searchsorted(listed, grams), len(listed) - 1)
                        rank = np.where(listed[place] == grams, often[place], 0)
                    first = len(grams) - _least_common(len(grams), similarity) + 1
                    marks = np.frombuffer(_marks(grams, FEW_MARKS), np.int64)
                    rows.append((_key(grams), len(grams), grams[np.lexsort((grams, rank))][:first], marks))
                yield pd.DataFrame(rows, columns=["fp", "size", "first", "marks"])

    firsts = checkpoint(track_documents(tracks).mapInPandas(
        run, "fp binary, size int, first array<long>, marks array<long>"))
    # Most shingles stand in one document, so they are counted alone and first.
    often = firsts.select(F.explode("first").alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    often = checkpoint(often)
    n = often.count()
    places = firsts.select("fp", "size", F.posexplode("first").alias("at", "gram"))
    places = places.join(F.broadcast(often) if n <= BROADCAST_ROWS else often, "gram").distinct()
    return places, firsts.select("fp", "marks")


def _least_common(size: int, similarity: float) -> int:
    return int(np.ceil(similarity * size - 1e-9))


def _may_reach(similarity: float):
    """Whether sets ``x`` and ``y`` that have a first shingle in common can be
    similar, by their sizes and by what comes after it."""
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    return left * (1 + similarity) >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-6


def _marks(grams: np.ndarray, marks: int = MARKS) -> bytes:
    """The places of a set's shingles among ``marks``, a bit each."""
    bits = np.zeros(marks, np.uint8)
    bits[grams & (marks - 1)] = 1
    return np.packbits(bits).tobytes()


def _may_share(similarity: float):
    """Whether sets ``x`` and ``y`` can be similar by their marks: a mark the other
    set lacks is a shingle at least that it lacks."""
    lacks = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    most = F.least(
        F.col("x.size") - lacks(F.col("x.marks"), F.col("y.marks")),
        F.col("y.size") - lacks(F.col("y.marks"), F.col("x.marks")))
    return most * (1 + similarity) >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-6


def _possible(similarity: float):
    """Pairs without those whose marks show that too few shingles can be common:
    a mark the other set lacks is a shingle at least that it lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("of_a", "of_b"))
                most = np.minimum(
                    batch["size_a"].to_numpy() - np.bitwise_count(x & ~y).sum(1, dtype=np.int64),
                    batch["size_b"].to_numpy() - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                both = (batch["size_a"] + batch["size_b"]).to_numpy()
                yield batch.loc[most * (1 + similarity) >= similarity * both - 1e-6, ["a", "b"]]

    return run


def _named_sets(tracks: DataFrame, pairs: DataFrame, shingle: int, marks: bool) -> DataFrame:
    """``fp, size, grams`` of the sets in ``pairs``: their marks or the shingles."""
    named = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    n = named.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 256):
                sets = [shingle_set(t, shingle) for t in batch["document"][part:part + 256]]
                yield pd.DataFrame({
                    "fp": [_key(g) for g in sets], "size": [len(g) for g in sets],
                    "grams": [_marks(g) for g in sets] if marks else sets})

    sets = track_documents(tracks).mapInPandas(
        run, f"fp binary, size int, grams {'binary' if marks else 'array<long>'}")
    sets = sets.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, "fp", "left_semi")
    sets = sets.groupBy("fp").agg(F.first("size").alias("size"), F.first("grams").alias("grams"))
    return checkpoint(sets)


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda k: sets.select(
        F.col("fp").alias(k), F.col("size").alias(f"size_{k}"), F.col("grams").alias(f"of_{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def _similar(pairs: DataFrame, tracks: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets are that similar."""
    pairs = checkpoint(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    marked = _beside(pairs, _named_sets(tracks, pairs, shingle, True))
    pairs = checkpoint(marked.mapInPandas(_possible(similarity), "a binary, b binary"))
    both = _beside(pairs, _named_sets(tracks, pairs, shingle, False))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return checkpoint(both.filter(
        common >= similarity * (F.col("size_a") + F.col("size_b") - common) - 1e-9).select("a", "b"))


def tree_candidates(values: DataFrame) -> DataFrame:
    """``a, b``: pairs of names ``fp`` of sets whose fingerprints ``bits`` a BK-tree
    finds near each other, or that have one fingerprint."""
    leads = checkpoint(values.groupBy("bits").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("n")))
    found = near_links(leads.select(F.col("bits").alias("fp")), links_of=nearest_links)
    of = lambda k: leads.select(F.col("bits").alias(k), F.col("lead").alias(f"_{k}"))
    near = found.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = values.join(leads.filter("n > 1"), "bits").filter(F.col("fp") != F.col("lead"))
    return near.unionByName(same.select(F.col("fp").alias("a"), F.col("lead").alias("b")))


def similar_links(
    tracks: DataFrame, values: DataFrame, shingle: int, similarity: float, list_size: int = LIST_SIZE,
) -> DataFrame:
    """``a, b``: links between the names ``fp`` of shingle sets, ``values(fp, bits)``,
    that connect all that are ``similarity`` or more alike."""
    lists, marks = _first_shingles(tracks, shingle, similarity)
    lists = checkpoint(lists)
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = checkpoint(lists.join(sizes, "gram"))
    many = shared.filter(F.col("n") > list_size)
    fields = ["fp", "size", "at"]
    side = lambda rows, name, *more: rows.select("gram", *more, F.struct(*fields).alias(name))
    ends = [F.col("x.fp").alias("a"), F.col("y.fp").alias("b")]
    turn = F.row_number().over(Window.partitionBy("gram").orderBy("fp"))
    centres = many.withColumn("_k", turn).filter(F.col("_k") <= CENTRES)
    stars = side(many, "x").join(side(centres, "y"), "gram").filter(F.col("x.fp") > F.col("y.fp"))
    stars = stars.filter(_may_reach(similarity)).select(ends)
    links = _similar(tree_candidates(values).unionByName(stars), tracks, shingle, similarity)
    # Whatever is not in one group by now is compared as well; in long lists only
    # if the marks of the two sets allow it.
    tied = checkpoint(connected(links))
    placed = shared.join(tied, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    few, many = placed.filter(F.col("n") <= list_size), placed.filter(F.col("n") > list_size)

    def apart(rows: DataFrame) -> DataFrame:
        pairs = side(rows, "x", F.col("root").alias("p")).join(side(rows, "y", F.col("root").alias("q")), "gram")
        return pairs.filter((F.col("p") != F.col("q")) & (F.col("x.fp") > F.col("y.fp")) & _may_reach(similarity))

    rest = apart(few).select(ends)
    fields.append("marks")
    many = many.join(marks.join(many.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "fp")
    rest = rest.unionByName(apart(many).filter(_may_share(similarity)).select(ends))
    return links.unionByName(_similar(rest, tracks, shingle, similarity)).distinct()


def similar_documents(
    tracks: DataFrame, shingle: int = SET_SHINGLE, similarity: float = SIMILARITY, list_size: int = LIST_SIZE,
) -> DataFrame:
    """Groups of track documents by the similarity of their shingle sets.

    In: ``track_id, document``. Out, one row for each row in: ``track_id`` and
    ``component_id``, the least ``track_id`` reachable over pairs whose sets of
    ``shingle`` words have a Jaccard similarity of ``similarity`` or more (null
    where no document of the group has an id). Words are those of ``fingerprint``;
    a shorter text is one shingle, and texts without words are alike. Pairs come
    from BK-trees of the sets' SimHash fingerprints and, where these leave sets
    apart, from first shingles in common; each is compared exactly, so every pair
    that similar is found. An empty table gives none.
    """
    groups = _similar_groups(tracks, shingle, similarity, list_size)
    return groups.select("track_id", F.col("component_id.track_id").alias("component_id"))


def _similar_groups(tracks: DataFrame, shingle: int, similarity: float, list_size: int) -> DataFrame:
    """``track_id, digest`` of each row; ``component_id`` is the first of its group:
    ``none`` (it has no id), ``track_id`` and ``digest``."""
    rows = checkpoint(_set_names(tracks, shingle))
    place = F.struct(F.col("track_id").isNull().alias("none"), "track_id", "digest")
    values = checkpoint(rows.groupBy("fp").agg(F.min(place).alias("low"), F.min("bits").alias("bits")))
    tied = connected(similar_links(tracks, values.select("fp", "bits"), shingle, similarity, list_size))
    return _grouped(rows, values, tied).select("track_id", "digest", "component_id")


def distinct_documents(
    tracks: DataFrame, shingle: int = SET_SHINGLE, similarity: float = SIMILARITY, list_size: int = LIST_SIZE,
) -> DataFrame:
    """One track document of each group that ``similar_documents`` makes.

    In: ``track_id, document`` and any columns that can be ordered, all of which
    stay. Out: of each group the row of least ``track_id`` (null last), of those
    with one id the row of least digest, of rows with equal id and text the one
    whose other columns come first; so repeated rows leave one. Texts without
    words, null among them, are one group. An empty table gives none.
    """
    groups = _similar_groups(tracks, shingle, similarity, list_size)
    first = F.struct(F.col("track_id").isNull().alias("none"), "track_id", "digest")
    led = groups.filter(first == F.col("component_id")).groupBy(
        F.col("component_id.none").alias("_none"), F.coalesce("component_id.track_id", F.lit(0)).alias("_id"),
        F.col("component_id.digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_copies"))
    keyed = tracks.withColumns({
        "_none": F.col("track_id").isNull(), "_id": F.coalesce("track_id", F.lit(0)), "_digest": F.xxhash64("document")})
    kept = keyed.join(checkpoint(led), ["_none", "_id", "_digest"])
    alone = kept.filter("_copies = 1").select(tracks.columns)
    repeated = kept.filter("_copies > 1").groupBy("_none", "_id", "_digest").agg(
        F.min(F.struct(*tracks.columns)).alias("_row")).select("_row.*")
    return alone.unionByName(repeated.select(tracks.columns))
