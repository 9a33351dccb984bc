"""Mixing sources to target weights by a low-discrepancy schedule of blocks.

Slot k of the schedule has the point ``k * A mod 2^31`` (A is the golden
section of 2^31), a lattice that fills every interval evenly. The point falls
into one source's share of the cumulative targets; the slot's rank among the
slots of that source says which block of the source's shuffled words it takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackplace.llm.words import SPACE_CLASS, settled, track_documents, trimmed, word_count
from trackplace.session import checkpoint

# The lattice, and the weights sources take in turn.
POINTS = 2**31
GOLDEN = 1327217885
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 512
# Parts a source's documents, and ranges the slots, are counted in.
PARTS = 4096
SLOT_RANGE = 1 << 16
CELLS = 1024


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES,
) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code point order, null last, take ``weights`` in turn. A target
    stops at ``passes`` times its source; the excess goes to the others by
    weight. Sorted by that limit per weight, the sources that stop come first,
    so one pass over running sums finds the level all others share. The window
    goes over one row per source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)
    sums = sums.withColumn("w", weight).withColumn("most", passes * F.col("source_size"))
    by_limit = Window.partitionBy(F.lit(0)).orderBy(
        F.col("most").cast("double") / F.col("w"), F.asc_nulls_last("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast(
        "double") / F.sum("w").over(after)
    sums = sums.withColumn("level", level)
    fits = F.col("most").cast("double") / F.col("w") > F.col("level")
    shared = F.min(F.when(fits, F.struct(F.col("most").cast("double") / F.col("w"), "source", "level"))).over(every)
    sums = sums.withColumn("shared", shared["level"])
    stops = ~fits | F.col("shared").isNull()
    target = F.when(stops, F.col("most").cast("double")).otherwise(F.col("shared") * F.col("w"))
    return sums.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], part: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key, in two levels: totals per
    part first, so that no task holds more than one part of a key."""
    totals = rows.groupBy(*keys, part).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    right = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(part).alias("_part"), "_before")
    on = (F.col(part) == F.col("_part"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(right, on, "left")
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop(
        "_inside", "_before", "_part", *[f"_{k}" for k in keys])


def _slots(plans: DataFrame, block: int) -> DataFrame:
    """``source, rank`` of each slot, as many ranks per source as it needs blocks.

    The schedule has a slot per block of the whole mix. What the points give a
    source beyond its need is left out, and the few blocks they leave open come
    after the last slot.
    """
    spark = plans.sparkSession
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    # Whole numbers of more than 64 bits: no rounding moves a border between sources.
    words = F.floor("target").cast("decimal(20,0)")
    spans = plans.withColumn("_to", F.sum(words).over(by_name)).withColumn("_all", F.sum(words).over(every))
    spans = spans.withColumn("high", F.when(F.col("_all") > 0, F.expr(f"(_to * {POINTS}) div _all")))
    spans = spans.withColumn("low", F.coalesce(F.lag("high").over(
        Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))), F.lit(0)))
    spans = spans.filter(F.col("high") > F.col("low"))
    width = POINTS // CELLS
    spans = spans.withColumn("cell", F.explode(F.sequence(
        F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    total = plans.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]
    slots = spark.range(total).select(
        F.col("id").alias("slot"),
        F.pmod(F.pmod("id", F.lit(POINTS)) * GOLDEN, F.lit(POINTS)).alias("point"),
    ).withColumn("cell", F.expr(f"point div {width}"))
    hit = slots.join(spans, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    hit = hit.select("source", "needed", "slot", F.expr(f"slot div {SLOT_RANGE}").alias("range"))
    ranked = _running(hit, ["source"], "range", [F.col("slot")], F.lit(1).cast("long"), "rank")
    ranked = ranked.filter(F.col("rank") < F.col("needed")).select("source", "slot", "rank")
    given = hit.groupBy("source").agg(F.count(F.lit(1)).alias("given"))
    needs = plans.select(F.col("source").alias("_source"), "needed")
    open_ = needs.join(given, F.col("_source").eqNullSafe(F.col("source")), "left").withColumn(
        "given", F.coalesce("given", F.lit(0))).filter(F.col("needed") > F.col("given"))
    rest = open_.select(F.col("_source").alias("source"), F.lit(total).alias("slot"), F.explode(
        F.sequence("given", F.col("needed") - 1)).alias("rank"))
    return ranked.unionByName(rest)


def mix_sources(
    tracks: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS, seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """The schedule of a mix, and its targets, as ``(pieces, sizes)``.

    In: ``track_id, document, source``. ``pieces`` says for each slot which
    words of which track document it takes: ``slot, source, track_id, digest,
    row, first, words``. ``sizes`` has ``row, track_id, digest, source, size,
    source_size, target`` for each row in, ``row`` being its place in the
    source's shuffled words and unique together with the source and size;
    ``digest`` are 64 bits of the document.

    A source's documents are shuffled by digest, its words cut into blocks of
    ``block_words``, and its target is taken block by block, in as many passes
    as it needs, the last block only as far as the target goes. Null is a source
    of its own, null and empty documents have no words, repeated rows count each
    time, and an empty table gives an empty mix.
    """
    rows = track_documents(tracks, "source").select(
        "track_id", "source", F.xxhash64("document").alias("digest"), word_count(F.col("document")).alias("size"))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("track_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("place", place).withColumn(
        "part", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    rows = checkpoint(rows)
    targets = source_targets(rows, weights, passes)
    whole = F.col("source_size")
    full = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(0)
    plans = targets.withColumn("full", full).withColumn(
        "rest", F.floor(F.col("target")) - F.col("full") * whole)
    blocks = F.ceil(whole / block_words)
    plans = plans.withColumn("blocks", blocks).withColumn(
        "needed", F.col("full") * F.col("blocks") + F.ceil(F.greatest("rest", F.lit(0)) / block_words))
    plans = checkpoint(plans)
    placed = _running(
        rows, ["source"], "part", [F.col("place"), F.asc_nulls_last("track_id"), F.col("size"), F.col("digest")],
        F.col("size"), "row")
    known = plans.select(F.col("source").alias("_source"), "source_size", "target", "full", "rest", "blocks")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "place", "part")
    sizes = checkpoint(placed)
    docs = sizes.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(
        F.expr(f"row div {block_words}"), F.expr(f"(row + size - 1) div {block_words}"))))
    slots = _slots(plans, block_words)
    slots = slots.withColumnRenamed("source", "_source").join(
        plans.select(F.col("source").alias("_s"), F.col("blocks").alias("_blocks")),
        F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    slots = slots.withColumn("_block", F.pmod("rank", "_blocks")).withColumn("pass", F.expr("rank div _blocks"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    joined = docs.join(slots.select("_source", "_block", "slot", "pass"), same)
    # The last, open pass ends at the target.
    end = F.when(F.col("pass") < F.col("full"), F.col("source_size")).otherwise(F.col("rest"))
    first = F.greatest("row", F.col("block") * block_words)
    last = F.least(F.col("row") + F.col("size"), (F.col("block") + 1) * block_words, end)
    pieces = joined.select(
        "slot", "source", "track_id", "digest", "row", "size", (first - F.col("row")).alias("first"),
        (last - first).alias("words"),
    ).filter(F.col("words") > 0)
    return pieces, sizes.select("track_id", "digest", "source", "row", "size", "source_size", "target")


def mixed_documents(tracks: DataFrame, **options) -> DataFrame:
    """Per row in: ``track_id, source, size, source_size, target, taken,
    first_slot``: the words its pieces of the schedule take, and the first slot
    that takes any (null if none does)."""
    pieces, sizes = mix_sources(tracks, **options)
    took = pieces.groupBy("source", "row", "size", "track_id").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    took = took.select(*[F.col(c).alias(f"_{c}") for c in took.columns])
    on = (
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("row") == F.col("_row"))
        & (F.col("size") == F.col("_size")) & F.col("track_id").eqNullSafe(F.col("_track_id"))
    )
    joined = sizes.join(took, on, "left")
    return joined.select(
        "track_id", "source", "size", "source_size", "target",
        F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.col("_first_slot").alias("first_slot"))


def mixed_texts(tracks: DataFrame, **options) -> DataFrame:
    """The mix itself: ``slot, source, track_id, row, first, words, document``,
    a row for each piece of a slot.

    In: ``track_id, document, source``, as for ``mix_sources``. ``document`` is
    the stretch of the text from the first to the last of the piece's words, or
    the text as it is where the piece has all its words. Pieces of a slot follow
    one another by ``row``; slots in order make the schedule, and those after
    the last one share its number. Each text is cut once for all its pieces.
    """
    pieces, _ = mix_sources(tracks, **options)
    key = lambda rows: rows.withColumns({
        "_none": F.col("track_id").isNull(), "_id": F.coalesce("track_id", F.lit(0)),
        "_source": F.coalesce("source", F.lit("\x00")), "_digest": F.col("digest")})
    keys = ["_none", "_id", "_source", "_digest"]
    # A document has as many pieces as blocks and passes: few, for its length.
    listed = key(pieces).groupBy(*keys).agg(
        F.collect_list(F.struct("slot", "row", "first", "words", "size")).alias("_pieces"),
        F.countDistinct("row").alias("_copies"))
    texts = key(track_documents(tracks, "source").withColumn("digest", F.xxhash64("document")))
    joined = texts.join(listed, keys)
    # Where a word ends: each part is a word with the spaces before it.
    ends = f"(?<=[^\\x20\\x09-\\x0D])(?={SPACE_CLASS})"
    cut = settled(
        joined, "track_id", "source", "document", "_pieces", "_copies",
        _parts=F.when(F.exists("_pieces", lambda p: p["words"] < p["size"]), F.split(trimmed(F.col("document")), ends)))
    each = cut.select("track_id", "source", "document", "_parts", "_copies", F.explode("_pieces").alias("p"))
    piece = F.array_join(F.slice("_parts", F.col("p.first").cast("int") + 1, F.col("p.words").cast("int")), "")
    each = each.select(
        "_copies", "p.slot", "source", "track_id", "p.row", "p.first", "p.words",
        F.when(F.col("p.words") == F.col("p.size"), F.col("document")).otherwise(trimmed(piece)).alias("document"))
    # Each of several equal rows has met the pieces of all of them.
    out = each.filter("_copies = 1").unionByName(each.filter("_copies > 1").dropDuplicates(
        ["slot", "source", "track_id", "row", "first"]))
    return out.drop("_copies")
