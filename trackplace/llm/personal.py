"""Personal data: fixed forms, and candidates that boosted trees take for the same.

Fixed forms take the longest stretch and are then checked, so a telephone number
with a card number right behind it fails as a whole. Generators with tighter
forms propose such spans again, overlapping each other; trees score format and
context, and a threshold per kind, set on held-out documents, chooses.

Everything that touches a text is a DataFrame expression. A pattern never
repeats a group without bound, as the JVM would use stack for each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackplace.llm import boosting
from trackplace.llm.words import is_training, track_documents
from trackplace.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
# Stands for a separator that joins what is on both sides of it.
JOINT = "\x01"
_LOCAL = rf"[A-Za-z0-9._%+{JOINT}-]"
# The base forms, over texts whose joining separators are marked.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{JOINT}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
JOINING = {
    "email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
    "card": r"(?<=[0-9])[\x20-](?=[0-9])",
}
# Tighter or looser forms that propose candidates of a kind.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT|@)[\])}]\x20?[A-Za-z0-9-]{1,63}"
              r"(?:\x20?(?:\.|[\[({](?:dot|DOT|\.)[\])}])\x20?[A-Za-z0-9-]{2,63}){1,4}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?:\.|\[\.\])[0-9]{1,3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])3[47][0-9]{2}([\x20-]?)[0-9]{6}\1[0-9]{5}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}(?![0-9])){1,4}"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
CONTEXT = 24
HINTS = {
    "email": "mail|contact|write|address|reach", "ip": r"\bip\b|host|addr|server|client|from",
    "card": "card|visa|credit|payment|account|amex|master", "phone": "phone|tel|call|mobile|fax|dial|contact",
}
FEATURES = ("kind", "digits", "length", "checks", "plus", "separators", "hint", "glued")
# Values a feature takes, from 0. What a corpus can have of vectors is their
# product (885,600), so all of them are learned from, however large it is.
RANGES = (len(KINDS), 25, 41, 2, 2, 9, 2, 3)
TREES, DEPTH, PRECISION = 20, 3, 0.9
STEP = 256


def _running(rows: DataFrame, array: str, value, combine, start: Column, into: str) -> DataFrame:
    """Adds, per element of ``array``, the combined value of those before it.

    In two levels, so that a row with very many elements takes linear time.
    Arrays go through functions zipped, never looked up in by index: Catalyst may
    put the expression of an array that is used once in its place, and then makes
    the array again for each element.
    """
    zero = F.array().cast("array<bigint>")
    cut = F.transform(
        F.sequence(F.lit(0), F.expr(f"(size({array}) - 1) div {STEP}")),
        lambda k: F.slice(F.col(array), k * STEP + 1, F.lit(STEP)))
    rows = rows.withColumn("_cut", F.when(F.size(array) > 0, cut).otherwise(F.slice(F.array(F.col(array)), 1, 0)))
    step = lambda v: lambda a, x: F.struct(
        combine(a["sum"], v(x)).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
    begin = lambda s: F.struct(s.alias("sum"), zero.alias("out"))
    whole = F.transform("_cut", lambda part: F.aggregate(part, start, lambda a, x: combine(a, value(x))))
    rows = rows.withColumn("_sums", F.aggregate(whole, begin(start), step(lambda x: x))["out"])
    return rows.withColumn(into, F.flatten(F.transform(
        F.arrays_zip("_cut", "_sums"), lambda z: F.aggregate(z["_cut"], begin(z["_sums"]), step(value))["out"]
    ))).drop("_cut", "_sums")


def _matches(rows: DataFrame, text: str, pattern: str, into: str) -> DataFrame:
    """Adds the matches as ``(start, end, text, before, after)``; offsets count
    code points from 0, the end is left out."""
    rows = rows.withColumn("_found", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))))
    n = F.size("_found")
    rows = rows.withColumns({"_left": F.slice("_gaps", F.lit(1), n), "_right": F.slice("_gaps", F.lit(2), n)})
    rows = rows.withColumn("_both", F.transform(F.arrays_zip("_found", "_left", "_right"), lambda z: F.struct(
        F.length(z["_left"]).cast("long").alias("gap"), F.length(z["_found"]).cast("long").alias("own"),
        z["_found"].alias("text"), F.right(z["_left"], F.lit(CONTEXT)).alias("before"),
        F.left(z["_right"], F.lit(2)).alias("after"))))
    rows = _running(
        rows, "_both", lambda x: x["gap"] + x["own"], lambda a, b: a + b, F.lit(0).cast("long"), "_base")
    spans = F.transform(F.arrays_zip("_both", "_base"), lambda z: F.struct(
        (z["_base"] + z["_both"]["gap"]).alias("start"),
        (z["_base"] + z["_both"]["gap"] + z["_both"]["own"]).alias("end"),
        *[z["_both"][c].alias(c) for c in ("text", "before", "after")]))
    return rows.withColumn(into, spans).drop("_found", "_gaps", "_left", "_right", "_both", "_base")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check (at most 19 are asked)."""
    each = F.transform(F.reverse(F.split(F.left(digits, F.lit(19)), "")), lambda c, i: (
        F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1))
        .otherwise(c.try_cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(text: Column) -> Column:
    parts = F.split(F.replace(F.replace(text, F.lit("["), F.lit("")), F.lit("]"), F.lit("")), r"\.")
    return F.forall(parts, lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))


def _valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return _octets(text)
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _features(kind: str, x: Column) -> Column:
    """Small integers; none of them says which form proposed the span."""
    text, digits = x["text"], F.length(_digits(x["text"]))
    checks = {"card": _luhn(_digits(text)), "ip": _octets(text)}.get(kind, F.lit(True))
    glued = x["before"].rlike(r"[\p{L}\p{N}]$").cast("int") + x["after"].rlike(r"^[\p{L}\p{N}]").cast("int")
    return F.array(*[c.cast("int") for c in (
        F.lit(KINDS.index(kind)), F.least(digits, F.lit(24)), F.least(F.length(text), F.lit(40)),
        checks.cast("int"), F.startswith(text, F.lit("+")).cast("int"),
        F.least(F.length(F.regexp_replace(text, r"[\p{L}\p{N}]", "")), F.lit(8)),
        F.lower(x["before"]).rlike(HINTS[kind]).cast("int"), glued)])


def _proposals(tracks: DataFrame) -> DataFrame:
    """``track_id, held, base, failed, proposed, labelled``: valid base spans
    ``(start, kind, end)`` in order, base matches that failed their check, spans of
    the generators with features, and features of base matches with the outcome."""
    rows = track_documents(tracks).select(
        "track_id", F.translate(F.coalesce("document", F.lit("")), JOINT, "\x02").alias("_text"))
    rows = rows.withColumn("_digit", F.when(F.col("_text").rlike("[0-9]"), F.col("_text")).otherwise(""))
    rows = rows.withColumns({
        "_email": F.when(F.col("_text").contains("@"), F.regexp_replace("_text", JOINING["email"], JOINT)).otherwise(""),
        "_ip": F.col("_digit"), "_card": F.regexp_replace("_digit", JOINING["card"], JOINT), "_phone": F.col("_digit"),
        "_at": F.when(F.col("_text").rlike(r"[\[({](?:at|AT|@)[\])}]"), F.col("_text")).otherwise(""),
    })
    for kind in KINDS:
        rows = _matches(rows, f"_{kind}", BASE[kind], f"_base_{kind}")
    for n, (kind, pattern) in enumerate(GENERATORS):
        rows = _matches(rows, "_at" if kind == "email" else "_digit", pattern, f"_more_{n}")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans, failed, proposed = none, none, F.array().cast(
        "array<struct<start:bigint,kind:int,end:bigint,f:array<int>>>")
    labelled = F.array().cast("array<struct<f:array<int>,positive:bigint>>")
    brief = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    full = lambda k: lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end"), _features(k, x).alias("f"))
    for k, kind in enumerate(KINDS):
        found = F.col(f"_base_{kind}")
        spans = F.concat(spans, F.transform(F.filter(found, lambda x: _valid(kind, x["text"])), brief(k)))
        failed = F.concat(failed, F.transform(F.filter(found, lambda x: ~_valid(kind, x["text"])), brief(k)))
        outcome = lambda k: lambda x: F.struct(
            _features(k, x).alias("f"), _valid(k, x["text"]).cast("long").alias("positive"))
        labelled = F.concat(labelled, F.transform(found, outcome(kind)))
    for n, (kind, _) in enumerate(GENERATORS):
        proposed = F.concat(proposed, F.transform(f"_more_{n}", full(kind)))
    slim = rows.select(
        "track_id", (~is_training(F.col("track_id"))).alias("held"), F.array_sort(spans).alias("base"),
        failed.alias("failed"), F.array_distinct(proposed).alias("proposed"), labelled.alias("labelled"))
    return checkpoint(slim)


def _untouched(rows: DataFrame) -> DataFrame:
    """Adds ``free``: proposals that no base span touches. One walk forward for
    the furthest end so far, one backward for the next start."""
    mark = lambda kept: lambda x: F.struct(
        x["start"].alias("start"), F.lit(kept).alias("mine"), x["end"].alias("end"),
        (x["f"] if kept else F.array().cast("array<int>")).alias("f"), x["kind"].alias("kind"))
    rows = rows.withColumn("_all", F.array_sort(F.concat(
        F.transform("base", mark(0)), F.transform("proposed", mark(1)))))
    far = F.lit(2**62).cast("long")
    rows = _running(
        rows, "_all", lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(F.lit(-1).cast("long")),
        lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"), "_ended")
    rows = rows.withColumn("_back", F.reverse("_all"))
    rows = _running(
        rows, "_back", lambda x: F.when(x["mine"] == 0, x["start"]).otherwise(far),
        lambda a, b: F.least(a, b), far, "_next")
    rows = rows.withColumn("_next", F.reverse("_next"))
    untouched = lambda z: (
        (z["_all"]["mine"] == 1) & (z["_ended"] <= z["_all"]["start"]) & (z["_next"] >= z["_all"]["end"]))
    return rows.withColumn("free", F.transform(
        F.filter(F.arrays_zip("_all", "_ended", "_next"), untouched), lambda z: z["_all"])).drop(
        "_all", "_ended", "_back", "_next")


def _outermost(rows: DataFrame) -> DataFrame:
    """Leaves out added spans that lie within another added span."""
    rows = rows.withColumn("_wide", F.array_sort(F.transform("added", lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind")))))
    rows = _running(
        rows, "_wide", lambda x: -x["back"], lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"), "_reached")
    open_ = F.filter(F.arrays_zip("_wide", "_reached"), lambda z: -z["_wide"]["back"] > z["_reached"])
    return rows.withColumn("added", F.transform(open_, lambda z: F.struct(
        z["_wide"]["start"].alias("start"), z["_wide"]["kind"].alias("kind"), (-z["_wide"]["back"]).alias("end")))).drop(
        "_wide", "_reached")


def _counted(slim: DataFrame) -> pd.DataFrame:
    """Every feature vector of base matches, a number each, with its cases and
    positive ones in learned and in held-out documents."""
    code = F.lit(0).cast("long")
    for i, values in enumerate(RANGES):
        code = code * values + F.get("f", F.lit(i))
    cases = slim.select("held", F.explode("labelled").alias("x")).select("held", "x.*")
    return cases.groupBy("held", code.alias("code")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("positive").alias("positive")).toPandas()


def _model(slim: DataFrame, trees: int, depth: int, precision: float):
    """Trees over all feature vectors with their cases, thresholds per kind from
    held-out documents; None when one of the classes is missing."""
    rows = _counted(slim).sort_values(["cases", "held", "code"], ascending=[False, True, True])
    x = np.stack(np.unravel_index(rows["code"].to_numpy(np.int64), RANGES), 1).astype(float).reshape(-1, len(RANGES))
    cases, positive = rows["cases"].to_numpy(float), rows["positive"].to_numpy(float)
    held = rows["held"].to_numpy(bool)
    if not positive[~held].any() or not (cases > positive)[~held].any():
        return None
    split = lambda some: (x[some], cases[some], positive[some])
    fitted = boosting.fit(*split(~held), trees, depth)
    limits = []
    for k in range(len(KINDS)):
        some = held & (x[:, 0] == k)
        some = some if some.any() else ~held & (x[:, 0] == k)
        limits.append(boosting.threshold(boosting.probability(fitted, x[some]), *split(some)[1:], precision)
                      if some.any() else 2.0)
    return fitted, limits


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal(
    tracks: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION,
) -> DataFrame:
    """Personal data in each track document.

    In: ``track_id, document``. Out, one row for each row in: ``n_email, n_ip,
    n_card, n_phone`` and ``base_sha256`` of the base spans, ``spans`` with those
    added (``kind:start:end``, code points, end exclusive, ordered by start, then
    kind; of added spans within each other the outermost), and ``n_added``. Trees learn from base matches, those that pass their
    check against those that fail it; with no such pair nothing is added. A null
    document is an empty one, whole texts are searched, repeated rows are each
    answered, and an empty table gives none.
    """
    slim = _proposals(tracks)
    model = _model(slim, trees, depth, precision)
    bare = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if model is None:
        rows = slim.withColumn("added", bare)
    else:
        fitted, limits = model
        odds = [float(np.log(t / (1 - t))) if 0 < t < 1 else (-1e9 if t <= 0 else 1e9) for t in limits]
        least = F.array(*[F.lit(o - 1e-9) for o in odds])
        chosen = lambda x: boosting.compiled(fitted, lambda i: F.get(x["f"], i)) >= F.get(least, x["kind"])
        rows = _untouched(slim).withColumn("added", F.array_except(F.transform(
            F.filter("free", chosen),
            lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))), "failed"))
    rows = _outermost(rows)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "track_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
