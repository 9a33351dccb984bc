"""Secret scan: spans in fixed forms, and strings that compress badly next to what they stand in.

The text around a candidate is compressed with it and without it, primed with a
dictionary of identifiers and parts of words. Words, paths and constants made of
what occurs there cost a few bytes more; a random key costs nearly its whole length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from trackplace.llm.words import track_documents

KINDS = ("assign", "access", "hex")
# The base forms. Letters of the assign keywords count in either case.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
# Runs are maximal, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

# Where unlisted secrets are looked for: a sensitive word, then a long string.
SENSITIVE = re.compile(
    r"(?:credential|passphrase|private[ _-]?key|access[ _-]?key|client[ _-]?secret|auth(?:orization)?"
    r"|bearer|session[ _-]?id|signature|pwd|secret|token|api[ _-]?key|password|passwd)", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
REACH = 48
CONTEXT = 512
NOVELTY = 0.75
# Identifiers that often stand in code and settings.
IDENTIFIERS = (
    "abstract access address argument array assert async authorization await base64 boolean break buffer bytes"
    " callback catch char class client config connection const constructor content continue credentials database"
    " default delete description double encoding environment error exception export extends false final float"
    " function getenv global handler header hostname https import include index instance integer interface"
    " javascript json key length license localhost long message method module namespace null number object"
    " options package parameter password path private process protected public request resource response return"
    " secret server session settings signature static string struct super switch template this throw timeout"
    " token transient true typeof undefined unsigned username value variable version virtual void volatile while"
    " your_api_key_here changeme example placeholder 0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    " abcdefghijklmnopqrstuvwxyz 00000000000000000000000000000000"
)
# Parts that long words are often made of.
WORD_PARTS = (
    "tion sion ment ness able ible ance ence ings ations ated ates ating ology ography ectively ously ality ements"
    " ership hood ward wise fully less ism ists ization izing ized ically icals ogical ional inter trans super under"
    " counter over anti multi auto micro electro photo micro the and for with that this from have not are you can"
    " was one our out when what which their there about other more some time into than then them these only"
    " application authentication authorization certificate configuration controller directory environment"
    " international manager parameters provider project required service source template version"
)
OUT = (
    "track_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, novelty double"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in the fixed forms, ordered by start, then kind."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


@cache
def _coder() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(
        f"{WORD_PARTS} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(
        level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(text: str, start: int, end: int, context: int = CONTEXT) -> float:
    """Compressed bytes the candidate adds per byte to what surrounds it."""
    before, after = text[max(0, start - context):start], text[end:end + context]
    size = lambda t: len(_coder().compress(t.encode("utf-8", "replace")))
    candidate = text[start:end]
    return (size(before + candidate + after) - size(before + after)) / len(candidate.encode("utf-8", "replace"))


def added_spans(text: str, base: list[tuple[int, int, str]], least: float) -> list[tuple[int, int, str, float]]:
    """Candidates soon after a sensitive word whose novelty is ``least`` or more
    and that no base span touches. They are reported as ``assign``."""
    found, done = [], 0
    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, max(done, word.end()), min(len(text), word.end() + REACH + 256)):
            if m.start() > word.end() + REACH:
                break
            start, end = m.span()
            while end < len(text) and CANDIDATE.match(text[end] * 16):
                end += 1  # the search window may have cut it
            done = max(done, end)
            if any(s < end and start < e for s, e, _ in base):
                continue
            value = novelty(text, start, end)
            if value >= least:
                found.append((start, end, "assign", value))
    return found


def _line(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def scan_text(text: str | None, least: float = NOVELTY) -> tuple:
    """Counts per kind, digest of the base spans, all spans, highest novelty added."""
    text = text or ""
    base = base_spans(text)
    added = added_spans(text, base, least)
    counts = [sum(kind == k for _, _, kind in base) for k in KINDS]
    every = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    most = max((a[3] for a in added), default=None)
    return (*counts, hashlib.sha256(_line(base).encode()).hexdigest(), _line(every), most)


def scan_secrets(tracks: DataFrame, least: float = NOVELTY) -> DataFrame:
    """Secrets in each track document.

    In: ``track_id, document``. Out, one row for each row in: counts of base
    spans per kind, ``base_sha256`` and ``spans`` (``kind:start:end`` in code
    points, end exclusive), and ``novelty``, the highest among added spans. A
    null document is an empty one; whole texts are searched, a document at a
    time, so a task holds one Arrow batch; an empty table gives none.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan_text(t, least) for t in batch["document"]]
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty"])
            out.insert(0, "track_id", batch["track_id"].astype("Int64").values)
            yield out

    return track_documents(tracks).mapInPandas(scan, OUT)
