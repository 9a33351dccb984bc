"""Track documents with everything an operator has to live with."""

import pytest

WAY = "The rider left the town at dawn and came to the river with the sun still low"
SCHEMA = (
    "track_id long, document string, source string, lang string, words string, size long, _text string,"
    " h1 long, n int, score double, digest string"
)


def odd_rows():
    rows = [
        (1, f'<gpx creator="trackplace"><trk><name>{WAY}</name></trk></gpx>', "gps", "en"),
        (2, None, "gps", None), (3, "", "fused", "en"), (4, " \t\r\n\x0b\x0c ", None, "en"),
        (None, WAY, "gps", "en"), (5, WAY, None, "en"), (5, WAY, None, "en"), (5, WAY + " again", "gps", "de"),
        (6, "word " * 30_000, "gps", "en"), (7, "x" * 200_000, "fused", "en"),
        (8, "1 2 3 4 5 6 7 8 9 0 " * 4_000, "gps", "en"), (9, "ß é ñ Ω 漢字 🚲", "gps", "de"),
    ]
    # The columns after lang clash with names that operators use inside.
    return [(*r, "w", 7, "t", 1, 2, 0.5, "d") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tracks_of(spark):
    def build(rows):
        full = [(*r, None, None)[:4] for r in rows]
        return spark.createDataFrame(full, "track_id long, document string, source string, lang string")

    return build
