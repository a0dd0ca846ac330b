import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls in every column, empty and blank texts, repeated rows, ties, odd spaces, long words and texts.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and then runs away from the big bad wolf today", "en", "a", 88),
    (2, None, "en", "a", None),
    (3, "", "fr", None, 0),
    (4, "   \n\t ", None, "b", 6),
    (5, "The quick brown fox jumps over the lazy dog and then runs away from the big bad wolf today", "en", "a", 88),
    (5, "The quick brown fox jumps over the lazy dog and then runs away from the big bad wolf today", "en", "a", 88),
    (6, "12345 67890 --- !!!", "de", "c", 18),
    (7, "der schnelle braune Fuchs springt über den faulen Hund und läuft dann vor dem bösen Wolf davon", "de", "c", 94),
    (None, "le renard brun saute par dessus le chien paresseux et puis il court vers la forêt noire", "fr", "c", 87),
    (8, "word " * 6000, "en", "a", 30000),
    (9, "x" * 20000, "en", "a", 20000),
    (10, 'password = "hunter2hunter2hunter2" and token: aB3xK9pQ7zR2mN5v', "en", "b", 60),
    (11, "日本語 の テキスト é ́ a　b  two  spaces ", None, "d", 30),
    (12, "the", "en", "d", 3),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd):
    """Columns that bear the names of inner columns."""
    from pyspark.sql import functions as F

    for c in ("id", "tok", "a", "b", "n", "words", "seg", "spans", "media", "ids", "start", "length", "score", "component", "node", "th", "grp", "count"):
        odd = odd.withColumn(c, F.lit("clash"))
    return odd


@pytest.fixture
def write(spark, tmp_path):
    """Write tables as an input folder."""

    def go(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return go
