import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a.example.com", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a.example.com", 1),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n\x0b ", "xx", "b", 0),
    (6, "Ünï cödé 日本 😀 \xa0 don't I'll <|endoftext|>", "de", "B.example.com", 9),
    (7, LONG, "en", "a.example.com", 1),
    (None, "no id at all here", "en", "b", 1),
    (8, "one", "fr", "", 3),
    (8, "one", "fr", "", 3),
    (9, "A" * 5000, "fr", "c", 3),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Write tables as Parquet and give their folder."""

    def write(**frames):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
