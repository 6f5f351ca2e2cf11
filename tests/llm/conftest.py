import pytest

LONG = " ".join(f"word{i % 997}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, id string, sha string, n long, digest string, keep_id long, fp long, component_id long, shard int, slot long, part int, size long, th int, score double, key string"
    texts = [
        (1, "The same text, twice."), (2, "the same TEXT, twice."), (3, None), (4, ""), (5, "   \t\n"), (None, "no id here"), (None, "no id here"),
        (6, LONG), (7, LONG), (8, "Ünïcödé ÄÖ words ▁ and 　 marks"), (9, "x"), (9, "x"), (10, "a\x0bb\x0cc d"), (11, "NUL \x00 inside"),
    ]
    rows = [(d, t, "en", "hot", len(t or ""), "r", 1, "i", "s", 2, "d", 3, 4, 5, 6, 7, 8, 9, 10, 0.5, "k") for d, t in texts]
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
