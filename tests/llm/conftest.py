import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Texts that break things: null, empty, blank, repeated, very long, columns that clash."""
    near = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One two three"), (4, "One two three"),
        (5, near), (6, near.replace("w299", "changed")), (7, "x " * 50_000), (8, "ONE TWO THREE"),
        (9, "Été À la plage\nsame line\nEND"), (None, "no id here\nsame line"),
        *((20 + i, f"unique {i} text\n  Same Line \nend {i}") for i in range(12)),
    ]
    return spark.createDataFrame(
        [(i, t, "en", None if i == 9 else f"s{(i or 0) % 3}", len(t or ""), -1, "k")
         for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, component_id int, key string",
    )


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
