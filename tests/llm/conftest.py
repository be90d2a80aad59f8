import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
PROSE = " ".join(f"some{i * 7 % 53} of the prose" for i in range(40))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and very long texts, ties, repeated rows."""
    texts = [
        (1, None, None), (2, "", "en"), (3, "  \t\n ", "en"), (4, LONG, "en"), (5, LONG, "en"), (6, LONG.replace("word5x", "other"), None),
        (7, f"before one {PASSAGE} after", "fr"), (8, f"{PASSAGE} and the end", "fr"), (9, f"x {PASSAGE}", None), (10, "one two three", "en"), (11, "One TWO three", "de"),
        (12, PROSE, "en"), (13, PROSE, "en"), (13, PROSE, "en"), (None, PROSE, "en"), (14, PROSE.upper(), "en"), (15, "a a a a a a a a", "en"), (16, "line\nline\n\nline x\nline", None),
        (17, "é b  c\x0bd 日本 😀 <|endoftext|> </s>", "fr"), (18, "#$% " * 60, "en"), (19, " ".join("abcdefghij"[i % 10] for i in range(200)), "en"), (-3, PROSE + " tail", "en"),
        (20, "one two three", "en"), (20, PASSAGE, "en"),
    ]
    return [(d, t, lang, "src", None if t is None else len(t)) for d, t, lang in texts]


CLASHES = ("kept", "n_words", "hi", "lo", "component_id", "shard", "slot", "row", "part", "sequence_id", "phrases", "spans", "kept_words", "own_id")


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with extra columns whose names the operators use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *("?" for _ in CLASHES)) for r in edge_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
