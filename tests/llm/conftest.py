import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Names that operators use inside themselves.
CLASHES = ["place", "batch", "payload", "size", "score", "kept", "label", "_draw", "rep", "carry_text"]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table, with extra columns whose names clash."""

    def build(rows, clash=True):
        full = [(i, t, lang, src, None if t is None else len(t), *(["x"] * len(CLASHES) if clash else [])) for i, t, lang, src in rows]
        extra = "".join(f", `{c}` string" for c in CLASHES) if clash else ""
        return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint{extra}")

    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented sentences."""

    def build(seed, n_words, vocabulary=2000):
        draw = random.Random(seed)
        return " ".join(f"w{draw.randrange(vocabulary):x}" + ("." if draw.random() < 0.1 else "") for _ in range(n_words))

    return build


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and blank texts, null and repeated ids, a very long text and a very long word."""
    long_text, long_word = prose(99, 30_000), "ä" * 5000
    same = prose(98, 120)
    return [
        (1, None, None, None), (2, "", "en", ""), (3, " \t\n", "en", "a"), (4, "one", "en", "a"), (5, "One", "en", "b"),
        (6, long_text, "en", "a"), (7, long_word, "de", "b"), (8, same, "en", "a"), (9, same, "en", None), (10, same, None, "c"),
        (11, same, "en", "a"), (None, same, "en", "a"), (None, None, None, None), (12, "12 34 !!  ", "en", "c"),
    ]
