from __future__ import annotations

import random

import pytest

#: Columns that clash with names that the operators use inside.
EXTRA = {"doc": 1, "tk": 2, "row": "r", "score": 0.5, "size": 3, "copies": 4, "shard": 5, "g": 6, "word": "w", "lines": 7, "component": 8, "copy": 9}
KINDS = {int: "long", str: "string", float: "double"}


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as documents with clashing extra columns."""

    def make(rows):
        extra = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in EXTRA.items())
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or ""), *EXTRA.values()) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    common = " ".join(rng.choices(words, k=60))
    long = " ".join(rng.choices(words, k=30_000))
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "a"), (5, "x" * 50_000), (6, long), (7, long), (7, long),
        (8, "Ärger, ß 漢字  é 😀   it's we'll 12ab34  two  spaces \n\n tail "),
        (None, f"without an id {common}"), (9, f"{common}\n{common}"), (10, f"first {common} last"), (11, "  Same line that is long enough \nother\r\n"),
        (12, "same LINE that is long enough"), (13, "same line that is long enough\t\nsame line that is long enough"), (14, "\x00 nul \x01"), (15, common.upper()),
    ]
    rows += [(20 + i, " ".join(rng.choices(words, k=rng.randint(5, 200)))) for i in range(40)]
    rows += [(70 + i, f"copied text {common} {'x' if i % 2 else 'y'}") for i in range(12)]
    return rows
