"""Small inputs that the tests of the training-data operators share."""

from __future__ import annotations

import pathlib
import random

SF = "/root/testdata/sf0.001"
HAVE_TABLES = pathlib.Path(SF).exists()
#: Columns whose names the operators use themselves.
CLASH = ["row", "doc", "body", "keep", "n", "cls", "a", "b", "label", "score", "predicted", "slice", "text_", "id"]


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def documents(spark, rows, lang: str | None = "en"):
    """Documents (doc_id, text) with the other given columns and columns of clashing names."""
    full = [(i, t, lang, "s", None if t is None else len(t), *(["x"] * len(CLASH))) for i, t in rows]
    names = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}")


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank and very long texts, copies, repeated rows and one id with two texts."""
    base = words(1, 60)
    return [(1, base), (2, None), (3, ""), (4, " \n\t "), (5, base), (5, base), (6, words(2, 40)), (6, words(3, 40)),
            (None, words(4, 30)), (7, words(5, 60_000)), (8, "one two three"), (9, "One TWO three"), (10, "é" * 50)]
