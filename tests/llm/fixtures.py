"""Documents that stress every operator: nulls, empty and long texts, ties, repeated rows, extra columns."""
from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, candidates string, take string"


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]

    def prose(k: int) -> str:
        return " ".join(r.choice(words) for _ in range(k)).capitalize() + "."

    texts = [prose(r.randint(12, 160)) for _ in range(n)]
    passage = prose(60)
    texts += [texts[0], texts[0], texts[1] + " tail", prose(20) + "\n" + passage + "\n" + prose(9), passage, "é" * 300 + " " + passage]
    texts += ["", None, " \n\t", "one", "two words", "a" * 5000, "ab " * 3000, "Aa\x0b" + texts[2], "x\ty\r\nz  double", "日本語 テキスト。 " * 40]
    out = [(10 * i, t, "en", [None, "s1", "s2", "S3"][i % 4] if i % 3 else "s1", None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
    return out


def frame(spark, more: list[tuple] = ()):
    return spark.createDataFrame([*rows(), *more], SCHEMA)


def repeated_and_null(spark):
    """The documents with repeated rows and rows without an id."""
    r = rows()
    return spark.createDataFrame([*r, r[3], r[3], (None, "no id here at all", "en", None, 17, "x", "y", "z"), (None, None, None, None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
