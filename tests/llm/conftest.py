from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "Äther", "naïve", "x1", "don't", "end.", "so,", "über", "日本", "a-b", "***", "|", "The", "tion", "ing"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ly", str(r.randint(0, 99))]) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, empty, null and long texts, a repeated row and a null id."""
    passage, base = prose(900, 70), prose(901, 120)
    near = base.split()
    near[60] = "changed"
    texts: dict[int | None, str | None] = {i: prose(i, 5 + 7 * (i % 23)) for i in range(40)}
    texts |= {40: None, 41: "", 42: "  \n\t ", 43: "word", 44: base, 45: base, 46: " ".join(near), 47: base + " tail"}
    texts |= {48: prose(50, 20) + " " + passage + " " + prose(51, 20), 49: prose(52, 5) + "\n" + passage, 50: passage, 51: "se " * 130, 52: "se " * 90 + "x", 53: prose(53, 6000), 54: "it's  a\t\tgap \n", 55: "<|endoftext|> in text", 56: "word"}
    rows = [(i, t, "en", None if i % 7 == 3 else f"src{i % 5}", len(t or "")) for i, t in texts.items()]
    return [*rows, rows[10], (None, prose(77, 60), "en", "src0", 1), (57, passage, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus(), SCHEMA).withColumn("node", F.lit("x")).withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()
