from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, id string, tag string, row string, shard int, bucket int, queue string"
EXTRA = ("x", "y", "z", 1, 2, "q")


def prose(draw: random.Random, words: int) -> str:
    return " ".join(draw.choice(["ka", "lo", "mi", "nu", "pe"]) + draw.choice(["ra", "si", "to"]) + str(draw.randrange(40)) for _ in range(words))


def messy_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, passages and near copies that documents share."""
    draw = random.Random(11)
    passage, base = prose(draw, 70), prose(draw, 120).split(" ")
    texts: list[tuple] = []
    for i in range(40):
        texts.append((i, prose(draw, draw.choice([1, 3, 30, 90])), f"s{i % 3}"))
    for i in range(40, 48):
        texts.append((i, f"{prose(draw, 20)}\n{passage} {prose(draw, 15)}", "hot"))
    for i in range(48, 56):
        near = list(base)
        near[draw.randrange(len(near))] = "changed"
        texts.append((i, " ".join(near), "hot"))
    texts += [(56, " ".join(base), None), (57, " ".join(base), "hot"), (58, " ".join(base), "hot")]
    texts += [(60, None, None), (61, "", "s0"), (62, " \t\n ", "s1"), (None, passage, "s1"), (None, None, None)]
    texts += [(63, "only tie", "s0"), (63, "only tie", "s0"), (63, "another text of the same id", "s0")]
    texts += [(64, prose(draw, 12_000), "long"), (65, "ümlaut é 中文 \u2028 x" * 3, "s2"), (66, "w" * 5000, "s2"), (67, "ab " * 400, "s2")]
    draw.shuffle(texts)
    return [(i, t, s, None if t is None else len(t), *EXTRA) for i, t, s in texts]


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
