"""Small awkward tables for the corpus operators."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, _key string, node string"


def prose(seed: int, n: int) -> str:
    """Made-up words, a line break after every twelve."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ter", "on", "shi", "la", "mo", "ent", "ré"]) for _ in range(r.randint(1, 4)))
    return " ".join(word() + ("\n" if i % 12 == 11 else "") for i in range(n))


AWKWARD = [
    None, "", " \t\n ", "one", "two words", "éß 字  \U0001f600 a\x1cb", "a" * 70_000, "ab " * 30_000,
    "same line\nsame line\n\nother", "<|endoftext|> x <|endoftext|>", "  lead  and   runs \n trail ", "### $$ | <b>",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward texts, prose with copies and near copies, nulls in every column, repeated rows, clashing columns."""
    texts = [*AWKWARD, *[prose(i, 120) for i in range(12)]]
    near = prose(0, 120).split(" ")
    near[60] = "changed"
    texts += [prose(0, 120), prose(0, 120), " ".join(near), prose(1, 120).upper()]
    rows = [(i, t, ["en", "fr", None, "xx-broken!"][i % 4], [None, "a.example.org", "b.example.org"][i % 3], None if i % 5 == 0 else len(t or ""), "k", "x", "y") for i, t in enumerate(texts)]
    rows += [rows[15], rows[0], (None, prose(0, 120), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def workspace(spark):
    from tracelake.llm.common import Workspace

    return Workspace(spark, "test")
