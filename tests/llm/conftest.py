import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, root string, key string, size long, part int"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, repeats inside a text, short, empty and null texts, one very long text."""
    rng = random.Random(5)
    out: list[str | None] = []
    for _ in range(12):
        out.append(" ".join(words(rng, rng.randrange(60, 220))))
    base = words(rng, 150)
    for k in range(9):  # near copies, each a little further from the first
        out.append(" ".join([*base[: 150 - 6 * k], *words(rng, 6 * k)]))
    passage = " ".join(words(rng, 60))
    for _ in range(4):
        out.append(" ".join(words(rng, 40)) + " " + passage + "\n" + " ".join(words(rng, 30)))
    line = " ".join(words(rng, 20))
    out.append("\n".join([line] * 9))
    out += [out[0], out[0], out[3], out[12], "a b c", "A b C", "x", "", None, "   \n\t ", "###", "日本語 のテキスト です ok", "é" * 130, "ab" * 400, "ab" * 700, "é" * 130]
    out.append(" ".join(words(rng, 60_000, 5000)))  # very long
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(1000 + i, out[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with further columns whose names the operators use inside."""
    rows = [(i, t, None if i % 7 == 0 else ["en", "de"][i % 2], None if i % 11 == 0 else f"s{i % 3}", 0, "h", "r", "k", -1, 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column and repeated rows."""
    t = "one two three four five six seven " * 20
    rows = [(None, None, None, None, None, None, None, None, None, None), (None, t, "en", "s0", 1, None, None, None, None, None), (5, t, None, None, None, None, None, None, None, None),
            (5, t, None, None, None, None, None, None, None, None), (6, t, "en", None, None, None, None, None, None, None), (6, "other", "de", "s1", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)
