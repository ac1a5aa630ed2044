"""Documents that hold every awkward case, as plain rows and as a table."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, h int, row string, k double"


def make_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(6))
    base = "\n".join(sentence(14) for _ in range(8))
    words = base.split(" ")
    near = " ".join([*words[:50], "other", *words[51:]])
    texts = [
        base, base, near, base.upper(), passage, f"{sentence(9)} {passage} {sentence(9)}", f"{sentence(20)}\n{passage}", None, "", "  \n\t ", "one", "one two", "12 34 %%", "é ñ 日本語 👍",
        "\n".join(sentence(9) for _ in range(400)), "x" * 3000, "long " * 4000, base.replace("\n", "\r\n"), "Same short line.\nSame short line.", "Same short line.", "a<|endoftext|>b", base + " tail",
    ]
    texts += [sentence(rng.randint(5, 60)) for _ in range(30)]
    rows = [(i * 3, t, None if i % 7 == 0 else "ab"[i % 2], None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "clash", i, "r", 0.5) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((3, "another text under an id that is taken already, with some words", "a", "s1", 0, None, None, None, None))
    rows.append((None, base, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
