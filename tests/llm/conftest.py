"""Small tables with nulls, empty texts, ties, repeats and extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, text_len int, id long, block int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def make_rows() -> list[tuple]:
    rng = random.Random(7)
    shared = sentence(rng, 60)
    texts = [None, "", "   \n\t ", "one", "Two words", "!!! ...", shared, shared]
    for i in range(40):
        body = sentence(rng, rng.randint(0, 120))
        if i % 3 == 0:
            cut = rng.randint(0, 30)
            body += " " + " ".join(shared.split()[cut : cut + rng.randint(5, 30)]) + " " + sentence(rng, 5)
        if i % 7 == 0:
            body = body + "\n" + body
        texts.append(body)
    texts += ["ab" * 400, "x" * 700, (shared + "\n") * 3, texts[10], texts[10]]
    rows = []
    for i, text in enumerate(texts):
        doc_id = None if i in (9, 20) else i * 3 % 101
        rows.append((doc_id, text, None if i % 11 == 5 else ("en" if i % 2 else "fr"), None if i % 13 == 4 else f"s{i % 4}", None, i, i, -i, i))
    rows.append(rows[12])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    from tidemark.llm.shared import use_checkpoints

    use_checkpoints(spark)
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return docs.limit(0)
