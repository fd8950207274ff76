import random

import pytest

#: Columns of ``documents`` with a null, an empty text, repeats, ties and clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, bucket int, size long, h long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    """Small rows with exact and near copies, shared passages and every awkward case."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(3, 120)) for _ in range(30)]
    texts = list(base)
    for t in base[:10]:
        words = t.split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 5)} {passage} {prose(rng, 7)}" for _ in range(5)]
    texts += [base[0], base[1], base[1].upper(), "", None, " \n\t ", "one", "two words", "é中\U0001f600 " * 30, "x" * 3000, prose(rng, 3000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, 1, 1, 1, 1, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text of the same number", "en", "s1", 0, 1, 1, 1, 1, 1), (None, base[2], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
