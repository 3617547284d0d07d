import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("abcdeñé中") for _ in range(rng.randint(1, 6))) if rng.random() < 0.05 else f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, periodic texts, nulls, empties and clashing columns."""
    rng = random.Random(7)
    passage, line = prose(rng, 70), prose(rng, 12)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts += [texts[3]] * 4 + [texts[5]] * 2
    for _ in range(12):
        words = texts[7].split(" ")
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randint(1, 40))} {passage}\n{prose(rng, rng.randint(0, 40))}" for _ in range(8)]
    texts += [f"{line}\n{prose(rng, 60)}" for _ in range(90)]
    texts += ["The The " * 200, "ab" * 400, "x y z " * 30, "", "   \n\t ", None, None, "one", "one", "中" * 300, " ".join(prose(rng, 30) for _ in range(60))]
    rows = [(i, t, rng.choice(["en", "fr", None]), "src0", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
