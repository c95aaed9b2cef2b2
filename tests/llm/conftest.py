import random

import pytest

SCHEMA = """doc_id long, text string, lang string, source string, n_chars long,
    row int, kept string, size double, id string, uid string, key int, range string, h string, at int, doc string, hit int"""


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows; the further columns have names that operators use inside."""
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "Über", "señor", "of", "the", "<|im_end|>", "x1y2z3"])
    prose = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    same, long = prose(8), prose(1500) + "\n" + "z" * 60_000
    texts = [
        (1, same, "s1"), (2, same, "s1"), (3, same + " tail", None), (4, "", "s2"), (5, None, "s2"), (6, "   \n\t \n", None), (7, "one", "s1"),
        (8, "a\n\na\na\n\n\na\na\na", "s2"), (9, long, "s3"), (10, long[:-1], "s3"), (11, same, None), (11, same, None), (12, "ONE", "é"),
        (None, same, "s1"), (None, None, None), (13, "mail a.b@c.de at 10.0.0.1 or +49 (30) 1234567 and 4111 1111 1111 1111.", "s2"),
        (14, "### $$$ && " * 40, "s1"), (15, "SHOUT AT ME!! " * 30, "s1"), *((20 + i, prose(3 + i % 5), f"s{i % 3}") for i in range(40)),
    ]
    return [(d, t, None, s, None, k, "x", 0.5, "i", None, 1, "r", "h", k, "d", 0) for k, (d, t, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
