import pytest


def words(n, seed):
    import random

    r = random.Random(seed)
    return ["".join(r.choice("bdgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def vocabulary():
    return words(400, 1)
