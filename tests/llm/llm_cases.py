import random

import pytest

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, id long, _low string"
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were".split()


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed" + str(rng.randint(0, 9))]) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def odd_rows():
    """Nulls, empty, one word, repeated rows, copies, near copies, a shared passage, long texts."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 70)
    texts = [None, "", "  \t\n ", "One", "One", base, base, base.upper(), base + " tail", " ".join(base.split()[:-2]), passage,
             prose(rng, 30) + "\n" + passage + " " + prose(rng, 40), passage + " " + prose(rng, 12), prose(rng, 9000), "x" * 5000, "a a a " * 400, "É ß 漢字 😀 😀"]
    rows = [(i + 1, t, ["en", "de", None][i % 3], [None, "s2", "s10", "s1"][i % 4], None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, base, None, "s1", 3), (None, None, None, None, None)]
    return [(*r, "key", "text", 7, "low") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), KIND)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)
