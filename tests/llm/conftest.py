import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use on the way.
CLASHES = "x double, g string, mu string, w string, n int, p double, epoch int, take_tokens bigint, mix_key string, pack int, bin bigint, slot bigint, keep boolean, a int, b int, kept bigint, u int, v int, shard int, `select` int, key string"


@pytest.fixture(scope="session")
def words():
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]

    def make(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and repeated ids."""
    long_ = words(60_000, 1)
    rows = [(i, words(40 + i % 9, i), "en" if i % 2 else "de", f"s{i % 2}", 100) for i in range(24)]
    rows += [(100, None, "en", "s0", 0), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s1", 3), (103, "...!!", None, "s1", 5), (104, long_, "en", None, len(long_))]
    rows += [(None, words(30, 50), "en", "s0", None), (None, None, None, None, None), (105, words(40, 60), None, None, None)]
    rows += [rows[0], rows[0], (1, words(35, 70), "en", "s1", 9), (106, rows[2][1], "en", "s0", 1), (107, rows[2][1] + " tail", "en", "s0", 1)]
    return rows


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture()
def clashing(spark, odd_rows):
    n = CLASHES.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * n) for r in odd_rows], f"{COLUMNS}, {CLASHES}")
