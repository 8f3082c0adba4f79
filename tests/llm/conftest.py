import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with nulls, empty texts, a repeated row, and columns whose names the operators use themselves."""

    def make(rows, odd=True):
        rows = [(i, t, *(rest or ("en", "src0", len(t) if t is not None else None))) for i, t, *rest in rows]
        if odd:
            rows += [(None, "a text without a key", "en", "src1", 20), (9001, None, None, None, None), (9002, "", "de", "src2", 0), (9003, " \n.,", None, "src2", 4)]
            rows.append(rows[0])
        df = spark.createDataFrame(rows, DOCS)
        for name in ("k", "t", "r", "key", "drop", "epoch", "domain", "row", "start", "h", "kind", "hash"):
            df = df.selectExpr("*", f"concat('own ', cast(doc_id as string)) AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([(1, "x")], odd=False).limit(0)
