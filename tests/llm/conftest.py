import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=0):
    """n words, the same for a seed."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing", str(r.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of texts, with columns whose names operators use inside, and repeated rows if asked."""

    def make(texts, repeat=(), **columns):
        rows = [(i, t) for i, t in enumerate(texts)] + [(i, texts[i]) for i in repeat]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
        for name, value in {"lang": "en", "source": "s", "rep": 1, "bucket": 2, "_e": "x", "size": 3, **columns}.items():
            df = df.withColumn(name, value if hasattr(value, "_jc") else F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, very long, non-Latin and repeated texts."""
    long = prose(6_000, 3)
    return [None, "", " \n\t ", "a", "one two three four", prose(80, 1), prose(80, 1), long, "日本語 текст émile 😀 " * 30, "x" * 5_000, "a\x00b \x1c c " * 9, "<|endoftext|> 's 're  \n\n  end "]
