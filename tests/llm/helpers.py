"""Small fixtures and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, size string, part string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with what operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
