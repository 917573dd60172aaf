"""Small documents with every odd case, and how queries are read back."""

DOCS = "doc_id long, text string, source string"


def documents(spark, rows, schema=DOCS, **extra):
    """Rows (doc_id, text[, source]) with two columns whose names clash with internals."""
    full = [(*r, "a") if len(r) == 2 else tuple(r) for r in rows]
    names = ", row_key string, copies int, rep string, gone_id long, key string, n long"
    return spark.createDataFrame([(*r, "x", 7, "y", -5, "z", 3) for r in full], schema + names)


def prose(seed, n, vocabulary=400):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))
