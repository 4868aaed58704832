"""Plain Python counterparts of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def docs_of(spark, texts, sources=None):
    """A documents table from texts, ids in order."""
    rows = [
        (i, t, "en", sources[i] if sources else f"src{i % 3}", len(t) if t is not None else None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, count, vocabulary=400):
    """Deterministic invented words."""
    import random

    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}x{draw.randrange(vocabulary)}" for _ in range(count)]
