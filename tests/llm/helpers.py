"""Fixtures of the training-data operator tests."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = ("the house of river and stone was built by people who came from far away to live near water "
         "they made bread and sang songs while children played in fields of green grass under bright sun").split()


def sentence(seed: int, n: int) -> str:
    """Deterministic prose; different seeds share hardly any four words in a row."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "same text here now"), (6, "same text here now"), (6, "same text here now"),
         (None, "same text here now"), (7, "x" * 5000), (8, "naïve café 中文 😀 ́ \x00 end"), (9, "a  b   c \n\n d")]
