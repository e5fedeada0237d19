"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, n_words long, tie int, place long, "
    "class string, label string, t string, ws string, at string, d string, spans string, copies long, size long, digest string"
)
LONG = " ".join(f"the wort{i % 977} thing{i * 7 % 1013}" for i in range(30_000))


def awkward(spark):
    """Null and blank texts, null ids and sources, repeated rows, a very long text, and
    columns whose names the operators use themselves."""
    texts = [
        (1, "", "a"),
        (2, None, "a"),
        (3, " \n\t ", None),
        (4, "One two three four five six seven eight nine ten eleven. É ß 日本", "b"),
        (4, "One two three four five six seven eight nine ten eleven. É ß 日本", "b"),
        (None, "one two", "b"),
        (None, None, None),
        (5, LONG, "a"),
        (6, LONG + " more", "a"),
        (7, "mail a.b@host.example.com or +1 (988) 555-2485, MIT License", "c"),
    ]
    rows = [(i, t, "en", s, len(t or ""), "r", 5, 1, 2, "c", "l", "t", "w", "a", "d", "s", 3, 4, "g") for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
