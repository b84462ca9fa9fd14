"""Small tables with the awkward cases in them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("fp", "size", "drop", "taken", "lang_pred", "score", "n_lines", "hi", "lo", "class", "component", "begin", "key", "canon", "kind", "host", "path", "rank")

SENTENCES = {
    "en": "the cat and the dog were in the house with all of their friends",
    "de": "der hund und die katze sind mit allen freunden nicht in dem haus",
    "fr": "le chien et la maison que les enfants avec une histoire pour nous",
}


def documents(spark, *rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], DOCS)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
