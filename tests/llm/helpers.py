"""Rows that every operator has to take: nulls, empty and long texts, ties, clashing columns."""

ODD_TEXTS = [None, "", " ", "\n\n", "\x00", "a", "é", "the the the the the the the", "x" * 300_000, "word " * 20_000, "word " * 20_000, "ñ😀 . , ;", "\x1c\x1d odd \x85 white\xa0space"]


def odd_documents(spark):
    """(doc_id, text, lang, source, n_chars) with extra columns whose names the operators use inside."""
    rows = [(i, t, None if i % 3 else "en", f"s{i % 2}", len(t or ""), 1, "k", 2.0, [1]) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (5, "another text of the same id", "en", None, 4, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, i int, key string, score double, spans array<int>")


def nothing(spark):
    return odd_documents(spark).where("false")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
