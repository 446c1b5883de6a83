"""Small inputs that every operator must bear."""

ODD_TEXTS = [None, "", " ", "\n\t ", "one", "One two  three\n\nfour", "a" * 3000, "word " * 5000, "<|endoftext|>", "x<|endoftext|> y", "caf\u00e9 \u4f60\u597d \U0001f600", "tab\x1cfs \x1cx", "12 345,67 89-10", "it's we'll  I'm", "trailing space ", "\u00a0nbsp \u00a0x"]


def documents(spark, texts=ODD_TEXTS, extra=True, start=0):
    """A documents table of the texts, its first text twice, with columns
    whose names clash with the operators' own."""
    rows = [(i + start, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    if rows:
        rows.append(rows[min(4, len(rows) - 1)])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in ("score", "i", "t", "fp", "word", "rank", "held_out", "_row", "part", "length")})
    return df


def as_rows(df):
    return [tuple(r) for r in df.collect()]
