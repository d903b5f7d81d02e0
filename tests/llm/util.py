"""Small tables for the tests of this folder."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """documents of (doc_id, text), with extra columns whose names clash with what operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    for extra in ("id", "node", "key", "n", "bands", "bucket", "block", "shard", "digest", "note"):
        df = df.selectExpr("*", f"1 AS `{extra}`")
    return df.selectExpr("*", "'x' AS `fingerprint`", "0.5D AS `score`")


ODD = [(5, None), (3, ""), (9, "a"), (1, "same text here and there"), (2, "same text here and there"), (4, "🙂 é ß\n\n\tend"), (None, "no id, no matter"), (7, "x" * 50_000), (7, "again seven"), (2, "same text here and there")]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, x) for x in t))
