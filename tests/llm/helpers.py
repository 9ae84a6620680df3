"""Small tables for the tests of this folder."""

TEXTS = [
    None, "", " ", "a", "\n\n\n", "one two three four", "One  two\tTHREE four five", "naïve café Ünïcödé straße ΣΑΣ İstanbul",
    "don't we'll it's  <|endoftext|> and <|STARTOFTEXT|> x1y22 ...!? éà   z \x1cq", "数据 テスト 🙂🙂 x‍y",
    "tie tie tie tie tie tie tie tie tie tie tie tie", "word " * 5000, "x" * 3000,
]


def docs(spark, texts=None, more=True):
    """Documents with null ids, repeated rows and columns whose names the operators use too."""
    rows = [(i, t, "en", f"src{i % 2}", None) for i, t in enumerate(TEXTS if texts is None else texts)]
    if more:
        rows += [(None, "a row without an id", None, None, 3), (5, "one two three four", "en", "src1", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("shard", "n_words", "ids", "_key", "size", "count", "kept", "c", "lo", "bucket"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def empty(spark):
    return docs(spark).limit(0)
