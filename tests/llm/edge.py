"""Documents that every operator has to cope with."""

SCHEMA = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, bucket INT, fp LONG, "
    "score DOUBLE, `_toxicity` DOUBLE, key STRING, text_hash STRING"
)
LONG = "the of rend and threlyes " * 60_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten."),
    (2, "One two three four five six seven eight nine ten."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG),
    (7, "x" * 300_000),
    (8, " " * 300_000),
    (9, "éàü ñ 漢字 😀 \u0000 end"),
    (9, "éàü ñ 漢字 😀 \u0000 end"),
    (None, "a row without id"),
    (None, "a row without id"),
    (None, "one two three four five six seven eight nine ten"),
    (10, "12345 !!! ---"),
    (11, "a"),
]


def edge_docs(spark, texts=TEXTS):
    rows = [(i, t, None, None, None, 7, 7, 0.5, 0.5, "k", "h") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return edge_docs(spark, [])
