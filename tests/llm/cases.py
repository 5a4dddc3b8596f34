"""Documents for edge cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i} shared" for i in range(40))

TEXTS = [
    None,
    "",
    "a",
    " \n\t ",
    "The quick brown fox jumps over the lazy dog. " * 3,
    "ÉTÉ à la plage,\nun deux trois\nun deux trois\n" + PASSAGE,
    "It's we're 'tis 1 2 33 <|endoftext|> x<|startoftext|>y é ́ b\u0085c  d " * 20,
    "mail me: jo.doe@mail.example.com, call +1 (212) 555-0199, card 4111 1111 1111 1111, ip 10.0.0.255 or 1.2.3.256",
    "x" * 5000 + "@" + "y" * 3000,
    ("word" + "%d " * 9 + "\n") * 800,
    "longword" * 40000,
    PASSAGE + " and more words here to follow",
]


def documents(spark, extra=True):
    rows = [(i, t, "en" if t else None, "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id but words", None, None, 3), (5, "same id, other text", "fr", "s", 19)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("n_tokens", "score", "kept", "spans", "class_id", "hash", "start"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sample(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
