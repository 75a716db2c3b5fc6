"""Tables that the tests of this folder share."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

PROSE = "the quick brown fox jumps over a lazy dog while seven other animals watch from behind the old stone wall today"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
ODD = [
    PROSE, PROSE, PROSE + " twice", None, "", " ", "\n\t\x0b", "one", "a  b \n c", "tab\tand\x0cfeed", "é ü 漢字 😀 text", "x" * 5000,
    "same line\nsame line\nsame line\nother line", "stop. stop. stop. stop. stop. stop. stop.", "<|endoftext|> in  text", LONG,
    'leak token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" here', "card 4785380592391135 paid", "a　b c\x85d \x1fe",
]


def documents(spark, texts, first=0, sources=("a", None, "b")):
    rows = [(first + i, t, "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
