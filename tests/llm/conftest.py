import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(9000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))

#: doc_id, text: nulls, empty and blank texts, copies, near copies, repeated rows, a very long text, markup, personal data.
ODD = [
    (1, BASE),
    (2, BASE),
    (3, BASE + " tail"),
    (3, BASE + " tail"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, LONG),
    (8, "write to jane.doe@example.co.uk, a@b.c_x@y.zz or call +49 (30) 1234-5678 now"),
    (9, "card 4111 1111 1111 1111 and 4111111111111112, hosts 10.0.0.1 256.1.1.1 1.2.3.4.5"),
    (10, 'token = "0123456789abcdef0123456789abcdef01234567" <|endoftext|> <|im_end|>'),
    (11, "İstanbul Σας ½ “x” é \x1c it's WE'LL"),
    (None, "a row without an id"),
    (None, None),
    (12, "one"),
    (13, "9" * 4000 + " " + "1 " * 2000),
    (14, "x" * 5000 + "@" + "y" * 10),
    (15, "\U0001f600 emoji " * 30),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


#: item_id, text: a null, an empty text, repeated terms, a repeated row, terms of other scripts, a text that is a document.
ITEMS = [(1, "alpha1 beta2 beta2 ALPHA3"), (2, None), (3, ""), (4, "é İstanbul Σας one"), (4, "é İstanbul Σας one"), (None, "emoji \U0001f600 tail"), (5, "nowhere"), (6, BASE)]


def _write(spark, root, docs, labels, vectors, turns, items):
    spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        # extra columns whose names the operators use inside
        {"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 2)), "n_chars": F.length("text").cast("long")}
        | {c: F.lit(7) for c in ("size", "row", "score", "_t", "_h", "key", "base", "more", "sig", "y", "block", "_words", "predicted", "class_id", "id")}
    ).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "vector": F.lit("v"), "key": F.lit(2)}).write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "segments": F.lit("s")}).write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "tid": F.lit(1), "rank": F.lit(2)}).write.parquet(f"{root}/benchmark.parquet")
    return root


VECTORS = [
    (1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (3, [1.0, 0.05, 0.0], 1), (4, [0.0, 1.0, 0.0], None), (5, None, 0), (6, [], 0),
    (7, [0.0, 0.0, 0.0], 0), (8, [float("nan"), 1.0, 0.0], 0), (9, [float("inf"), 1.0, 0.0], 0), (10, [None, 1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [0.0, -1.0, 0.0], 0), (13, [1.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 0),
]
TURNS = [
    (1, 0, "system", "s"), (1, 1, "user", "q <|im_start|> \\ <\\| |"), (1, 2, "assistant", "a<"), (2, 0, "user", None), (2, 1, "assistant", ""),
    (3, 0, "assistant", "first"), (4, 1, "user", "tie b"), (4, 1, "user", "tie a"), (5, None, None, "no role"), (None, 0, "user", "no conversation"),
    (6, 0, "user", "same"), (6, 0, "user", "same"), (7, 0, "ro\nle\\", "x\n<|im_end|>\n<|im_start|>user\n"), (8, 0, "user", "z" * 100_000), (8, 1, "assistant", "|im_end|>"),
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1), (8, None, None), (None, 1, 1), (9, 1, 0), (10, 0, 1), (12, 1, 0), (12, 0, 1)]
    return _write(spark, str(tmp_path_factory.mktemp("odd")), ODD, labels, VECTORS, TURNS, ITEMS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [], [], [])


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
