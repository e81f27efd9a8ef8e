import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, key string, uid int, fp int, "
          "hash string, score string, n_words string, lang_id int, quality_of int, row_uid int, scan int, m int, "
          "bundle int, size int")
CLASH = ("x", "x", 1, 1, "x", "x", "x", 1, 1, 1, 1, 1, 1, 1)


def odd_rows():
    words = "the of and thing that shere onder edly ". split()
    long = " ".join(words[(k * k + k // 7) % len(words)] + "abcdefghij"[k % 10] for k in range(30_000))
    texts = [(9001, None), (9002, ""), (9003, " \t\n "), (9004, "!!! 123"), (9005, "One"), (9006, "one two"),
             (9007, long), (9008, long), (9009, "Tie tie TIE"), (9009, "Tie tie TIE"), (None, "the and of the"),
             (None, None), (9010, "Straße éÀ 'tis don't ½ 你好 <|endoftext|> é  x"), (9011, "a" * 5000)]
    return [(i, t, None, None, None, *CLASH) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """The small documents plus odd rows, with columns that clash with internal names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars, *CLASH) for d in docs] + odd_rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
