"""Cases in which results used to be lost or never came."""

from pyspark.sql import functions as F

from bizlens.llm import decontam, langid, packing, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, bad_key string, root string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", "y") for i, t, lang in rows], DOC)


def test_packing_of_almost_empty_documents_ends(spark):
    items = spark.range(5000).select(F.col("id").alias("uid"), F.lit(1).cast("long").alias("length"))
    got = packing.assign(items).collect()
    assert len(got) == 5000 and len({r.sequence_id for r in got}) == 2  # 5000 tokens, 4096 a sequence
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r.offset)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_packing_stops_where_pooling_settles_nothing(spark):
    items = spark.range(60).select(F.col("id").alias("uid"), F.lit(100).cast("long").alias("length"))
    got = packing.assign(items, capacity=100, shard_items=2, pool_percent=100).collect()
    assert len(got) == 60 and len({r.sequence_id for r in got}) == 60 and {r.offset for r in got} == {0}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a = " ".join(f"alpha{k}" for k in range(60))
    b = " ".join(f"beta{k * k}" for k in range(60))
    rows = [(1, a, None), (1, b, None), (2, a, None), (None, b + " ", None), (None, "gamma delta epsilon", None)]
    kept = simhash.stage(spark, docs(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text.strip()) for r in kept) == sorted([(1, a), (1, b), (0, "gamma delta epsilon")])


def test_every_language_is_learned(spark):
    base = [(k, " ".join(f"{'abc'[k % 3] * 3}word{(k * j) % 17}" for j in range(30)), "lng" + "abc"[k % 3]) for k in range(90)]
    rare = [(1000 + k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}zz{j}" for j in range(20)), f"rare{k}") for k in range(40)]
    model = langid.fit(docs(spark, base + rare))
    assert set(model["langs"]) == {"lnga", "lngb", "lngc"} | {f"rare{k}" for k in range(40)}


def test_decontamination_stage_with_clashing_names(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs(spark, [(1, "x " + item, None), (2, "clean text", None), (None, None, None)])
    kept = decontam.stage(spark, table, str(tmp_path))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {2, None}
