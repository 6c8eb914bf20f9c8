import corpus_pipeline


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    near = text(0).replace("w0x29", "other")
    rows = [(1, text(0)), (7, near), *[(7, text(k)) for k in range(1, 6)], (7, text(1)), (None, text(6)), (None, text(6)), (None, text(7)), (9, text(7)), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(5), "").select("doc_id", "text").collect()
    # One of 1 and its near copy, each text of id 7 once, one of the null ids' copies, the known id before the null one.
    want = [(1, text(0)), *[(7, text(k)) for k in range(1, 6)], (None, text(6)), (9, text(7)), (8, None), (8, "")]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)
