"""The stages one after the other, on a small corpus, against the same operators in plain Python where that is short."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    toxic = ["you vile scum number %d of these" % i for i in range(30)]
    clean = [" ".join("clean%d%s" % (i, c) for c in "abcdefghijklmnopqrstuvwxyzABCDE") for i in range(60)]
    copies = [clean[0], clean[1] + " x", "intro words " + clean[2] + " " + clean[3]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + copies + toxic)] + [(500, None, "en", None, 0), (501, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 63)) for i in range(93)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "substring_dedup", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(60), 62, 500, 501}  # 60 is a copy of 0, 61 nearly one of 1
    assert kept[62] == "intro words" and kept[5] == clean[5]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_each_row_has_its_own_verdict_and_text(spark, tmp_path):
    toxic = ["you vile scum number %d of these" % i for i in range(30)]
    clean = [" ".join("clean%d%s" % (i, c) for c in "abcdefghijklmnopqrstuvwxyzABCDE") for i in range(60)]
    other = [" ".join("other%d%s" % (i, c) for c in "abcdefghijklmnopqrstuvwxyzABCDE") for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + toxic)]
    # ids with two texts: clean and toxic, two clean ones, one a near copy of another id's, and one that repeats lines
    rows += [(5, toxic[3], "fr", "t", 1), (6, other[0], "fr", "t", 1), (7, clean[8], "fr", "t", 1), (9, clean[1] + "\n" + other[1], "fr", "t", 1), (90, clean[1] + "\n" + other[1] + "\n" + other[2], "de", "t", 1)]
    rows += [(None, toxic[4], "en", "s", 1), (None, "no id", "en", "s", 1), rows[10]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, found = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        found[name] = sorted(((r.doc_id or -1, r.text, r.lang) for r in docs.collect()))
    first = found["toxicity"]
    assert len(first) == 60 + 4 + 1 + 1 and not any("vile" in t for _, t, _ in first)
    lines = found["line_dedup"]
    assert (6, other[0], "fr") in lines and (6, clean[6], "en") in lines and (9, clean[9], "en") in lines and (90, other[2], "de") in lines
    assert len(lines) == len(first) - 1  # the repeated row
    last = found["substring_dedup"]
    assert (6, other[0], "fr") in last and (6, clean[6], "en") in last and (-1, "no id", "en") in last
    assert sum(t == clean[8] for _, t, _ in last) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
