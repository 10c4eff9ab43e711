import random

import corpus_pipeline

RND = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join("w%d" % RND.randrange(400) for _ in range(n))


def test_stages_keep_rows_without_id_and_all_texts_of_one_id(spark, tmp_path):
    base, item = prose(120), "The quick brown fox jumps over the lazy dog while seven wizards brew strange potions"
    clean = [(None, prose(80)), (None, prose(80)), (7, prose(80)), (7, prose(80)), (9, base), (None, None)]
    near = [(None, base + " tail"), (None, "head " + base), (12, base), (9, base)]
    leaks = [(None, prose(40) + " " + item), (7, item + " " + prose(40))]
    rows = lambda some: sorted(map(str, some))
    df = lambda some: spark.createDataFrame([(i, t, None, "web", len(t or "")) for i, t in some], SCHEMA)
    spark.createDataFrame([(70, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.drop_near_duplicates(spark, df(clean + near + leaks), str(tmp_path)).select("doc_id", "text").collect()
    assert rows((r.doc_id, r.text) for r in got) == rows(clean + leaks)
    got = corpus_pipeline.drop_contaminated(spark, df(clean + leaks), str(tmp_path)).select("doc_id", "text").collect()
    assert rows((r.doc_id, r.text) for r in got) == rows(clean)


def test_near_copies_from_a_similarity_of_0_80_go(spark, tmp_path):
    words = prose(120).split()
    near, far = list(words), list(words)
    for w, places in ((near, (30, 80)), (far, (20, 40, 60, 80, 100))):  # 106 of 126 shingles, 91 of 141
        for k in places:
            w[k] = "changed%d" % k
    df = spark.createDataFrame([(i, " ".join(w), None, None, 1) for i, w in enumerate((words, near, far))], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect()) == [0, 2]


def test_stages_keep_own_columns_and_take_empty_tables(spark, tmp_path):
    line = "\n".join(prose(12) for _ in range(6))
    data = [(1, prose(80) + "\n" + line, "en", "web"), (2, prose(90) + "\n" + line + "\nend", None, None), (None, None, "en", "web"), (3, "", None, "web"), (4, "short", "en", None)]
    own = {"kept": "own", "n_words": "own", "_rid": "own", "removed_lines": "own", "_doc": "own", "symbol_share": "own"}
    df = spark.createDataFrame([(*x, len(x[1] or ""), *own.values()) for x in data], SCHEMA + "".join(f", {c} string" for c in own))
    spark.createDataFrame([(70, "an item that no text holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        rows = out.collect()
        assert all(r[c] == "own" for r in rows for c in own)
        assert {1, 2} <= {r.doc_id for r in rows}
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack_sequences(spark, df.limit(0), str(tmp_path)).count() == 0


def test_run_equals_its_stages_in_turn(spark, tmp_path):
    line, item = "\n".join(prose(12) for _ in range(6)), "The quick brown fox jumps over the lazy dog while seven wizards brew strange potions"
    first = prose(120)
    texts = [first, first + " tail", prose(70) + "\n" + line, prose(80) + "\n" + line, prose(60) + " " + item, "short", None, prose(100)]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(70, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 2, 3, 7}  # 1 is a near copy, 4 holds the item, 5 and 6 fail the base rule
    gone = {r.doc_id: r.doc_tokens for r in got}
    whole = {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert gone[2] == whole[2] and gone[3] < whole[3] and gone[0] == whole[0]
