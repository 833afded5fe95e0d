from graupel.plans import analysis


def test_every_keyword_is_in_one_row(spark, tmp_path):
    texts = ["steel lamp", "steel lamp", "robot vacuum", "", "    ", None, "word " * 200, "w" * 500, "w" * 501]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "item_id bigint, scope_ref string, text string").write.parquet(f"{tmp_path}/dataset_keywords.parquet")
    rows = {r["id"]: r for r in analysis.topic_analysis(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    assert {i: r.reason for i, r in rows.items() if r.reason in ("blank", "long")} == {3: "blank", 4: "blank", 5: "blank", 6: "long", 8: "long"}
    assert rows[0].cluster == rows[1].cluster and rows[0].label == "steel lamp" and rows[0].reason is None
    counts = {r.outcome: r.keywords for r in analysis.topic_summary(spark, str(tmp_path)).collect()}
    assert counts["blank"] == 3 and counts["long"] == 2 and sum(counts.values()) == len(texts)


def test_summary_of_more_copies_than_a_matrix_takes(spark, tmp_path):
    rows = spark.range(10_003).selectExpr("id AS item_id", "'s' AS scope_ref", "CASE WHEN id < 10001 THEN 'steel lamp' WHEN id = 10001 THEN 'robot vacuum' END AS text")
    rows.write.parquet(f"{tmp_path}/dataset_keywords.parquet")
    found = {r.outcome: (r.keywords, r.groups) for r in analysis.topic_summary(spark, str(tmp_path)).collect()}
    assert found == {"grouped": (10_001, 1), "below_threshold_or_small_component": (1, 0), "blank": (1, 0)}
