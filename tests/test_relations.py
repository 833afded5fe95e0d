import numpy as np
import pytest

from graupel.plans import matching

SCHEMA = "item_id bigint, scope_ref string, text string, industry_evidence array<struct<key: string, group_type: string>>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = ["folding steel lamp", "Folding  steel lamp", "folding steel lamp!", "FOLDING STEEL LAMP", "folding steel lamp desk", "lamp folding steel", "robot vacuum", "", "..."]
    rows = [(i, "s", t, [("k", "g")] if i == 4 else None) for i, t in enumerate(texts)] + [(100 + i, "other", t, None) for i, t in enumerate(texts[:5])]
    path = str(tmp_path_factory.mktemp("relations"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/dataset_keywords.parquet")
    return path


def test_copies_hide_no_relation(spark, folder):
    classes = {r["id"]: r["class"] for r in matching.lexical_classes(spark, folder).collect()}
    assert [classes[i] for i in (0, 1, 2, 3, 4, 5, 7, 8, 100, 104)] == [0, 0, 0, 0, 4, 5, 7, 7, 100, 104] and len(classes) == 14
    rows = {(r["class"], r["other"]): r.relation for r in matching.lexical_class_relations(spark, folder).collect()}
    # four copies: the three places of 0 go to 1, 2 and 3, so that the three nearest have no relation of 0 to 4 or 5
    top = {(r["id"], r["other"]) for r in matching.lexical_relations(spark, folder).collect()}
    assert not {(0, 4), (0, 5)} & top
    assert {(0, 0), (0, 4), (0, 5), (100, 100), (100, 104)} <= set(rows) and (7, 7) not in rows


def test_class_pairs_are_all_pairs_at_the_floor(spark, folder):
    keywords = matching._keywords(spark, folder).collect()
    classes = {r["id"]: r["class"] for r in matching.lexical_classes(spark, folder).collect()}
    unit = {r["id"]: np.array(r.vector) / (np.linalg.norm(r.vector) or 1) for r in keywords}
    wanted = {tuple(sorted((classes[a["id"]], classes[b["id"]]))) for a in keywords for b in keywords if a["id"] < b["id"] and a.group == b.group and unit[a["id"]] @ unit[b["id"]] >= matching.FLOOR}
    assert {(r["class"], r["other"]) for r in matching.lexical_class_relations(spark, folder).collect()} == wanted
