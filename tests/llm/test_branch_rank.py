from __future__ import annotations


def test_branches_are_ranked_when_all_are_kept(spark):
    from ledgerlens.llm.chat_trees import format_branches

    rows = [("a", 1, None, "user", "hi", 0.0), ("a", 2, 1, "assistant", "x", 0.9), ("a", 3, 1, "assistant", "y", 0.1),
            ("a", 4, 1, "assistant", "z", None), ("b", 1, None, "user", "hi", None)]
    m = spark.createDataFrame(rows, "conv string, node long, parent long, role string, text string, score double")
    assert {(r.conv, r.leaf): r["rank"] for r in format_branches(m).collect()} == {("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("b", 1): 1}
