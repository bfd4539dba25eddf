"""Plans of queries that must grow with their input and no faster."""

from lexforge.operators import ledger, printed, sequences
from lexforge.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_reading_columns_reads_its_words_once(spark):
    text = plan(spark, "reading_columns")
    assert text.count("FileScan") == 1 and "Join" not in text


def test_rows_of_one_small_file_go_to_several_tasks(spark):
    for name in ("cited_provisions", "amending_sentences", "matcher_pointers"):
        assert "RoundRobinPartitioning(4)" in plan(spark, name), name
    assert catalog.queries()["cited_provisions"](spark, SF).rdd.getNumPartitions() == 4


def test_merge_intervals_has_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sequences, "ROWS_A_TASK", 10)
    rows = spark.range(100).selectExpr("id % 25 AS k", "id AS lo", "id + 1 AS hi")
    merged = sequences.merge_intervals(rows, ["k"], "lo", "hi", 24)
    assert merged.rdd.getNumPartitions() == 10
    assert sorted(tuple(r) for r in merged.collect()) == [(k, k, k + 76, 4) for k in range(25)]


def test_forward_asof_looks_at_a_row_once(spark):
    """No frame of a window goes from its row to the end: for one key that reads all rows after each row."""
    left, right = spark.range(5).selectExpr("1 AS k", "id AS n"), spark.createDataFrame([(1, 2), (1, 3)], "k int, g long")
    got = ledger.forward_asof(left, right, "k", "n", "g", "at")
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower().replace("unboundedpreceding$(), unboundedfollowing", "")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 2), (1, 1, 2), (1, 2, 2), (1, 3, 3), (1, 4, 3)]


def test_words_of_an_issue_stay_in_its_task(spark):
    """Only the orders are shuffled, not the words and lines made from them."""
    assert plan(spark, "reading_columns").count("Exchange") == 1


def test_issues_are_read_from_arrow(spark):
    """No frame is built for each issue."""
    lines = spark.createDataFrame([], "issue int, page int, seq int, x0 double, x1 double, left double, right double, text string")
    assert "FlatMapGroupsInArrow" in printed.parse_issues(lines, ["issue"])._jdf.queryExecution().executedPlan().toString()
