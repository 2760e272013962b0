"""Evaluation of answered pages and trees of runs on small cases."""

import datetime as dt
import json

from drawgraph.operators import evaluate, store

AT = "v string, group_id string, sheet string"


def results(spark, pages, truth, answers):
    made = evaluate.page_results(spark.createDataFrame(pages, AT), spark.createDataFrame(truth, "group_id string, sheet string, candidate_id string, expected string"), spark.createDataFrame(answers, AT + ", candidate_id string, actual string"), ["v"])
    return made, evaluate.group_results(made, ["v"])


def test_evaluation(spark):
    pages = [("1", "a", "1"), ("1", "a", "2"), ("1", "b", "1"), ("1", "c", "9"), ("2", "b", "1")]
    truth = [("a", "1", "C1", "include"), ("a", "1", "C2", None), ("a", "1", "C3", "exclude"), ("a", "1", "C4", "exclude"), ("a", "7", "C9", "include"), ("c", "1", "C1", "include")]
    answers = [("1", "a", "1", "C1", "include"), ("1", "a", "1", "C3", "include"), ("1", "a", "1", "C8", "include"), ("1", "a", "2", "C1", "include"), ("1", "b", "1", "C1", "include")]
    made, groups = results(spark, pages, truth, answers)
    assert {(r.v, r.group_id, r.sheet): (r.status, r.total, r.correct) for r in made.collect()} == {("1", "a", "1"): ("evaluated", 4, 2), ("1", "a", "2"): ("empty", 0, 0), ("1", "b", "1"): ("not_configured", 0, 0), ("1", "c", "9"): ("empty", 0, 0), ("2", "b", "1"): ("not_configured", 0, 0)}
    a = groups.filter("group_id = 'a'").first()  # C2 was to have no status and has no answer: that counts as equal, yet is missing
    assert [tuple(m) for m in a.mismatches] == [("1", "C3", "exclude", "include"), ("1", "C4", "exclude", None)] and a.missing == ["1:C2", "1:C4"] and a.extra == ["1:C8"] and (a.accuracy, a.status) == (50.0, "evaluated")
    assert [(r.v, r.total, r.groups, r.accuracy, r.empty) for r in evaluate.version_results(groups, ["v"]).collect()] == [("1", 4, 3, 50.0, 1)]  # version 2 was asked nothing


def test_evaluation_of_nothing(spark):
    made, groups = results(spark, [], [], [])
    assert made.count() == 0 and groups.count() == 0


def test_run_trees(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("r", 5, at, 2, 1, "running", 1.0, None), ("r", 6, at, 1, 3, "complete", None, 4), ("r", 7, at, 2, 1, "complete", 0.5, 2), ("r", 8, at, 2, 0, "error", None, None), ("r", 9, at, 2, 0, "complete", None, None), *[("s", i, at, 0, 0, "complete", None, None) for i in range(30)]]
    log = spark.createDataFrame(rows, "run_id string, seq long, at timestamp, line_id int, page int, status string, seconds double, tokens long")
    trees = {r.run_id: json.loads(r.tree) for r in store.run_trees(log).collect()}
    assert trees["r"]["line_ids"] == [2, 1] and trees["r"]["status"] == "complete" and trees["r"]["lines"][0]["pages"] == [0, 1]
    page = trees["r"]["lines"][0]["page_results"]
    assert page[0]["error"] == 8 and page[0]["status"] == "complete" and page[1] == {"page_number": 1, "status": "complete", "error": None, "seconds": 1.5, "tokens": 2, "n_events": 2, "events": [{"seq": 5, "status": "running"}, {"seq": 7, "status": "complete"}]}
    assert [e["seq"] for e in trees["s"]["lines"][0]["page_results"][0]["events"]] == list(range(18, 30)) and trees["s"]["lines"][0]["page_results"][0]["n_events"] == 30
    assert store.run_trees(log.limit(0)).count() == 0


def test_manual_edits(spark):
    from drawgraph.operators import review

    decisions = spark.createDataFrame([(1, 1, None, "exact", None), (1, 2, "include", "exact", "r"), (2, 1, "exclude", "exact", None)], "page int, dim_id long, decision string, status string, reason string")
    edits = spark.createDataFrame([(1, 1, 2, "exclude"), (1, 1, 1, "include"), (1, 1, 3, "maybe"), (1, 1, 4, None), (1, 9, 1, "include"), (2, 1, 1, "ambiguous")], "page int, dim_id long, seq int, status string").selectExpr("*", "timestamp'2024-01-01' as changed_at")
    log = review.manual_edits(decisions, edits)
    assert {(r.page, r.dim_id, r.seq): (r.old_status, r.rating, r.error) for r in log.collect()} == {(1, 1, 1): ("exact", "down", None), (1, 1, 2): ("include", "down", None), (1, 1, 3): (None, None, "invalid_status"), (1, 1, 4): (None, None, "invalid_status"), (1, 9, 1): (None, None, "not_found"), (2, 1, 1): ("exclude", "down", None)}
    after = {(r.page, r.dim_id): (r.decision, r.reason, r.edits) for r in review.edited_decisions(decisions, log).collect()}
    assert after == {(1, 1): ("exclude", "Ручная правка пользователя: include -> exclude.", 2), (1, 2): ("include", "r", 0), (2, 1): ("ambiguous", "Ручная правка пользователя: exclude -> ambiguous.", 1)}


def test_connection_lines(spark):
    from drawgraph.operators import words

    rows = [(1, 1, 50.0, 0.0, "3"), (1, 2, 10.0, 4.0, "лист"), (1, 3, 0.0, 4.0, " "), (1, 4, 90.0, 12.0, "x"), (1, 5, 5.0, 30.0, "ЛИСТОВ 7"), (1, 6, 5.0, 60.0, "Подключение"), (1, 7, 9.0, 60.0, "A"), (2, 1, 0.0, 60.0, None)]
    w = spark.createDataFrame(rows, "page int, pos int, x0 double, y0 double, text string").selectExpr("page", "pos", "x0", "y0", "x0 + 10 as x1", "y0 + 8 as y1", "text")
    assert [tuple(r)[:3] + (r.kind, r.sheet, r.y1) for r in words.connection_lines(w).orderBy("line").collect()] == [(1, 1, "лист 3 x", "continuation", "3", 20.0), (1, 3, "Подключение A", "tie_in", None, 68.0)]  # 12 is 4 below the middle of 4 to 12
    assert words.connection_lines(w.limit(0)).count() == 0


def test_run_overviews(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("r", 1, at, 0, 0, "error", None, None), ("s", 2, at, 0, 0, "complete", 1.0, 3)], "run_id string, seq long, at timestamp, line_id int, page int, status string, seconds double, tokens long")
    confirmations = spark.createDataFrame([("r", 1, ["a", "b"], ["c"]), ("r", 2, [], ["d", "e"]), ("r", 3, None, None)], "run_id string, line_id int, accepted array<string>, kept array<string>")
    got = {r.run_id: (r.fixes, r.kept, r.net, r.manual_edits, r.positive, r.negative, r.status, r.seconds, r.tokens) for r in store.run_overviews(log, confirmations, spark.createDataFrame([("s",), ("s",)], "run_id string"), spark.createDataFrame([("r", "up"), ("r", "down")], "run_id string, rating string")).collect()}
    assert got == {"r": (2, 3, -1, 0, 1, 1, "error", None, None), "s": (0, 0, 0, 2, 0, 0, "complete", 1.0, 3)}
