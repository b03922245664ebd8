"""Jobs that go on after a kill: feeds with a ledger, stages with observed figures, reviews with a folded state."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import review
from shelfmark.plans.enrich import Rules, RunLog, enrich
from shelfmark.sources.store import Staging
from shelfmark.streaming import batches, reviews

HEAD = "part_number,brand,description\n"
COLUMNS = HEAD.strip().split(",")


def _feed(folder, name, lines, at):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text(HEAD + "".join(f"{x}\n" for x in lines))
    os.utime(path, (at, at))


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(F.expr(c) for c in columns)).collect())


NAME = "element_at(split(feed_file, '/'), -1)"


def test_ledger_over_files_after_a_kill(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    _feed(src, "b.csv", ["P1,siemens,breaker 230 V AC", ",abb,none", "P1,siemens,breaker 230 V AC", ",abb,none", "P2,3m,flap disc 60 grit"], 1000)
    _feed(src, "a.csv", ["P2,3m,flap disc 60 grit", "P3,abb,switch 10 A"], 2000)
    seen = []

    def killed_at_second(rows):
        seen.append(1)
        if len(seen) == 2:
            raise KeyError("killed")
        return rows

    stream = lambda: batches.feed_stream(spark, str(src), COLUMNS, 1)
    run = lambda **k: batches.run_batches(stream(), out, str(tmp_path / "cp"), Rules.starter, **k)
    with pytest.raises(Exception, match="killed"):
        run(prepare=killed_at_second)
    broken = spark.read.parquet(f"{out}/stages/batch_id=1").where("status = 'FAILED'").collect()
    assert [(r.stage_no, "killed" in r.message) for r in broken] == [(1, True)]
    first = [("b.csv", 1, 5, 5, 2, 3)]
    figures = (NAME, "first_row", "last_row", "processed", "succeeded", "failed")
    assert _rows(batches.ledger(spark, out), *figures) == first
    waiting = batches.feed_files(spark, str(src))
    assert batches.job_status(spark, out, waiting).first().asDict() == {"files": 1, "files_open": 1, "processed": 5, "succeeded": 2, "failed": 3, "status": "PROCESSING"}
    run()
    assert _rows(batches.ledger(spark, out), *figures) == [("a.csv", 1, 2, 2, 1, 1)] + first
    assert batches.job_status(spark, out, waiting).first().status == "COMPLETED"
    assert _rows(batches.errors(spark, out), NAME, "feed_row", "message") == [
        ("a.csv", 1, "Row 1: Repeats row 5 of b.csv, skipped"), ("b.csv", 2, "Row 2: Missing part number, skipped"),
        ("b.csv", 3, "Row 3: Repeats row 1 of b.csv, skipped"), ("b.csv", 4, "Row 4: Missing part number, skipped")]
    assert [r.feed_row for r in batches.errors(spark, out, newest=1).collect()] == [1]
    assert _rows(batches.read_output(spark, out, "products", ["product_id"]), "part_number") == [("P1",), ("P2",), ("P3",)]
    # the first batch again: nothing changes; under another checkpoint: refused
    before = _rows(batches.ledger(spark, out), "batch_id", *figures)
    process = batches.batch_writer(out, Rules.starter)
    scan = lambda name: batches.placed(spark.read.schema("part_number string, brand string, description string").option("header", True).csv(f"{src}/{name}"))
    process(scan("b.csv"), 0)
    assert _rows(batches.ledger(spark, out), "batch_id", *figures) == before
    with pytest.raises(ValueError, match="another checkpoint"):
        process(scan("a.csv"), 0)


def test_row_numbers_over_blocks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(HEAD + "".join(f"P{i},abb,{'d' * (i % 50)}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = batches.placed(spark.read.option("header", True).csv(str(path)))
        assert d.rdd.getNumPartitions() > 1
        got = batches.numbered(d, Staging(spark, f"file://{tmp_path}/stage"))
        assert got.where(F.concat(F.lit("P"), "feed_row") != F.col("part_number")).count() == 0 and got.count() == 3000
        assert "feed_block" not in got.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_null_ids_and_empty_batches(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, "P1", None), ("f", 2, "P2", 7), ("f", 3, "P3", 7)], "feed_file string, feed_row bigint, part_number string, product_id bigint")
    assert _rows(batches.judged(rows, None), "feed_row", "coalesce(reject_reason, '')") == [(1, "Missing product id"), (2, ""), (3, "Repeats row 2 of f")]
    taken = spark.createDataFrame([(7, "x/g", 4)], "product_id bigint, feed_file string, feed_row bigint")
    assert _rows(batches.judged(rows.where("feed_row > 1"), taken), "reject_reason") == [("Repeats row 4 of g",)] * 2
    empty = spark.createDataFrame([], "part_number string, brand string, description string, feed_file string, feed_block bigint")
    batches.batch_writer(str(tmp_path / "out"), Rules.starter)(empty, 0)
    assert batches.ledger(spark, str(tmp_path / "out")).count() == 0
    assert batches.job_status(spark, str(tmp_path / "out")).first().processed == 0


def test_figures_are_those_of_the_run(spark):
    rows = [(1, "P1", "siemens", "circuit breaker 230 V AC 10 A"), (2, None, None, None), (3, "P3", "3m", "flap disc 60 grit")]
    feed = spark.createDataFrame(rows, "product_id int, part_number string, brand string, description string")
    log = RunLog()
    out = enrich(feed, Rules.starter(spark), log=log)
    got = {(r.stage_no, r.figure): r.n for r in log.table(spark).collect()}
    assert {r.status for r in log.table(spark).collect()} == {"COMPLETED"} and {k[0] for k in got} == set(range(1, 9))
    assert got[1, "products"] == 3 and got[1, "without_text"] == 1
    assert got[3, "claims"] == out["claims"].count() and got[6, "attributes"] == out["attributes"].count()
    assert got[5, "conflicts"] == out["conflicts"].count() and got[5, "checks"] == out["validation"].count()
    assert got[5, "passed"] == out["validation"].where("status = 'PASSED'").count()
    assert got[8, "to_review"] + got[8, "reviewed"] == 3
    plain = enrich(feed, Rules.starter(spark))
    for name in ("products", "attributes", "validation"):
        assert out[name].exceptAll(plain[name].select(*out[name].columns)).count() == 0


def test_a_run_that_breaks_says_where(spark):
    feed = spark.createDataFrame([(1, "P1", "siemens", "breaker 230 V AC")], "product_id int, part_number string, brand string, description string")
    rules = Rules.starter(spark)
    rules.checks = (lambda *_: 1 / 0,)
    log = RunLog()
    with pytest.raises(Exception):
        enrich(feed, rules, log=log)
    state = {r.stage_no: r.status for r in log.table(spark).collect()}
    assert state == {1: "COMPLETED", 2: "COMPLETED", 3: "COMPLETED", 4: "COMPLETED", 5: "FAILED", 6: "PENDING", 7: "PENDING", 8: "PENDING"}
    assert log.error
    rules.brands = rules.brands.withColumn("canonical", F.raise_error(F.lit("no brands")).cast("string"))
    log = RunLog()
    with pytest.raises(Exception):
        enrich(feed, rules, log=log)
    assert log.table(spark).where("status = 'FAILED'").first().stage_no == 1


ACTIONS = ["ACCEPT_AI_VALUE", "SELECT_ALTERNATIVE", "MARK_UNKNOWN", "DISMISS_CONFLICT", "NONSENSE"]


def _decisions(spark, n, of):
    t = dt.datetime(2024, 1, 1)
    rows = [(1 if i % 3 == 0 else i * 7 % of, "voltage", ACTIONS[i * 11 % 5], f"{i} V" if i % 2 else None, None, t + dt.timedelta(seconds=i * 37 % n), i) for i in range(n)]
    return spark.createDataFrame(rows, reviews.DECISION_SCHEMA)


def test_review_state_stays_small_and_equals_the_log(spark, tmp_path):
    out, of = str(tmp_path / "out"), 12
    log = _decisions(spark, 240, of)
    a = spark.createDataFrame([(p, "voltage", "5 V", "5 V", "V", 0.5, "CONFLICT") for p in range(of)],
                              "product_id bigint, name string, value string, normalized_value string, unit string, confidence double, status string")
    c = spark.createDataFrame([(p, "voltage", "OPEN") for p in range(of)], "product_id bigint, attribute string, status string")
    assert reviews.current(a, out, "attributes", 4).exceptAll(a).count() == 0
    process = reviews.decision_writer(out, lambda: a, lambda: c, buckets=4, compact_after=2)
    state = reviews.ReviewState(spark, out, 4, 2)
    most = []
    for b in range(8):
        process(log.where(F.col("decision_id") % 8 == b), b)
        most.append(len(state.paths()))
        if b in (3, 6):
            process(log.where(F.col("decision_id") % 8 == b), b)  # done again
    assert max(most) <= 4 * (1 + 2) and len(state.paths([2])) <= 3
    want = review.apply_decisions(a, log).select(*a.columns)
    got = reviews.current(a, out, "attributes", 4)
    assert got.exceptAll(want).count() == 0 and got.count() == of
    shut = reviews.current(c, out, "conflicts", 4)
    assert shut.exceptAll(review.close_conflicts(c, log).select(*c.columns)).count() == 0 and shut.count() == of
    assert spark.read.parquet(f"{out}/rejected").count() == review.split_decisions(log)[1].count()
    # the last batch's own rows are those of the state
    last = spark.read.parquet(f"{out}/attributes/batch_id=7").select(*a.columns)
    assert last.count() and last.exceptAll(want).count() == 0


def test_a_killed_compaction_changes_nothing(spark, tmp_path):
    import shutil

    out = str(tmp_path / "out")
    state = reviews.ReviewState(spark, out, 2, 100)
    usable, _ = review.split_decisions(_decisions(spark, 60, 6))
    for b in range(3):
        state.add(usable.where(F.col("decision_id") % 3 == b), b)
    want = _rows(review.folded(state.read()), "product_id", "set", "last_move", "first_action")
    shutil.copytree(f"{out}/state_2/delta", f"{out}/kept")
    state.compact([0, 1], 2)
    assert len(state.paths()) == 2
    shutil.copytree(f"{out}/kept", f"{out}/state_2/delta", dirs_exist_ok=True)
    assert len(state.paths()) > 2
    assert _rows(review.folded(state.read()), "product_id", "set", "last_move", "first_action") == want
    state.compact([0, 1], 2)
    assert len(state.paths()) == 2
    assert _rows(review.folded(state.read()), "product_id", "set", "last_move", "first_action") == want
