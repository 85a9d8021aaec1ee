"""Snapshots, and counts observed while tables are written."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.operators import observe
from ledgerlens.plans import fixtures, report
from ledgerlens.plans.pipeline import run_cleaning, to_gold
from ledgerlens.sources import snapshots as S
from ledgerlens.spec import RAW

SF = "/root/testdata/sf0.001"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.latest(spark, path) is None and S.history(spark, path).isEmpty()
    with pytest.raises(FileNotFoundError):
        S.open_snapshot(spark, path)
    made = [S.publish(spark.range(n), path, facts={"rows": n}) for n in (3, 0, 5)]
    assert [m.version for m in made] == [1, 2, 3]
    assert [S.open_snapshot(spark, path, v).count() for v in (1, 2, 3)] == [3, 0, 5] and S.open_snapshot(spark, path).count() == 5
    assert [(r.version, r.facts["rows"]) for r in S.history(spark, path).orderBy("version").collect()] == [(1, 3.0), (2, 0.0), (3, 5.0)]
    with pytest.raises(FileNotFoundError):
        S.open_snapshot(spark, path, 4)
    assert S.expire(spark, path, keep=1) == [1, 2] and S.open_snapshot(spark, path).count() == 5
    assert len(S.snapshots(spark, path)) == 1 and S.publish(spark.range(1), path, base=3).version == 4


def test_two_writers_and_a_reader(spark, tmp_path):
    """Both start from version 1; one wins, the other is told, and the reader keeps what it opened."""
    path = str(tmp_path / "t")
    S.publish(spark.range(10), path)
    reader = S.open_snapshot(spark, path)
    slow, _ = S.draft_folder(path, "slow")
    spark.range(20).write.parquet(slow)
    assert S.publish(spark.range(30), path, base=1).version == 2
    assert reader.count() == 10  # read after the table was replaced
    with pytest.raises(S.Conflict):
        S.commit(spark, path, slow, "slow", base=1)
    with pytest.raises(S.Conflict):
        S.publish(spark.range(40), path, base=1, run_id="late")
    assert not (tmp_path / "t" / "run-late").exists()  # the loser's rows are gone
    assert S.open_snapshot(spark, path).count() == 30 and [s.version for s in S.snapshots(spark, path)] == [1, 2]


def test_one_of_many_writers_puts_a_pointer(spark, tmp_path):
    files, won = S._Files(spark, str(tmp_path)), []
    target = str(tmp_path / "pointer.json")
    writers = [threading.Thread(target=lambda i=i: won.append((i, files.put_if_absent(target, f"writer {i} " * 1000)))) for i in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    first = [i for i, ok in won if ok]
    assert len(won) == 8 and len(first) == 1 and files.read(target) == f"writer {first[0]} " * 1000
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["pointer.json"]


def test_failed_write_leaves_no_version(spark, tmp_path):
    path = str(tmp_path / "t")
    S.publish(spark.range(10), path)
    with pytest.raises(Exception, match="broken"):
        S.publish(spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")), path, run_id="bad")
    assert S.latest(spark, path).version == 1 and not (tmp_path / "t" / "run-bad").exists()


@pytest.fixture(scope="module")
def dirty(spark):
    return fixtures.dirty(spark, SF).cache()


def test_observed_counts_are_those_of_the_tables(spark, dirty, tmp_path):
    watched, raw = observe.observe_raw(dirty.repartition(5), RAW)
    watched.write.parquet(str(tmp_path / "raw"))
    kept, clean = observe.clean_observed(dirty, RAW)
    kept.select(*RAW.gold).write.parquet(str(tmp_path / "gold"))
    stats, gold = C.cleaning_stats(dirty, RAW).first(), spark.read.parquet(str(tmp_path / "gold"))
    before, after = raw(), clean()
    assert before.rows == stats.initial_rows == dirty.count() and before.rows - after.distinct_rows == stats.duplicate_rows_removed
    assert (after.negative_amounts, after.unreadable_times, after.final_rows) == (stats.invalid_amount_rows, stats.invalid_timestamp_rows, stats.final_rows)
    assert after.positive_rows == gold.where("is_fraud").count() and gold.count() == after.final_rows
    assert before.missing == {c: dirty.where(F.col(c).isNull()).count() for c in dirty.columns}
    assert after.missing == {c: gold.where(F.col(c).isNull()).count() for c in gold.columns}
    assert before.classes == {r.is_fraud and 1 or 0: r["count"] for r in dirty.groupBy("is_fraud").count().collect()}
    counted = report.quality_report(dirty, gold, RAW, counts=(before, after))
    both = [sorted((tuple(r)[:3] + (round(r.value, 9),) for r in d.collect()), key=repr) for d in (counted, report.quality_report(dirty, to_gold(dirty), RAW))]
    assert both[0] == both[1]


def test_the_input_is_parsed_once(spark, dirty, tmp_path):
    raw = str(tmp_path / "raw.csv")
    dirty.write.csv(raw, header=True)
    done = run_cleaning(spark, raw, str(tmp_path / "gold"), str(tmp_path / "report"))
    for df in (done.gold, done.report, done.checks):
        assert "csv" not in df._jdf.queryExecution().toString().lower()
    assert done.snapshot.facts["rows"] == done.gold.count()


def test_repeated_and_empty_rows(spark, dirty):
    none = dirty.limit(0)
    assert C.cleaning_stats(none, RAW).first().asDict() == dict.fromkeys(("initial_rows", "duplicate_rows_removed", "invalid_amount_rows", "invalid_timestamp_rows", "final_rows"), 0)
    twice = dirty.unionByName(dirty)
    a, b = C.cleaning_stats(dirty, RAW).first(), C.cleaning_stats(twice, RAW).first()
    assert b.initial_rows == 2 * a.initial_rows and b.final_rows == a.final_rows and b.invalid_amount_rows == a.invalid_amount_rows
