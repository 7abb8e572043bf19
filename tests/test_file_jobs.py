"""Files: many headers in one scan, validity of whole files, runs that may be repeated, pruned slices, picks by hash, streams of bundles."""

import hashlib
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators import incremental as I, risk_model as rm
from ledgermill.sources import readers as S, writers as Wr
from ledgermill.streaming import jobs


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="ledgermill-files-"))


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


def test_a_thousand_headers_one_plan(spark, folder):
    for i in range(1000):
        names = ["UniqueID", "ROA", f"extra{i}"] if i % 2 else [f"extra{i}", "PeriodeTahun", "UniqueID"]
        cells = [f"u{i}", "nan" if i % 4 == 1 else str(i / 8), '"a,""b"'] if i % 2 else ["x", str(2000 + i), f'"u{i}"']
        (folder / f"f{i}.csv").write_text(("﻿" if i == 0 else "") + ",".join(names) + "\n\n" + ",".join(cells) + "\r\n")
    table = S.sector_csv(spark, str(folder))
    rows = {r.UniqueID: r for r in table.collect()}
    assert len(rows) == 1000 and rows["u0"].PeriodeTahun == 2000 and rows["u3"].ROA == 0.375 and rows["u5"].ROA is None and rows["u7"].PeriodeTahun is None
    many, few = S.sector_csv(spark, str(folder)), S.sector_csv(spark, [str(folder / "f0.csv"), str(folder / "f1.csv")])     # not run
    assert plan_of(many).count("\n") == plan_of(few).count("\n") and "Union" not in plan_of(many)
    wide = S.sector_csv_by_header(spark, [str(folder / f"f{i}.csv") for i in range(6)])
    assert {f"extra{i}" for i in range(6)} <= set(wide.columns) and wide.where("UniqueID = 'u3'").first()["extra3"] == 'a,"b'


def test_headers_of_odd_files(spark, folder):
    (folder / "a.csv").write_text("UniqueID,UniqueID,ROA\nfirst,second,1\nUniqueID,UniqueID,ROA\nshort\n")     # a line like the header is data
    (folder / "none.csv").write_text("")
    (folder / "other.csv").write_text("foreign\n1\n")
    rows = S.sector_csv(spark, str(folder)).select("UniqueID", "ROA").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("first", 1.0), ("UniqueID", None), ("short", None), (None, None)], key=str)
    assert S.sector_csv_by_header(spark, []).count() == 0


def test_validity_of_files_of_lines(spark, folder):
    good = {"nama_file": "a.pdf", "hasil_ekstraksi": {"x": 1}}
    files = {"good": [good, {**good, "nama_file": "b.pdf"}], "gap": [good, {"nama_file": "c"}], "both": [{"nama_file": "c"}, "{cut", good], "cut": ["{cut", good], "none": []}
    for name, records in files.items():
        (folder / f"{name}.json").write_text("\n\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    rows = S.extraction_files(spark, str(folder), lines=True)
    assert sorted(r.nama_file for r in rows.collect()) == ["a.pdf", "b.pdf"]
    rejected = {Path(r.source).stem: r.reason for r in S.rejected_extractions(spark, str(folder), lines=True).collect()}
    assert rejected == {"gap": S.MISSING_KEY, "both": S.UNREADABLE, "cut": S.UNREADABLE}
    assert {(r.nama_file, r.records) for r in I.first_records(rows).collect()} == {("a.pdf", 1), ("b.pdf", 1)}
    lists = folder / "lists"
    lists.mkdir()
    for name, body in {"ok": [good], "single": good, "gap": [good, {"hasil_ekstraksi": {}}], "other": {"data": 1}, "empty": []}.items():
        (lists / f"{name}.json").write_text(json.dumps(body))
    (lists / "cut.json").write_text("[{")
    assert {Path(r.source).stem: r.reason for r in S.rejected_extractions(spark, str(lists)).collect()} == {
        "gap": S.MISSING_KEY, "other": S.MISSING_KEY, "cut": S.UNREADABLE}
    assert S.extraction_files(spark, str(lists)).count() == 2


def test_runs_count_once(spark, folder):
    table = spark.createDataFrame([(1, "x", 2.0), (2, "y", None)], "id int, kind string, v double")
    path = str(folder / "runs")
    for run, rows in (("r1", table), ("r2", table.withColumn("more", F.lit("m"))), ("r1", table.where("id = 1"))):
        Wr.write_run(rows, path, run, ["kind"])
    table.write.partitionBy("kind").json(f"{path}/records/run=r3/attempt=lost")         # failed before its manifest
    found = Wr.read_runs(spark, path)
    assert sorted((r.run, r.id, r.kind, r.v, r.more) for r in found.collect()) == [("r1", 1, "x", 2.0, None), ("r2", 1, "x", 2.0, "m"), ("r2", 2, "y", None, "m")]
    assert Wr.read_runs(spark, path, ["r2"]).count() == 2 and Wr.read_runs(spark, path, []).count() == 0


def test_slices_read_their_folders_only(spark, folder):
    rows = spark.createDataFrame([(f"u{i}", s, 2018 + i % 5, float(i)) for i in range(100) for s in ("agro", "tambang", "jasa")],
                                 f"UniqueID string, {V.SECTOR} string, PeriodeTahun int, ROA double")
    rows.write.partitionBy(V.SECTOR, "PeriodeTahun").parquet(str(folder / "t"))
    part = rm.slice_rows(spark.read.parquet(str(folder / "t")), ["agro"], first_year=2021)
    assert part.count() == 40
    plan = plan_of(part)
    assert "PartitionFilters: [" in plan and V.SECTOR in plan.split("PartitionFilters: [")[1].split("]")[0]
    part.collect()
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().head()
    files = len(part.inputFiles())
    read = scan.metrics().get("numFiles").get().value()
    assert 0 < read < files and read == len({r[0] for r in part.select(F.input_file_name()).collect()})


def test_picks_by_a_hash_of_any_engine(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(2000)] + [(None, 7)], "k long, g int")
    left, right = I.hash_split(rows, "k", 30, seed=9)

    def digest(k):
        return hashlib.md5(f"9:{'' if k is None else k}".encode()).hexdigest()
    keys = [*range(2000), None]
    assert {r.k for r in left.collect()} == {k for k in keys if int(digest(k)[:7], 16) % 100 < 30}
    assert left.count() + right.count() == 2001
    picked = {r.g: r.k for r in I.one_per_group(rows, "g", "k", seed=9).collect()}
    assert picked == {**{g: min((k for k in range(2000) if k % 3 == g), key=digest) for g in range(3)}, 7: None}


def test_bundles_arrive_once(spark, folder):
    docs = spark.createDataFrame([(f"/in/d{i}.txt", f"Jumlah aset {i + 10} 9") for i in range(6)], "path string, text string")
    for _ in range(2):
        docs.limit(3).write.mode("ignore").parquet(str(folder / "in"))
        jobs.parse_arriving_documents(spark, str(folder / "in"), str(folder / "out"), str(folder / "cp"), file_format="parquet", files_per_trigger=1).awaitTermination()
    found = spark.read.parquet(str(folder / "out")).where("t IS NOT NULL")
    assert found.count() == 3 and {r.item for r in found.collect()} == {V.ASSETS}


def test_replayed_batches_count_once(spark, folder):
    root = str(folder / "m")
    rows = spark.createDataFrame([(f"u{i}", ["High", "Low", "Medium"][i % 3], "agro", float(i % 3) + i / 1000) for i in range(60)],
                                 f"UniqueID string, {V.TARGET} string, {V.SECTOR} string, ROA double")
    small = {"rounds": 1, "depth": 1}
    jobs.start_model(rows, root, jobs.CONTINUED, **small)
    for batch, part in ((0, rows), (1, rows.where(f"{V.TARGET} = 'Low'")), (2, rows), (0, rows), (2, rows)):
        jobs.offer_batch(part, batch, root, jobs.CONTINUED, **small)
    assert sorted(map(tuple, jobs.update_log(spark, root).collect())) == [
        (0, rm.UPDATED, 60, 1), (1, rm.SINGLE_CLASS, 20, 1), (2, rm.UPDATED, 60, 3)]
    assert len(jobs.latest_model(spark, root, algorithm=jobs.CONTINUED).trees) == 3 and not (folder / "m" / "history").exists()


def test_truth_files_are_written_by_many_tasks(spark, tmp_path):
    """A supplier table of one row group is one task; its files are not, but rows of one supplier share a file."""
    import glob

    from ledgermill.plans import queries_jobs
    from ledgermill.session import shared_folder
    spark.createDataFrame([(i, float(i)) for i in [*range(40), *range(40)]], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/truth-*"))
    truth = queries_jobs.truth_files(spark, str(tmp_path))
    assert sorted((r.supplier, r.assets, r.items) for r in truth.collect()) == [(i, float(i), 2) for i in range(40) if i % 10 not in (4, 7)]
    (made,) = set(glob.glob(f"{folder}/truth-*")) - before
    files = glob.glob(f"{made}/supplier=*/part-*")
    assert len(files) == 40 and len({f.rsplit("/", 1)[1][:10] for f in files}) > 1
