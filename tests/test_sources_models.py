import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators import incremental as I, risk_model as rm
from ledgermill.sources import readers as S, writers as Wr
from ledgermill.sources.keywords import CORPORATE, INDIVIDUAL, keyword_table
from ledgermill.streaming import jobs


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="ledgermill-test-"))


def features(spark, n=60, sectors=("Agro", "Konstruksi"), years=(2020, 2022)):
    rows = [(f"id{i}", sectors[i % len(sectors)], years[i // 3 % len(years)], float(i % 3) + 0.01 * i, None if i % 5 == 0 else 2.0,
             ["High", "Low", "Medium"][i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "UniqueID string, Sektor string, PeriodeTahun int, CurrentRatio double, ROA double, RiskCategory string")


def test_extraction_files(spark, folder):
    record = {"nama_file": "a.pdf", "hasil_ekstraksi": {"Jumlah aset": 5.0}}
    for name, body in {"list": [record, {**record, "hasil_ekstraksi": {"x": 1}}], "bare": {**record, "nama_file": "b.pdf"}, "gap": [record, {"nama_file": "c"}],
                       "empty": []}.items():
        (folder / f"{name}.json").write_text(json.dumps(body))
    (folder / "broken.json").write_text("{nope")
    rows = S.extraction_files(spark, str(folder))
    assert sorted((r.pos, r.nama_file) for r in rows.collect()) == [(0, "a.pdf"), (0, "b.pdf"), (1, "a.pdf")]
    assert I.first_record(rows, "a.pdf").first()["hasil_ekstraksi"] == {"Jumlah aset": 5.0}


def test_sector_csv(spark, folder):
    (folder / "one.csv").write_text("UniqueID,Sektor,PeriodeTahun,ROA,RiskCategory\nu1,Agro,2020,nan,Low\n")
    (folder / "two.csv").write_text("UniqueID,Sektor,PeriodeTahun,CurrentRatio,RiskCategory\nu2,Agro,2021,1.5,High\n")
    out = S.sector_csv_by_header(spark, [str(folder / "one.csv"), str(folder / "two.csv")])
    rows = {r.UniqueID: r for r in out.collect()}
    assert rows["u1"].ROA is None and rows["u2"].CurrentRatio == 1.5 and rows["u2"].PeriodeTahun == 2021
    assert set(V.NUMERIC_FEATURES) <= set(out.columns)


def test_outlook_text_and_truth(spark, folder):
    (folder / "r.json").write_text(json.dumps({"risiko_industri": {"Keuangan": {"Bank": "Rendah", "Asuransi": "Menengah"}}}))
    assert S.outlook_json(spark, str(folder / "absent.json"), str(folder / "r.json")).count() == 2
    assert S.outlook_json(spark, str(folder / "absent.json")) is None
    (folder / "t.csv").write_text('a,,"b,c"\n\n1,2\n')
    assert S.delimited_documents(spark, str(folder / "t.csv")).first()["text"] == "a\tnan\tb,c\n1\t2\tnan"
    (folder / "g").mkdir()
    (folder / "g" / "x.1.json").write_text(json.dumps({"ground_truth_data": {"a": 1}}))
    (folder / "g" / "y.json").write_text(json.dumps({"other": 1}))
    assert [(r.stem, r.truth) for r in S.ground_truth(spark, str(folder / "g")).collect()] == [("x.1", {"a": 1.0})]


def test_scan_and_incremental(spark, folder):
    for name in ("a.PDF", "b.txt", "c.exe"):
        (folder / name).write_text("x")
    files = S.scan_folder(spark, str(folder))
    assert sorted(r.nama_file for r in files.collect()) == ["a.PDF", "b.txt"]
    (folder / "none").mkdir()
    (folder / "none" / "c.exe").write_text("x")
    assert S.scan_folder(spark, str(folder / "none")).first()["nama_file"] == "TIDAK_ADA_FILE"
    keyed = I.with_input_key(files, "method:text")
    done = keyed.where("nama_file = 'b.txt'").select("key", F.lit("old").alias("result"))
    fresh = I.incremental_results(keyed, done, lambda new: new.select("key", F.lit("new").alias("result")))
    assert sorted(r.result for r in fresh.collect()) == ["new", "old"]
    stamps = spark.sql("SELECT timestamp'2024-01-31 00:00:00' AS stored_at UNION ALL SELECT timestamp'2023-12-31 23:59:59' UNION ALL SELECT timestamp'2024-01-01 00:00:00'")
    assert I.purge(stamps, now=F.lit("2024-01-31 00:00:00").cast("timestamp")).count() == 2


def test_writers(spark, folder):
    docs = spark.createDataFrame([("a", {"x": (1.0, 2.0), "y": (None, None)}, None), ("b", {"x": (None, None)}, "Error: rusak")],
                                 "nama_file string, items map<string,struct<t:double,t_minus_1:double>>, note string")
    Wr.write_period_records(docs, str(folder / "out"))
    back = spark.read.json(str(folder / "out"))
    assert sorted((r.nama_file, r.period_kind) for r in back.collect()) == [("a", "t"), ("a", "t-1"), ("b", "t")]
    twice = Wr.period_records(docs.unionByName(docs).drop("note")).collect()
    assert sorted((r.nama_file, r.period_kind, r.hasil_ekstraksi["x"]) for r in twice) == [("a", "t", 1.0)] * 2 + [("a", "t-1", 2.0)] * 2
    records = spark.sql("SELECT 'PT. A' AS applicantName, timestamp'2024-01-01 00:00:00' AS lastUpdateTimestamp")
    Wr.write_risk_records(records, str(folder / "risk"))
    assert spark.read.json(str(folder / "risk")).first()["applicant_slug"] == "PT_A"
    assert keyword_table(spark, CORPORATE, INDIVIDUAL).where("keyword_set = 'individu'").select("item").distinct().count() == 10


def test_training_guards_and_prediction(spark, folder):
    data = features(spark)
    model = rm.train(data)
    assert model.labels == ("High", "Low", "Medium") and rm.train(data.where("1 = 0")) is None
    out = rm.predict(data, model, ["UniqueID"]).collect()
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.risk_score == V.RISK_POINTS[r.risk_category] for r in out)
    assert rm.predict(data, None, ["UniqueID"]).first()["error"].startswith("Model ML")
    low = data.where("RiskCategory = 'Low'")
    assert [rm.update_guard(b, m) for b, m in [(data.where("1 = 0"), model), (data, None), (data.withColumn(V.TARGET, F.lit("Extreme")), model),
                                               (low, model), (data, model)]] == [rm.EMPTY, rm.NO_MODEL, rm.UNSEEN, rm.SINGLE_CLASS, rm.UPDATED]
    assert rm.update(low, model, data)[0] is model
    model.save(str(folder / "m"))
    again = {r.UniqueID: r.risk_category for r in rm.predict(data, rm.RiskModel.load(str(folder / "m")), ["UniqueID"]).collect()}
    assert again == {r.UniqueID: r.risk_category for r in out}


def test_staged_training_skips_a_single_class_batch(spark):
    rows = [(f"{s}{y}{i}", s, y, float(i), 1.0, "Low" if s == "Agro" and y <= 2021 else ["High", "Low", "Medium"][i % 3])
            for s in ("Pertambangan", "Konstruksi", "Agro") for y in (2020, 2021, 2022) for i in range(6)]
    data = spark.createDataFrame(rows, features(spark, 1).schema)
    initial = rm.slice_rows(data, ["Pertambangan", "Konstruksi"], last_year=2021)
    _, log = rm.staged_training(data, initial, [("new", rm.slice_rows(data, ["Agro"], last_year=2021)),
                                                ("years", rm.slice_rows(data, first_year=2022))])
    assert log == [("new", rm.SINGLE_CLASS), ("years", rm.UPDATED)]


def test_boosted_option_gives_shares(spark):
    data = features(spark, 30)
    out = rm.predict(data, rm.train(data, "boosted"), ["UniqueID"]).collect()
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 for r in out)


def test_scale_and_samples(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, y double")
    assert {(r.feature, r["mean"], r["std"]) for r in rm.fit_scale(rows, ["x", "y"]).collect()} == {("x", 2.0, 1.0), ("y", 5.0, 1.0)}
    data = features(spark)
    left, right = I.hash_split(data, "UniqueID")
    assert left.count() + right.count() == 60 and left.join(right, "UniqueID").count() == 0
    assert I.one_per_group(data, "Sektor", "UniqueID").count() == 2


def test_streams(spark, folder):
    source = folder / "in"
    source.mkdir()
    (source / "a.txt").write_text("Tahun buku 2022\nLaba kotor 5 4")

    def run():
        jobs.parse_arriving_documents(spark, str(source), str(folder / "out"), str(folder / "cp")).awaitTermination()
        return spark.read.parquet(str(folder / "out")).where("t IS NOT NULL")
    assert [(r.nama_file, r.item, r.t) for r in run().collect()] == [("a.txt", "Laba bruto", 5.0)]
    (source / "b.txt").write_text("Laba kotor 7")
    assert sorted((r.nama_file, r.t) for r in run().collect()) == [("a.txt", 5.0), ("b.txt", 7.0)]

    root = str(folder / "model")
    data = features(spark)
    jobs.start_model(data, root)
    data.where("RiskCategory = 'Low'").coalesce(1).write.parquet(str(folder / "batches"))
    batches = spark.readStream.schema(data.schema).parquet(str(folder / "batches"))
    jobs.update_model_on_arrival(batches, root, str(folder / "cp2")).awaitTermination()
    assert spark.read.parquet(f"{root}/registry/*").count() == 1                     # one class only: not updated
    data.coalesce(1).write.mode("append").parquet(str(folder / "batches"))
    jobs.update_model_on_arrival(batches, root, str(folder / "cp2")).awaitTermination()
    assert spark.read.parquet(f"{root}/registry/*").agg(F.max("version")).first()[0] == 2
    assert spark.read.parquet(f"{root}/history").count() == 120


def test_mixed_folder_keeps_every_row(spark, folder):
    (folder / "one.csv").write_text("UniqueID,Sektor,ROA\nu1,Agro,0.5\nu2,Agro,nan\n")
    (folder / "two.csv").write_text("RiskCategory,UniqueID,Other\nHigh,u3,x\n")
    (folder / "three.csv").write_text("UniqueID,Sektor,ROA\nu4,Tani,bad\n")
    rows = {r.UniqueID: r for r in S.sector_csv(spark, str(folder)).collect()}
    assert sorted(rows) == ["u1", "u2", "u3", "u4"]
    assert (rows["u1"].ROA, rows["u2"].ROA, rows["u3"].RiskCategory, rows["u4"].ROA) == (0.5, None, "High", None)
    assert S.sector_layouts(spark, str(folder)).count() == 2
