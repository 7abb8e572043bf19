"""Registered queries that run whole jobs: streams with restarts and replays, stored models, written and re-read files.

Each job works in a folder of its own below the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators import boosting, extraction as X, incremental as I, narrative as N
from ledgermill.operators import risk_model as rm
from ledgermill.plans import derived as D
from ledgermill.session import materialise, shared_folder
from ledgermill.sources import readers as S, writers
from ledgermill.streaming import jobs

#: Size of the trees in these jobs; every level is a Spark job.
SMALL = {"rounds": 2, "depth": 3, "rate": 0.3}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as files in two lots; the stream stops between them, goes on from its checkpoint and is started once more
    without new files. Items with a value."""
    folder = _folder(spark, "arriving")
    docs = D.filed_documents(spark, sf).select(
        "doc_id", F.concat(F.lit("/in/lap."), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    for lot in (F.pmod("doc_id", F.lit(3)) != 0, F.pmod("doc_id", F.lit(3)) == 0, None):
        if lot is not None:
            docs.where(lot).drop("doc_id").write.mode("append").parquet(f"{folder}/in")
        jobs.parse_arriving_documents(spark, f"{folder}/in", f"{folder}/items", f"{folder}/checkpoint", files_per_trigger=100,
                                      file_format="parquet").awaitTermination()
    return spark.read.parquet(f"{folder}/items").where("t IS NOT NULL OR t_minus_1 IS NOT NULL").select(
        "nama_file", "item", "t", "t_minus_1")


def model_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Continued trees over a stream: 1995 first, then a batch per year (1997 has unlabelled rows), then the last batch replayed as
    after a lost commit. The log with the number of trees of each version."""
    root = _folder(spark, "model")
    rows = materialise(D.order_risk_rows(spark, sf))
    jobs.start_model(rows.where("PeriodeTahun = 1995"), root, jobs.CONTINUED, **SMALL)
    for year in (1996, 1997, 1998):
        rows.where(F.col("PeriodeTahun") == year).write.mode("append").parquet(f"{root}/arrivals")
        jobs.update_model_on_arrival(spark.readStream.schema(rows.schema).parquet(f"{root}/arrivals"), root, f"{root}/checkpoint",
                                     jobs.CONTINUED, **SMALL).awaitTermination()
    jobs.offer_batch(rows.where("PeriodeTahun = 1998"), 2, root, jobs.CONTINUED, **SMALL)
    trees = spark.read.parquet(f"{root}/models/*/trees").select(F.regexp_extract("_metadata.file_path", "/v([0-9]+)/", 1).cast("bigint").alias("version"))
    return jobs.update_log(spark, root).join(trees.groupBy("version").agg(F.count(F.lit(1)).alias("trees")), "version")


def continued_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Batches offered to continued trees in one run, and the same ensemble built piece by piece through storage: per batch its status,
    its rows, the trees afterwards, and the rows that both ensembles predict differently."""
    folder = _folder(spark, "trees")
    rows = materialise(D.order_risk_rows(spark, sf))
    first = rows.where("PeriodeTahun = 1995")
    batches = [("new_year", rows.where("PeriodeTahun = 1996")), ("unlabelled", rows.where("PeriodeTahun = 1997")),
               ("one_class", rows.where((F.col("PeriodeTahun") == 1998) & (F.col(V.TARGET) == "Low"))), ("none", rows.where("PeriodeTahun = 1900")),
               ("last_year", rows.where("PeriodeTahun = 1998"))]
    whole, log = boosting.staged_training(first, batches, **SMALL)
    boosting.train(first, **SMALL).save(f"{folder}/0")
    for i, (_, batch) in enumerate(batches):
        model, _ = boosting.update(batch, boosting.BoostedModel.load(f"{folder}/{i}"), **SMALL)
        model.save(f"{folder}/{i + 1}")
    pieces = boosting.BoostedModel.load(f"{folder}/{len(batches)}")

    def told(model: boosting.BoostedModel, name: str) -> DataFrame:
        return boosting.predict(rows, model, ["UniqueID"]).select("UniqueID", F.struct("risk_category", F.map_entries("probabilities")).alias(name))
    differing = told(whole, "a").join(told(pieces, "b"), "UniqueID").agg(F.count_if(F.col("a") != F.col("b")).alias("differing"))
    table = spark.createDataFrame([(n, s, t) for n, s, t in log], "batch STRING, status STRING, trees BIGINT")     # a row per batch
    sizes = None
    for name, batch in batches:
        part = batch.agg(F.lit(name).alias("batch"), F.count(F.lit(1)).alias("rows"))
        sizes = part if sizes is None else sizes.unionByName(part)
    return table.join(sizes, "batch").select("*", F.lit(differing.first()[0]).cast("bigint").alias("differing"))


def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """A forest with its feature steps and labels, saved and loaded: per class of the stored model's predictions the rows, and those
    that the first model predicts differently (none)."""
    folder = _folder(spark, "stored")
    rows = materialise(D.order_risk_rows(spark, sf).where(F.col(V.TARGET).isNotNull()))
    model = rm.train(rows)
    model.save(folder)
    loaded = rm.RiskModel.load(folder)
    keep = ["UniqueID", V.TARGET]
    a = rm.predict(rows, model, keep).select("UniqueID", F.struct("risk_category", F.map_entries("probabilities")).alias("a"))
    b = rm.predict(rows, loaded, keep).select("UniqueID", F.struct("risk_category", F.map_entries("probabilities")).alias("b"))
    return a.join(b, "UniqueID").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differing"),
                                     F.lit(",".join(loaded.labels)).alias("labels"))


def _extraction_folders(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Extraction records of the orders, 1000 order numbers a file, as lists and as lines; of seven files one is cut off and one has a
    record without its second key."""
    folder = _folder(spark, "extractions")
    k = F.col("o_orderkey")
    found = F.create_map(F.lit(V.ASSETS), F.col("o_totalprice"), F.lit(V.GROSS_PROFIT), k.cast("double"))
    broken = F.pmod(F.floor(k / 1000), F.lit(7))
    record = F.to_json(F.struct(F.concat(F.lit("doc_"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("nama_file"),
                                F.when((broken != 5) | (F.pmod(k, F.lit(1000)) >= 100), found).alias("hasil_ekstraksi")))
    line = F.when((broken == 3) & (F.pmod(k, F.lit(1000)) < 100), F.expr("left(record, length(record) - 3)")).otherwise(F.col("record"))
    rows = D.table(spark, sf, "orders").select(
        k, F.lpad(F.floor(k / 1000).cast("string"), 9, "0").alias("file"), record.alias("record")).withColumn("line", line)
    rows.repartition("file").sortWithinPartitions("file", k).select("file", "line").write.partitionBy("file").text(f"{folder}/lines")
    lists = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(k, "line"))).alias("all"))        # 1000 rows at most
    lists.select("file", F.concat(F.lit("["), F.array_join(F.transform("all", lambda r: r["line"]), ","), F.lit("]")).alias("text")).write.partitionBy(
        "file").text(f"{folder}/lists")
    return f"{folder}/lists", f"{folder}/lines"


def extraction_records(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of every name, read back from the files that are whole; both forms of files."""
    parts = [I.first_records(S.extraction_files(spark, folder, lines)).select(
        F.lit(form).alias("form"), "nama_file", "records", F.try_element_at("hasil_ekstraksi", F.lit(V.ASSETS)).alias("assets"),
        F.try_element_at("hasil_ekstraksi", F.lit(V.GROSS_PROFIT)).alias("profit"))
        for folder, form, lines in zip(_extraction_folders(spark, sf), ("lists", "lines"), (False, True))]
    return parts[0].unionByName(parts[1])


def rejected_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files that give no records, and why."""
    parts = [S.rejected_extractions(spark, folder, lines).select(
        F.lit(form).alias("form"), F.regexp_extract("source", "file=([0-9]+)", 1).cast("bigint").alias("file"), "reason")
        for folder, form, lines in zip(_extraction_folders(spark, sf), ("lists", "lines"), (False, True))]
    return parts[0].unionByName(parts[1])


def truth_files(spark: SparkSession, sf: str) -> DataFrame:
    """A ground truth file per supplier, some malformed or without the key, read back."""
    folder, k = _folder(spark, "truth"), F.col("s_suppkey")
    data = F.create_map(F.lit(V.ASSETS), F.col("s_acctbal"), F.lit(V.EQUITY), F.lit(None).cast("double"))
    body = F.to_json(F.struct(data.alias("ground_truth_data")))
    text = F.when(F.pmod(k, F.lit(10)) == 4, F.expr("left(body, length(body) - 2)")).when(F.pmod(k, F.lit(10)) == 7, '{"lain": 1}').otherwise(F.col("body"))
    # one row group is one task, which would write all files; rows of one supplier stay together, as they share its file. Each task
    # moves its own files into place, not the driver all of them.
    rows = D.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    rows.select(k.alias("supplier"), k, body.alias("body")).select("supplier", text.alias("text")).write.partitionBy("supplier").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    truth = S.ground_truth(spark, folder, F.regexp_extract("source", "supplier=([0-9]+)", 1))
    return truth.select(F.col("stem").cast("bigint").alias("supplier"), F.try_element_at("truth", F.lit(V.ASSETS)).alias("assets"),
                        F.size("truth").cast("bigint").alias("items"))


def sector_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with features written as CSV in four layouts (other orders of columns, absent and foreign ones, a quoted comma), read back
    in one scan."""
    folder = _folder(spark, "sectors")
    rows = D.order_risk_rows(spark, sf).withColumn("NamaPerusahaan", F.concat(F.lit('PT "'), "UniqueID", F.lit('", Tbk')))
    layouts = [rows.columns, [*reversed(rows.columns)], ["UniqueID", "Asing", V.TARGET, "ROA"], ["NamaPerusahaan", "PeriodeTahun", "UniqueID"]]
    for i, names in enumerate(layouts):
        part = rows.where(F.pmod(F.col("UniqueID").cast("bigint"), F.lit(4)) == i).withColumn("Asing", F.lit("x,y"))
        part.select(*names).write.option("header", True).option("escape", '"').option("nullValue", "nan").csv(f"{folder}/{i}")
    return S.sector_csv(spark, f"{folder}/*").select(F.col("UniqueID").cast("bigint").alias("id"), "NamaPerusahaan", V.SECTOR, "PeriodeTahun",
                                                     "CurrentRatio", "ROA", V.TARGET)


def sector_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two sectors from 1996 on, of a table stored by sector and year, so that other folders are not read."""
    folder = _folder(spark, "slices")
    D.order_risk_rows(spark, sf).write.partitionBy(V.SECTOR, "PeriodeTahun").parquet(folder)
    return rm.slice_rows(spark.read.parquet(folder), list(V.SECTOR_FEATURES)[:2], first_year=1996).groupBy(V.SECTOR, "PeriodeTahun").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.col("UniqueID").cast("bigint")).alias("first"))


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the two parts of a split by hash, and the sums of their keys."""
    parts = [part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")) for name, part in zip(
        ("fitted", "held"), I.hash_split(D.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"))]
    return parts[0].unionByName(parts[1])


def sector_picks(spark: SparkSession, sf: str) -> DataFrame:
    """The order picked from each sector."""
    picked = I.one_per_group(D.order_risk_rows(spark, sf), V.SECTOR, "UniqueID")
    return picked.select(V.SECTOR, "UniqueID", "CurrentRatio")


def period_file_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Period records of a run that is written twice, read back by its manifest."""
    folder = _folder(spark, "periods")
    docs = X.two_value_extract(D.filed_documents(spark, sf)).select(
        F.col("doc_id").cast("string").alias("nama_file"),
        F.transform_values("items", lambda k, v: F.struct(v["val1"].alias("t"), v["val2"].alias("t_minus_1"))).alias("items"))
    for _ in range(2):
        writers.write_period_records(docs, folder, run="2024")
    return writers.read_runs(spark, folder).select("nama_file", "period_kind", F.size("hasil_ekstraksi").cast("bigint").alias("items"))


def risk_record_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Risk records of two runs, the first written twice; a third has failed before its manifest. Read back."""
    folder = _folder(spark, "risk")
    outlook = D.table(spark, sf, "region").select(F.col("r_name").alias("industry_main"), F.lit("Umum").alias("industry_sub"), F.lit("Rendah").alias("outlook"))
    texts = D.analyst_texts(spark, sf).withColumns({
        "industry_main": D.cycle(F.col("applicant_id"), ["ASIA", "EUROPE", "LAIN"]), "industry_sub": F.lit("Umum")})
    records = materialise(N.risk_records(texts, outlook))
    for run in ("a", "b", "a"):
        writers.write_risk_records(records, folder, run=run)
    records.withColumn("run_date", F.current_date()).write.partitionBy("run_date").json(f"{folder}/records/run=c/attempt=0")
    return writers.read_runs(spark, folder).select("run", "applicantName", "applicant_slug", "overallSentiment", "industrySectorOutlook")


QUERIES = {f.__name__: f for f in (
    arriving_items, model_updates, continued_trees, stored_model, extraction_records, rejected_files, truth_files, sector_files, sector_slices,
    split_sizes, sector_picks, period_file_sets, risk_record_runs)}
