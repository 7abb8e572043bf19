"""Writers for two-period results and risk records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill.functions.text import applicant_slug


def period_records(extracted: DataFrame, name_col: str = "nama_file") -> DataFrame:
    """nama_file, period_kind, hasil_ekstraksi: one record per input row and period that has values, and a record for t
    of every row with an error note (column `note`, optional). A projection of the row: documents of equal names keep
    their own records."""
    def record(kind: str, note: Column, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("period_kind"), values.alias("hasil_ekstraksi"), note.alias("note"))

    def values(name: str) -> Column:
        return F.transform_values(F.map_filter("items", lambda k, pair: pair[name].isNotNull()), lambda k, pair: pair[name])
    none = F.lit(None).cast("string")
    note = F.col("note") if "note" in extracted.columns else none
    candidates = F.array(record("t", none, values("t")), record("t-1", none, values("t_minus_1")),
                         record("t", note, F.lit(None).cast("map<string,double>")))
    kept = F.filter(candidates, lambda r: r["note"].isNotNull() | (F.size(r["hasil_ekstraksi"]) > 0))
    # outer: a plain inline makes the optimizer evaluate the map once more in a filter below it
    return extracted.select(F.col(name_col).alias("nama_file"), F.inline_outer(kept)).where(F.col("period_kind").isNotNull())


def write_run(table: DataFrame, path: str, run: str, partition_by: list[str], file_format: str = "json") -> None:
    """Write the rows of a run below `path`, so that repeating the run, after a failure or not, leaves one set.

    Every attempt has a folder of its own. The manifest of the run is written last and names the attempt that counts; an
    attempt that fails before is never read, and a repeated run replaces the line of the one before."""
    attempt = f"records/run={run}/attempt={uuid.uuid4().hex}"
    table.write.partitionBy(*partition_by).format(file_format).save(f"{path}/{attempt}")
    line = [(run, attempt, file_format, table.schema.json())]
    table.sparkSession.createDataFrame(line, "run STRING, folder STRING, format STRING, columns STRING").coalesce(1).write.mode(
        "overwrite").json(f"{path}/manifest/run={run}")


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """run and the columns of all complete runs below `path` (or of those named), by their manifests. Columns that a run did not
    have are null. A manifest has one line per run; a plan branch is made per format and set of columns, not per run."""
    lines = spark.read.schema("run STRING, folder STRING, format STRING, columns STRING").json(f"{path}/manifest")
    if runs is not None:
        lines = lines.where(F.col("run").isin(runs))
    layouts: dict[tuple[str, str], list[str]] = {}
    for line in lines.orderBy("run").collect():
        layouts.setdefault((line["format"], line["columns"]), []).append(f"{path}/{line['folder']}")
    out: DataFrame | None = None
    for (file_format, columns), folders in layouts.items():
        schema = T.StructType.fromJson(json.loads(columns))
        part = (spark.read.format(file_format).schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
                .option("basePath", f"{path}/records").load(folders).select("run", *schema.names))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], "run STRING") if out is None else out


def write_period_records(extracted: DataFrame, path: str, name_col: str = "nama_file", file_format: str = "json", run: str | None = None) -> None:
    """Two sets of files below `path`: period_kind=t and period_kind=t-1 (the latter only if it has records). They replace what is
    there; with a run they stand beside those of other runs (see `write_run`)."""
    records = period_records(extracted, name_col)
    if run is not None:
        write_run(records, path, run, ["period_kind"], file_format)
    else:
        records.write.mode("overwrite").partitionBy("period_kind").format(file_format).save(path)


def write_risk_records(records: DataFrame, path: str, per_applicant: bool = False, run: str | None = None) -> None:
    """Add records with their slug. By default they are partitioned by day; one folder per applicant only on demand, since it makes
    as many files as there are applicants. With a run, repeating it counts once (see `write_run`); without, rows are appended."""
    named = records.withColumns({"applicant_slug": applicant_slug(F.col("applicantName")),
                                 "run_date": F.to_date("lastUpdateTimestamp")})
    folder = "applicant_slug" if per_applicant else "run_date"
    if run is not None:
        write_run(named, path, run, [folder])
    else:
        named.write.mode("append").partitionBy(folder).json(path)
