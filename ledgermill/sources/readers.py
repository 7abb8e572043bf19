"""Readers for extraction files, sector CSVs, outlook JSON, text and delimited documents, folders and ground truth.

Any path that Spark can read works (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.text import base_name, file_extension, file_stem, let

SECTOR_IDS = ["UniqueID STRING", "NamaPerusahaan STRING", "Sektor STRING", "PeriodeTahun INT", "PeriodeKuartal STRING"]
SECTOR_SCHEMA = ", ".join([*SECTOR_IDS, *[f"{f} DOUBLE" for f in V.NUMERIC_FEATURES],
                           "CreditRiskScore DOUBLE", "RiskCategory STRING"])

#: Why a file of records is rejected; in this order the later one is reported.
MISSING_KEY, UNREADABLE = "missing_key", "unreadable"


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("source"))


def _has_keys(record: Column) -> Column:
    return F.coalesce(F.map_contains_key(record, F.lit("nama_file")) & F.map_contains_key(record, F.lit("hasil_ekstraksi")), F.lit(False))


def _extraction(record: Column) -> list[Column]:
    return [F.try_element_at(record, F.lit("nama_file")).alias("nama_file"),
            F.from_json(F.try_element_at(record, F.lit("hasil_ekstraksi")), "MAP<STRING, DOUBLE>").alias("hasil_ekstraksi")]


def _extraction_bodies(spark: SparkSession, path: str) -> DataFrame:
    """source, records, reason (why the file gives no rows, or null) of JSON files with a list of records or one record."""
    body = F.when(F.rlike("text", F.lit(r"^\s*\{")), F.concat(F.lit("["), "text", F.lit("]"))).otherwise(F.col("text"))
    read = _whole_files(spark, path).select("source", F.from_json(body, "ARRAY<MAP<STRING, STRING>>").alias("records"))
    return read.withColumn("reason", F.when(F.col("records").isNull(), UNREADABLE).when(~F.forall("records", _has_keys), MISSING_KEY))


def _extraction_rows(spark: SparkSession, path: str) -> DataFrame:
    """source, pos (block and line number, in file order), record, reason of the lines of JSON Lines files; empty lines do not count."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value", F.struct(
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("pos"))
    parsed = lines.where(F.trim("value") != "").withColumn("record", F.from_json("value", "MAP<STRING, STRING>", {"mode": "PERMISSIVE"}))
    return parsed.select("source", "pos", "record", F.when(F.col("record").isNull(), UNREADABLE).when(~_has_keys(F.col("record")), MISSING_KEY).alias("reason"))


def extraction_files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, pos, nama_file, hasil_ekstraksi MAP<STRING, DOUBLE> of JSON files with a list of records or one record; with `lines`
    of files with a record per line, which may be of any size.

    A file with an unreadable text, or with a record that lacks one of the two keys, gives no rows at all. A file of lines is
    read in splits, so its validity is a property of the group of its lines: those of rejected files leave by an anti-join."""
    if lines:
        rows = _extraction_rows(spark, path)
        kept = rows.join(rows.where("reason IS NOT NULL").select("source").distinct(), "source", "left_anti")
        return kept.select("source", "pos", *_extraction(F.col("record")))
    rows = _extraction_bodies(spark, path).where("reason IS NULL").select("source", F.posexplode("records").alias("pos", "record"))
    return rows.select("source", "pos", *_extraction(F.col("record")))


def rejected_extractions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """source, reason of the files that `extraction_files` leaves out; an unreadable record outweighs one without a key."""
    rows = _extraction_rows(spark, path) if lines else _extraction_bodies(spark, path)
    return rows.where("reason IS NOT NULL").groupBy("source").agg(F.max("reason").alias("reason"))


def sector_layouts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """header, paths: the CSV files of a folder (or of a list of paths) by their first line; one pass over the first splits."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    first = lines.withColumn("pos", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "pos").alias("header"))
    return first.groupBy("header").agg(F.array_sort(F.collect_list("file_path")).alias("paths"))


def _sector_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, first, names) per file and (file, at, value) per line, from the same scan; `first` is the place of the header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.struct(
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("at")).where("value <> ''")
    headers = lines.groupBy("file").agg(F.min("at").alias("first"), F.min_by("value", "at").alias("header"))
    return headers.select("file", "first", csv_cells(F.regexp_replace("header", "^\ufeff", "")).alias("names")), lines


def _sector_columns(headers: DataFrame, lines: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of all lines as text, null where a file has none, and for empty cells and 'nan'. A file's columns are
    found by position: its header is joined to its lines, so one plan serves any number of headers."""
    places = headers.select("file", "first", F.array(*[F.array_position("names", n).cast("int") for n in names]).alias("places"))
    rows = lines.join(places, "file").where(F.col("at") != F.col("first")).select(csv_cells(F.col("value")).alias("cells"), "places")

    def cell(i: int) -> Column:
        value = F.when(F.col("places")[i] > 0, F.get("cells", F.col("places")[i] - 1))
        return F.when(~value.isin("", "nan"), value)
    return rows.select(*[cell(i).alias(n) for i, n in enumerate(names)])


def sector_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sector feature files with any headers, stacked by column name under one schema; absent columns are null, others are left out.

    One scan, and one plan for any number of headers and files. No file is dropped: one that has none of the columns gives
    rows of nulls. Of columns with the same name the first counts. An absent path is an error."""
    fields = [part.rsplit(" ", 1) for part in SECTOR_SCHEMA.split(", ")]
    stacked = _sector_columns(*_sector_lines(spark, path), [n for n, _ in fields])
    return stacked.select(*[F.col(n).try_cast(t).alias(n) for n, t in fields])


def sector_csv_by_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with differing headers stacked by column name, with all their columns; numeric features that no file has are added as
    null. Only the distinct column names reach the driver."""
    if not paths:
        return spark.createDataFrame([], SECTOR_SCHEMA)
    headers, lines = _sector_lines(spark, paths)
    found = headers.select(F.posexplode("names").alias("pos", "name")).groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").collect()
    out = _sector_columns(headers, lines, [r["name"] for r in found])
    numeric = [*V.NUMERIC_FEATURES, "CreditRiskScore"]
    typed = {n: (F.col(n).try_cast("double") if n in out.columns else F.lit(None).cast("double")) for n in numeric}
    if "PeriodeTahun" in out.columns:
        typed["PeriodeTahun"] = F.col("PeriodeTahun").try_cast("int")
    return out.withColumns(typed)


def outlook_json(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame | None:
    """industry_main, industry_sub, outlook of a nested JSON file; the fallback path is used if the first cannot be
    read. None if no path is readable."""
    schema = "risiko_industri MAP<STRING, MAP<STRING, STRING>>"
    for candidate in (path, fallback):
        if candidate is None:
            continue
        try:
            table = spark.read.schema(schema).option("multiLine", True).json(candidate)
        except Exception as failure:                    # path is missing or not accessible
            if "PATH_NOT_FOUND" not in str(failure) and "FileSystem" not in str(failure):
                raise
            continue
        return (table.select(F.explode("risiko_industri").alias("industry_main", "subs"))
                .select("industry_main", F.explode("subs").alias("industry_sub", "outlook")))
    return None


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path, text."""
    return _whole_files(spark, path).select(F.col("source").alias("path"), "text")


_CLOSED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_CLOSED}[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'
_RECORD = f"{_FIELD}(?:,{_FIELD})*+"
_OPEN_QUOTE = r'^"[^"]*+(?:""[^"]*+)*+$'


def csv_cells(record: Column) -> Column:
    """The cells of a comma-separated record, without their quotes; a doubled quote stands for one."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f"(?:,)({_FIELD})"), F.lit(1))
    return F.transform(fields, lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(
        F.regexp_replace(f, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(f))


def delimited_text(content: Column) -> Column:
    """Text of a header-less comma-separated file: cells joined by tabs, rows by line feeds, empty cells as 'nan'.

    A quote at the start of a cell opens it up to the closing quote, line breaks and commas included; elsewhere it is a
    character. Empty lines are left out and short rows filled up; a row longer than the first, or a quote that is never
    closed, makes the file an error text."""
    # a record is searched where the one before ended, so breaks inside quotes never begin one; an open quote stays over
    records = F.filter(F.regexp_extract_all(content, F.lit(f'(?!{_CLOSED})"(?s:.*)|{_RECORD}'), F.lit(0)), lambda r: r != "")
    unclosed = F.exists(records, lambda r: F.rlike(r, F.lit(_OPEN_QUOTE)))

    def build(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        too_wide = F.exists(rows, lambda r: F.size(r) > width)

        def print_row(r: Column) -> Column:
            shown = F.transform(r, lambda f: F.when(f == "", F.lit("nan")).otherwise(f))
            return F.array_join(F.concat(shown, F.array_repeat(F.lit("nan"), width - F.size(r))), "\t")
        return (F.when(F.size(rows) == 0, F.lit("Error CSV: Berkas kosong"))
                .when(unclosed, F.lit("Error CSV: tanda kutip tidak ditutup"))
                .when(too_wide, F.lit("Error CSV: jumlah kolom tidak sama"))
                .otherwise(F.array_join(F.transform(rows, print_row), "\n")))
    return let(F.transform(records, csv_cells), build)


def delimited_documents(spark: SparkSession, path: str) -> DataFrame:
    return text_documents(spark, path).withColumn("text", delimited_text(F.col("text")))


def scan_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length, modificationTime, nama_file, file_type of the supported files; one marker row if there are none.
    Only metadata is read: the content column is pruned from the scan."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
             .select("path", "length", "modificationTime"))
    named = files.withColumns({"nama_file": base_name(F.col("path")), "info": F.lit(None).cast("string")})
    named = named.withColumn("file_type", file_extension(F.col("nama_file")))
    supported = named.where(F.col("file_type").isin(V.SUPPORTED_EXTENSIONS))
    message = f"Tidak ada dokumen dengan ekstensi yang didukung ditemukan di {path}"
    marker = supported.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"), F.lit("TIDAK_ADA_FILE").alias("nama_file"),
        F.lit(message).alias("info"), F.lit(None).cast("string").alias("file_type"))
    return supported.unionByName(marker)


def ground_truth(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """stem, truth MAP<STRING, DOUBLE>; files that are malformed or lack the key give no row. `name` may say how a file is called,
    from its `source`; by default it is the file name without its extension."""
    files = _whole_files(spark, path)
    body = F.from_json("text", "STRUCT<ground_truth_data: MAP<STRING, DOUBLE>>")
    stem = file_stem(base_name(F.col("source"))) if name is None else name
    return files.select(stem.alias("stem"), body["ground_truth_data"].alias("truth")).where(F.col("truth").isNotNull())
