"""Sector outlook look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill import fixed_values as V


def sector_outlook(applicants: DataFrame, outlook: DataFrame | None, load_error: str | None = None) -> DataFrame:
    """Add `outlook` by (industry_main, industry_sub); an empty text counts as not given.

    No broadcast is forced: Spark compares the table with its broadcast limit and sorts and merges beyond it.
    `outlook` of None means that the table is absent or empty. Of repeated entries the one of largest `pos` counts, or,
    without that column, the last label in text order; an applicant never doubles.
    """
    if load_error is not None:
        return applicants.withColumn("outlook", F.lit(f"Gagal memuat data risiko: {load_error}"))
    if outlook is None:
        return applicants.withColumn("outlook", F.lit("Data risiko industri tidak ditemukan atau kosong."))
    main, sub = F.nullif("industry_main", F.lit("")), F.nullif("industry_sub", F.lit(""))
    keyed = applicants.withColumns({"_main": main, "_sub": sub})
    latest = "pos" if "pos" in outlook.columns else "outlook"
    rows = outlook.groupBy(F.col("industry_main").alias("_main"), F.col("industry_sub").alias("_sub")).agg(
        F.max_by("outlook", latest).alias("_label"))
    both = F.col("_main").isNotNull() & F.col("_sub").isNotNull()
    text = (F.when(both, F.coalesce(F.col("_label"), F.lit(V.UNKNOWN_OUTLOOK)))
            .when(F.col("_main").isNotNull(), F.concat(
                F.lit("Sub-industri tidak disediakan untuk industri utama: "), F.col("_main"), F.lit(".")))
            .otherwise(F.lit("Informasi industri tidak disediakan.")))
    return keyed.join(rows, ["_main", "_sub"], "left").select(*applicants.columns, text.alias("outlook"))
