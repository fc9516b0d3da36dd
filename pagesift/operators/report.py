"""Digest report: header row (count + date) and one HTML row per new record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_date, html_escape, ne, subject_date

# Digest columns and the placeholder for a missing value.
DIGEST_COLUMNS = ["title", "issuer", "deadline", "status", "source_site"]
MISSING = "—"


def digest_rows(records: DataFrame, keep=("fingerprint",)) -> DataFrame:
    """One row per record: the five digest cells (null/empty → '—', HTML
    escaped) and the table row markup."""
    cells = [F.coalesce(html_escape(ne(F.col(c))), F.lit(MISSING)).alias(c) for c in DIGEST_COLUMNS]
    out = records.select(*keep, *cells)
    row = F.concat(F.lit("<tr>"),
                   *[F.concat(F.lit("<td>"), F.col(c), F.lit("</td>")) for c in DIGEST_COLUMNS],
                   F.lit("</tr>"))
    return out.withColumn("row_html", row)


def digest_header(records: DataFrame, run_ts: Column) -> DataFrame:
    """One row: n_new, subject and heading; no row for an empty set."""
    n = records.agg(F.count(F.lit(1)).cast("long").alias("n_new"))
    return (n.where(F.col("n_new") > 0)
             .withColumn("subject", F.concat(F.lit("[Digest] "), F.col("n_new").cast("string"),
                                             F.lit(" new notice(s) — "), subject_date(run_ts)))
             .withColumn("heading", F.concat(F.lit("Notice digest — "), body_date(run_ts))))
