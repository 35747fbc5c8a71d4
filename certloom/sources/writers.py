"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions.text import looks_like_measurement_row, placeholder_to_null, text


def instrument_table(catalog: DataFrame) -> DataFrame:
    """Rows of the instrument table with a combined certificate column; headings dropped."""
    certificate = F.concat_ws(" ", placeholder_to_null("certificate_no"), placeholder_to_null("valid_date"))
    cells = {k: placeholder_to_null(k) for k in vocab.CATALOG_KEYS}
    keep = looks_like_measurement_row(
        cells["name"], cells["model"], cells["code"], cells["measurement_range"], cells["uncertainty"], certificate,
        cells["traceability_institution"])
    names = ["name", "model", "code", "measurement_range", "uncertainty", "traceability_institution"]
    return catalog.where(keep).select(*[c for c in catalog.columns if c not in vocab.CATALOG_KEYS], *[
        text(cells[k]).alias(k) for k in names], certificate.alias("certificate"))


_TSV = ["name", "model", "code", "measurement_range", "uncertainty", "certificate", "traceability_institution"]


def tsv_line() -> Column:
    """One row of the instrument table as a tab-separated line."""
    return F.concat_ws("\t", *_TSV)


def write_tsv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Instrument table as TSV files with a header line each."""
    renamed = table.select(*[F.col(c).alias(h) for c, h in zip(_TSV, vocab.INSTRUMENT_TABLE_HEADER)])
    renamed.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_rendered(outputs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rendered texts by template; records with errors are not written."""
    outputs.where(F.col("error").isNull()).select("template_name", "output_name", "output").write.mode(
        mode).partitionBy("template_name").parquet(path)


def write_version(table: DataFrame, path: str, version: int) -> str:
    """A table written as a new version next to the earlier ones."""
    target = f"{path.rstrip('/')}/version={version}"
    table.write.mode("errorifexists").parquet(target)
    return target
