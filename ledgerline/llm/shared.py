"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.folders import shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: its lineage ends there,
    so a lost executor costs a read and not the work before it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
