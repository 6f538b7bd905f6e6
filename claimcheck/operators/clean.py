"""Claim cleaning and label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.functions import text as tx


def clean_claims(claims: DataFrame) -> DataFrame:
    """Clean the three text columns; a context that says nothing becomes NULL."""
    cleaned = claims.withColumns(
        {name: tx.clean_text(F.col(name)) for name in ("context", "prompt_bn", "response_bn")}
    )
    out = cleaned.withColumn("context", tx.present(F.col("context"))).withColumn(
        "has_context", F.col("context").isNotNull()
    )
    if "label" in claims.columns:
        out = out.withColumn("label", F.col("label").cast("int"))
    return out


def context_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count("*").alias("n_rows"),
        F.count_if("has_context").alias("n_with_context"),
        F.count_if(~F.col("has_context")).alias("n_without_context"),
    )


def label_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    return (
        labelled.groupBy(F.col(label).cast("int").alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy("label")
    )
