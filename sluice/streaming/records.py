"""Issues of records as they arrive. Dataset-level checks need whole partitions and stay with the batch gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import jsonv
from sluice.plans import rules


def record_issues(records: DataFrame) -> DataFrame:
    """(kind, json, message) of each issue of records (kind, json); works on batch and streaming DataFrames. A text that isn't strict JSON is one issue."""
    parsed = records.select("kind", "json", jsonv.strict(F.col("json")).alias("doc"))
    text = F.when(F.col("doc").isNotNull(), F.col("json"))
    deep = parsed.select("*", jsonv.deep_keys(text).alias("keys"), jsonv.deep_strings(text).alias("strings"))
    doc, keys, kind = F.col("doc"), F.col("keys"), F.col("kind")
    said = F.coalesce(rules.row_issues(kind, doc, keys), rules.document_issues(kind, doc, keys, F.col("strings"), F.lit(None).cast("string")))
    return deep.select("kind", "json", F.explode(F.when(doc.isNull(), F.array(F.lit("not strict JSON"))).otherwise(said)).alias("message"))
