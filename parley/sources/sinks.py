"""What runs leave behind: JSON documents of rows, texts with headers, and the parameters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(rows: DataFrame, columns: tuple[str, ...] = ("speaker", "start", "end", "text"), order: tuple[str, ...] = ("idx",), key: str = "recording", pretty: bool = True) -> DataFrame:
    """recording, json: one array document of each recording's rows, in order, letters unescaped, nulls written, indented or not. A recording's rows meet in one row, as the document does."""
    keyed = F.struct(F.struct(*order).alias("at"), F.struct(*columns).alias("row"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(keyed)).alias("all")).select(key, F.to_json(F.transform("all", lambda x: x["row"]), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, folder: str, suffix: str = "_diarization_asr.json", key: str = "recording", **how) -> None:
    """Writes each recording's document as text under folder/<key>=<recording><suffix>/."""
    found = json_documents(rows, key=key, **how).select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("document"), "json")
    found.write.mode("overwrite").partitionBy("document").text(folder)


def titled(documents: DataFrame, title: str, key: str = "recording") -> DataFrame:
    """recording, text: a header line and the document."""
    return documents.select(key, F.concat(F.lit(f"\n--- {title} ---\n"), F.col("json")).alias("text"))


def run_parameters(spark: SparkSession, run: str, parameters: dict[str, object]) -> DataFrame:
    """run, name, value, written (UTC) of one run's parameters, a row each, to be appended to a table of runs."""
    rows = [(run, name, None if value is None else str(value)) for name, value in sorted(parameters.items())]
    return spark.createDataFrame(rows, "run string, name string, value string").withColumn("written", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
