"""Whether two Boolean expressions over a response agree, on mock responses made from their own literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanthorn.functions import expr


def mocks(body: list[str], header: list[str], status: int = 200) -> list[tuple[str, int, str, str]]:
    """(name, status_code, body, all_headers): all literals, then each thing wrong or missing, then each literal alone."""
    b, h = " ".join(body), "\n".join(f"x-{i}: {x}" for i, x in enumerate(header))
    drop = lambda xs, i: [x for k, x in enumerate(xs) if k != i]
    out = [("positive", status, b, h), ("wrong_status", 500, b, h), ("empty_body", status, "", h), ("missing_headers", status, b, "")]
    out += [(f"drop_body[{i}]", status, " ".join(drop(body, i)), h) for i in range(len(body))]
    out += [(f"drop_hdr[{i}]", status, b, "\n".join(drop(header, i))) for i in range(len(header))]
    out += [(f"solo_body[{i}]", status, x, "") for i, x in enumerate(body)]
    return out + [(f"solo_hdr[{i}]", status, "", x) for i, x in enumerate(header)]


def compare(spark: SparkSession, left: str, right: str, body: list[str], header: list[str]) -> DataFrame:
    """(mock, left_match, right_match, same) of two expressions; both see status_code, body and all_headers."""
    rows = spark.createDataFrame(mocks(body, header), "mock string, status_code int, body string, all_headers string")
    side = lambda text: F.coalesce(expr.to_column(expr.parse(text), F.col), F.lit(False))
    out = rows.select("mock", side(left).alias("left_match"), side(right).alias("right_match"))
    return out.withColumn("same", F.col("left_match") == F.col("right_match"))


def report(compared: DataFrame) -> DataFrame:
    """total, passed, failed and whether all agree."""
    return compared.agg(
        F.count("*").alias("total"), F.count_if("same").alias("passed"), F.count_if(~F.col("same")).alias("failed"), F.bool_and("same").alias("consistent")
    )
