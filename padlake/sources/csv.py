"""Semicolon-separated tables with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: The columns of the banking tables.
SCHEMAS = {
    "account": "account_id LONG, district_id INT, frequency STRING, date INT",
    "trans": "trans_id LONG, account_id LONG, date INT, type STRING, operation STRING, amount DOUBLE, balance DOUBLE, k_symbol STRING, bank STRING, account DOUBLE",
    "order": "order_id LONG, account_id LONG, bank_to STRING, account_to LONG, amount DOUBLE, k_symbol STRING",
    "client": "client_id LONG, birth_number INT, district_id INT",
    "disp": "disp_id LONG, client_id LONG, account_id LONG, type STRING",
    "loan": "loan_id LONG, account_id LONG, date INT, amount LONG, duration INT, payments DOUBLE, status STRING",
    "card": "card_id LONG, disp_id LONG, type STRING, issued STRING",
}


class MissingTable(FileNotFoundError):
    """The path has no table."""


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The table at ``path``. With a schema nothing is read beforehand; without one the types are inferred by one pass more."""
    reader = spark.read.option("sep", ";").option("header", True).option("quote", '"')
    try:
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    except AnalysisException as e:
        raise MissingTable(path) from e


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as such a table, replacing what was there; nulls are empty fields."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("quote", '"').csv(path)


def load_keyed(spark: SparkSession, path: str, key: str, schema: str | T.StructType | None = None, where: dict[str, object] | None = None) -> DataFrame:
    """As read_csv, of rows that equal ``where`` and have a key, which becomes a long. Values that are 0 or empty count, and null equals nothing."""
    df = read_csv(spark, path, schema)
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    return df.dropna(subset=[key]).withColumn(key, F.col(key).cast("long"))
