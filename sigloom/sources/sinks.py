"""Result formats: JSON envelopes and CSV text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json(envelopes: DataFrame, pretty: bool = True) -> DataFrame:
    """query_id, json: one envelope a row."""
    return envelopes.select("query_id", F.to_json(F.struct(*(c for c in envelopes.columns if c != "query_id")), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def _cell(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return value.cast("string")
    return F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_columns(hits: DataFrame) -> list[str]:
    return sorted(c for c in hits.columns if c not in ("query_id", "colour"))


def csv_lines(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, n, line: the query, then the hit's fields by name; text in quotes, numbers bare."""
    cols = csv_columns(hits)
    rows = hits.join(queries.select("query_id", "seq"), "query_id")
    cells = [_cell("seq", T.StringType()), *(F.coalesce(_cell(c, hits.schema[c].dataType), F.lit('""')) for c in cols)]
    return rows.select("query_id", F.struct((-F.col("num_kmers_found")).alias("a"), F.col("colour").alias("b")).alias("n"), F.concat_ws(",", *cells).alias("line"))


def csv_text(queries: DataFrame, hits: DataFrame, header: bool = True, carriage_return: bool = True) -> DataFrame:
    """query_id, csv of each query with hits: CRLF after every line; without carriage_return the last LF is dropped."""
    first = ",".join(f'"{c}"' for c in ["query", *csv_columns(hits)])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    every = F.concat(F.array(F.lit(first)), lines) if header else lines
    text = F.concat(F.array_join(every, "\r\n"), F.lit("\r\n" if carriage_return else "\r"))
    return csv_lines(queries, hits).groupBy("query_id").agg(text.alias("csv"))


def bulk_csv(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Lines of all queries without a header, in order."""
    return csv_lines(queries, hits).orderBy("query_id", "n").select("line")


def stream_rows(envelopes: DataFrame) -> Iterator[str]:
    """One JSON text a query, fetched partition by partition."""
    for row in to_json(envelopes.orderBy("query_id")).toLocalIterator():
        yield row["json"]
