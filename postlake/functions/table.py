"""Table functions for SQL: ``SELECT * FROM tokens(TABLE(documents))``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType


class Tokens:
    """doc_id, position, term of each index term of ``text``, by row; a null or empty text has none. Columns of the table that ``keep`` names (parted by commas) follow; others are not read."""

    @staticmethod
    def analyze(row: AnalyzeArgument, stemmed: AnalyzeArgument | None = None, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = keep.value.split(",") if keep and keep.value else []
        schema = StructType().add("doc_id", "long").add("position", "integer").add("term", "string")
        for x in names:
            schema = schema.add(row.dataType[x])
        return AnalyzeResult(schema)

    def eval(self, row: Row, stemmed: bool = True, keep: str | None = None) -> Iterator[tuple]:
        from postlake.operators.index import tokens

        kept = [row[x] for x in keep.split(",")] if keep else []
        for position, term in enumerate(tokens(row["text"], stemmed)):
            yield row["doc_id"], position, term, *kept


def register(spark: SparkSession) -> None:
    spark.udtf.register("tokens", udtf(Tokens))
