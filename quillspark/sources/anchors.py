"""Links of a page as a table function, to be called laterally from SQL or a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .tree import Tree


@udtf
class Anchors:
    """anchors(html, base, with_text): n (from 0), href resolved against base, and the link's text if with_text is true."""

    @staticmethod
    def analyze(html: AnalyzeArgument, base: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, a in (("html", html), ("base", base)):
            if not isinstance(a.dataType, StringType):
                raise ValueError(f"{name} has to be a string")
        schema = StructType().add("n", IntegerType()).add("href", StringType())
        if with_text is not None:
            if not isinstance(with_text.dataType, BooleanType) or not with_text.isConstantExpression:
                raise ValueError("with_text has to be true or false")
            if with_text.value:
                schema.add("text", StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str | None, base: str | None, with_text: bool = False) -> Iterator[tuple]:
        for n, (href, text, _) in enumerate(Tree(html).anchors()):
            full = urljoin(base or "", href)
            yield (n, full, text) if with_text else (n, full)


def register(spark: SparkSession, name: str = "anchors") -> None:
    """Make the function known to SQL: SELECT ... FROM pages, LATERAL anchors(html, url, true)."""
    spark.udtf.register(name, Anchors)
