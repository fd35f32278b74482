"""Table functions for SQL: structural chunks, page sections and code symbols of one text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loreweave.operators import chunk, code, lineage


@udtf(returnType="seq int, heading string, chunk_text string")
class ChunkStructural:
    def eval(self, text: str):
        for i, (heading, body) in enumerate(chunk.structural(text)):
            yield i, heading, body


@udtf(returnType="section int, heading string, body string")
class WikiSections:
    def eval(self, markdown: str):
        for i, (heading, body) in enumerate(lineage.sections(markdown)):
            yield i, heading, body


@udtf(returnType="kind string, name string, line int")
class ExtractSymbols:
    def eval(self, text: str, lang: str):
        yield from code.symbols_of(text, lang)


def register(spark: SparkSession) -> None:
    """Make ``chunk_structural``, ``wiki_sections`` and ``extract_symbols`` callable in SQL."""
    spark.udtf.register("chunk_structural", ChunkStructural)
    spark.udtf.register("wiki_sections", WikiSections)
    spark.udtf.register("extract_symbols", ExtractSymbols)
