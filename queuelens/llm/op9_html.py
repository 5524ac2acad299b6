"""Query op9: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import html
from queuelens.llm.common import table


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns page_id, url, text, n_chars for each page."""
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
