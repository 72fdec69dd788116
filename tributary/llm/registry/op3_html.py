"""Main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import table
from tributary.llm.html import main_text

NAME = "op3_html_main_text"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
