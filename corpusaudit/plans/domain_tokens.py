"""Domain token counts of a corpus, from its own record layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import urls
from corpusaudit.operators import domains


def _optional(df: DataFrame, path: str):
    """A nested field when the schema has it, else NULL."""
    node = df.schema
    for part in path.split("."):
        names = getattr(node, "names", [])
        if part not in names:
            return F.lit(None).cast("string")
        node = node[part].dataType
    return F.col(path)


def count_plain(pages: DataFrame, url: str = "url", body: str = "text") -> DataFrame:
    """Layouts that give a URL and a text per record."""
    return domains.domain_tokens(pages.select(url, body), F.col(body), urls.netloc(F.col(url)))


def count_with_metadata(records: DataFrame) -> DataFrame:
    """Layouts with a metadata struct: declared domain, forum, URL or source name, in that order."""
    domain = urls.corpus_domain(
        _optional(records, "metadata.source_domain"),
        _optional(records, "metadata.subreddit"),
        _optional(records, "metadata.url"),
        F.col("source"),
    )
    return domains.domain_tokens(records, F.col("text"), domain)
