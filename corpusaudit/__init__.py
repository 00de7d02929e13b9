"""License, dialog and crawl-consent analytics of machine-learning corpora on Spark DataFrames."""

from corpusaudit.session import build_session

__all__ = ["build_session"]
