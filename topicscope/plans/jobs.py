"""Table-writing jobs of the batch pipeline (C-2, C-3 with O-16/O-17, O-34).

The reference scores every post in a row-wise UDF and then recomputes the
scores for each later action.  Here the scored posts are written once (the
write also cuts the lineage, so a lost executor recomputes from the written
table, not from the raw scan) and both derived results read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import POST_SENTIMENT, SENTIMENT_TABLE
from ..sources.connectors import read_or_empty, replace_table
from .sentiment_trends import post_sentiment, run_summary, term_sentiment, topic_sentiment


def sentiment_job(spark: SparkSession, posts: DataFrame, lexicon: DataFrame, out_base: str,
                  limit: int = 40) -> DataFrame:
    """C-2 + O-34: replace ``post_sentiment`` and ``term_sentiment`` and return
    the one-row run summary."""
    scored = read_or_empty(spark, replace_table(post_sentiment(posts, lexicon), f"{out_base}/post_sentiment"), POST_SENTIMENT)
    terms = read_or_empty(spark, replace_table(term_sentiment(scored, limit), f"{out_base}/term_sentiment"), SENTIMENT_TABLE)
    return run_summary(scored, terms)


def topic_sentiment_job(spark: SparkSession, posts: DataFrame, lexicon: DataFrame, out_base: str,
                        as_of=None, days: int = 7, min_count: int = 2, limit: int = 40) -> str:
    """C-3 + O-17: replace the ``topic_sentiment`` table; returns its path."""
    table = topic_sentiment(posts, lexicon, as_of, days, min_count, limit)
    return replace_table(table, f"{out_base}/topic_sentiment")
