"""topicscope: social-trend and sentiment analytics as Spark DataFrame plans.

The most used entry points, re-exported; see the subpackages for the rest:
``functions`` (column expressions), ``operators`` (filters, aggregates,
top-k, sentiment, upsert), ``sources`` (normalisers, decode, connectors),
``plans`` (composite queries and jobs) and ``streaming``.
"""

from .functions.stopwords import stopwords
from .functions.text import bigrams, hashtags, keywords, split_terms, strip_urls, topics, with_topics
from .operators.sentiment import read_lexicon, score_sentiment, sentiment_label
from .operators.upsert import dedup_posts, merge_into_table, upsert_posts
from .plans.explore import digest, latest_posts, search_posts, sources
from .plans.ingest import ingest
from .plans.sentiment_trends import (post_sentiment, run_summary, sentiment_extremes,
                                     sentiment_trends, term_sentiment, topic_sentiment)
from .plans.trending import all_topics, keyword_counts, trending
from .sources.decode import decode_posts, encode_posts, validate_posts
from .sources.feeds import normalize_bluesky, normalize_hackernews, normalize_reddit
from .streaming.ingest import stream_upsert
from .streaming.trends import bucket_trending, stream_trends

__all__ = [
    "stopwords", "bigrams", "hashtags", "keywords", "split_terms", "strip_urls", "topics",
    "with_topics", "read_lexicon", "score_sentiment", "sentiment_label", "dedup_posts",
    "merge_into_table", "upsert_posts", "digest", "latest_posts", "search_posts", "sources",
    "ingest", "post_sentiment", "run_summary", "sentiment_extremes", "sentiment_trends",
    "term_sentiment", "topic_sentiment", "all_topics", "keyword_counts", "trending",
    "decode_posts", "encode_posts", "validate_posts", "normalize_bluesky",
    "normalize_hackernews", "normalize_reddit", "stream_upsert", "bucket_trending",
    "stream_trends",
]
