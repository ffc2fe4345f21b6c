"""Full-text search over page tables and page streams, as PySpark DataFrames.

Pages are indexed into four tables (documents, postings, document frequencies,
corpus statistics); whole tables of queries are then ranked with BM25, the best
candidates are reordered by a pluggable reranker, and the top k are returned.
"""

from pagelode.operators.index import SearchIndex, build_index, term_stats
from pagelode.operators.rerank import cosine_rerank
from pagelode.operators.store import expire_versions, extend_index, open_index, write_index
from pagelode.plans.search import search, search_many, search_with_order
from pagelode.sources.messages import (
    decode_messages,
    encode_messages,
    file_messages,
    kafka_messages,
    publish,
    publish_stream,
)
from pagelode.sources.pages import as_pages, as_queries
from pagelode.streaming.counters import count_stream, read_counters
from pagelode.streaming.indexing import index_stream, keep_running, refresh_index

__all__ = [
    "SearchIndex",
    "as_pages",
    "as_queries",
    "build_index",
    "cosine_rerank",
    "count_stream",
    "decode_messages",
    "encode_messages",
    "expire_versions",
    "extend_index",
    "file_messages",
    "index_stream",
    "kafka_messages",
    "keep_running",
    "open_index",
    "publish",
    "publish_stream",
    "read_counters",
    "refresh_index",
    "search",
    "search_many",
    "search_with_order",
    "term_stats",
    "write_index",
]
