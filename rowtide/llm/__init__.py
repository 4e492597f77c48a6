"""Operators that prepare training data, and their queries in ``CATALOG``."""

from rowtide.llm import (
    chat, conversation_repair, conversation_trie, html_text, jaccard_join, merkle, packing, quality_classifier, quality_rules, sentencepieces, sharding, token_counts, top_products,
)
from rowtide.llm.catalog import CATALOG

__all__ = [
    "CATALOG", "chat", "conversation_repair", "conversation_trie", "html_text", "jaccard_join", "merkle", "packing", "quality_classifier", "quality_rules", "sentencepieces", "sharding",
    "token_counts", "top_products",
]
