"""Operators for large training-data pipelines (documents, pages, vectors, chats)."""
