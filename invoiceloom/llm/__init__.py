"""Operators on text corpora, embeddings, web pages and conversations for training data."""
