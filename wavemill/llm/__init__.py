"""Operators of a training-data pipeline over documents and embeddings.

Nothing outside this subpackage imports it. Each module holds one operator with its general interface;
``queries`` derives the registered digest columns from them.
"""
