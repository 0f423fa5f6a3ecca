"""Operators of a training-data pipeline (documents, pages, embeddings).

Nothing else in the library imports this subpackage.  One module per operator;
``queries`` holds the registered ``opN_<name>`` queries and their SQL.
"""
