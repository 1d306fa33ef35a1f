"""Retrieval analytics as DataFrame operators: loaders, chunkers, lexical and
vector search, fusion, entity graphs, incremental maintenance and evaluation."""
