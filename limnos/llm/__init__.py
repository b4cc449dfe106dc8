"""Operators for preparing text corpora: deduplication, scanning, filtering,
scoring, packing and tokenising.

Every operator takes DataFrames with an id and a text column, keeps all work
that grows with the rows in Spark, and treats a null text as empty unless its
docstring says otherwise.  ``limnos.llm.queries`` applies each one to the whole
``documents`` table.
"""
