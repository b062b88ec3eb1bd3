"""Training-data operators: quality voting, sharding, fixity, deduplication, decontamination and tokens.

Nothing outside this package imports it; its queries are gathered in :mod:`geoaccord.llm.queries`.
"""
