"""Operations of a training-data pipeline: deduplication, cleaning, scoring, packing and archives.

Nothing else in the library imports this subpackage; ``marlspike.llm.queries`` lists its queries.
"""
