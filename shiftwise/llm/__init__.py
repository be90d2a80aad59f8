"""Operations of a training-data pipeline over text, pages, conversations and vectors.

Nothing else in the library imports this subpackage; ``queries`` registers its
driver queries.
"""
