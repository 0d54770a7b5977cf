"""Operations for preparing large training corpora.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
