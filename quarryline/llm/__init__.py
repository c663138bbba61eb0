"""Training-data operators: tokenising, archives, near copies, search, extraction,
quality, mixing, repeated spans, language-model scores and chat rendering.

Nothing else in the library imports this subpackage.
"""
