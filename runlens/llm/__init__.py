"""Training-data operators: ten large-scale corpus operations and their queries.

Nothing outside this subpackage imports it; ``queries.py`` registers the
``opN_*`` queries and ``corpus_pipeline.py`` at the repository top chains five of
the operators.
"""
