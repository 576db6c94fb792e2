"""Training-data operators: thirteen document-scale components and their registered queries.

Nothing else in the library imports this package.  ``catalogue`` holds the ``opN_<name>``
queries; ``corpus_pipeline.py`` at the repository top chains five of the operators.
"""
