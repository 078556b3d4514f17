"""tagsift: Spark-native operators for dictionary-tagged text corpora.

Corpus and match preparation, context windows, class-probability evidence,
block / allow list building, evaluation metrics, featurisation, QA window
operators and streaming variants, each a function DataFrame(s) -> DataFrame.
"""

__version__ = "0.1.0"
