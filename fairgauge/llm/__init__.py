"""Operators for preparing language-model training data (packing, mixing, sharding, PII, near-duplicates,
quality, suffix dedup, LM scoring, ordinal classifier, embedding near-duplicates, phrases, byte-level BPE,
conversation tries). Nothing else in the
library imports this package; ``queries`` registers its queries.

Functions that run in tasks are shipped by value, so workers need no copy of the repository."""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
