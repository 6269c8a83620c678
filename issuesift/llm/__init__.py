"""Operators of a large-scale training-data pipeline (mixing, filters,
classifiers, deduplication, search, packing, scoring). Nothing else in the
library imports this subpackage."""
