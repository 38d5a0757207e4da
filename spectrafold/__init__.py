"""Profiles of features counted by sample, and distances, metrics and sweeps over them, as Spark DataFrames.

The central relation is counts(sample, feature, c). K-mers of sequences are one source of it; columns of any table and
character n-grams of texts are others.
"""

from .config import Config

__all__ = ["Config"]
