"""Evidence-graph analytics on Spark: claims, identity, projections and reads as DataFrame operators."""

__version__ = "0.1.0"
