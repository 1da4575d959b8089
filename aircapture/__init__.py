"""Radio-packet capture analytics on Spark: decode, deduplicate, infer flows, aggregate."""

__version__ = "0.1.0"
