"""plumbline: dataset audits and training-data operators on Spark."""

NAME = "plumbline"
VERSION = __version__ = "0.1.0"
