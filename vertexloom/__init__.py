"""Graph analytics on Spark DataFrames: levels, components, shortest paths, ranks and colourings."""

from .model import PropertyGraph

__all__ = ["PropertyGraph"]
