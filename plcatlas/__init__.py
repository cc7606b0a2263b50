"""Code-graph analytics for Structured Text corpora, written as Spark jobs."""

from plcatlas.graph import Graph

__all__ = ["Graph"]
