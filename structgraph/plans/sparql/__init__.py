"""SPARQL over the quad table: parser, and compiler to DataFrames."""

from structgraph.plans.sparql.compile import query
from structgraph.plans.sparql.update import update

__all__ = ["query", "update"]
