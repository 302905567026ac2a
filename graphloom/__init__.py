"""Property graphs over Spark tables, queried with a Cypher subset that compiles to DataFrame operations."""

from graphloom.functions.scalar import register
from graphloom.operators.mutate import Editor
from graphloom.session import GraphSession, Outcome, Settings, create_session, execute_query
from graphloom.sources.catalog import AnalysisError, EdgeTable, GraphError, LexError, NodeTable, ParseError, PropertyGraph
from graphloom.sources.results import ResultSet

__all__ = ["AnalysisError", "EdgeTable", "Editor", "GraphError", "GraphSession", "LexError", "NodeTable", "Outcome", "ParseError", "PropertyGraph", "ResultSet", "Settings", "create_session", "execute_query", "register"]
