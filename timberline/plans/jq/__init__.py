"""The jq language: parser, interpreter, compiler to Columns, completion."""

from .compiler import plan, predicate, where, with_matches, with_outputs
from .complete import complete
from .parser import JqError, parse

__all__ = ["JqError", "complete", "parse", "plan", "predicate", "where", "with_matches", "with_outputs"]
