"""Release data comparison, clean-up and drift analysis on PySpark DataFrames."""

from tidemark.session import checkpointed, get_session

__all__ = ["checkpointed", "get_session"]
