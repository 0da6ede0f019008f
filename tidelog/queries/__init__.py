from .registry import QUERIES, SQL
from . import control, deliver, encode, logs, ordering, snapshot, types  # noqa: F401

__all__ = ["QUERIES", "SQL"]
