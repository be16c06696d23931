"""The operators bound to the test tables, each with the SQL it is compared with."""

from . import q_frames, q_jobs, q_more, q_segments, q_streaming, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
