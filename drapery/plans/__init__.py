"""Registered queries (one per SURVEY §2 operator id)."""


def all_queries() -> dict:
    from . import q_fabric, q_ops, q_pages, q_stream, q_text, q_v1  # noqa: F401  (registers on import)
    from .registry import QUERIES
    return QUERIES
