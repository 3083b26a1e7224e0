"""Query registry: id -> Spark callable ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

QUERIES: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco
