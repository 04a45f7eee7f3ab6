"""Every query of the engine: importing this module registers them."""

from __future__ import annotations

from functools import partial

from quire.operators import bags, chunking, evaluation, geometry, output, pairs, quality, routing, structure, structured, unicode, verify
from quire.sources import relations
from quire.streaming import pages

from .registry import QUERIES, SPARK_ONLY, duck, run

MODULES = (relations, quality, verify, bags, pairs, structure, structured, chunking, evaluation, routing, geometry, output, unicode, pages)


def queries() -> dict:
    return {name: partial(run, name) for name in QUERIES} | SPARK_ONLY


def oracle_sql() -> dict[str, str]:
    return {name: duck(name) for name in QUERIES}
