"""Named relations and queries, each a builder of SQL text for a dialect; resolution into one statement.

A builder's text names other relations in braces, as in ``{page}``. ``statement`` collects what a query needs into
common table expressions, in order; driver tables stay as they are. Any relation can be replaced by a DataFrame.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import DUCK, SPARK, Spark

Builder = Callable[[Spark], str]
TABLES = frozenset(
    "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
)
RELATIONS: dict[str, Builder] = {}
QUERIES: dict[str, Builder] = {}
#: Queries whose result only Spark can state.
SPARK_ONLY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Relations that Spark builds as a DataFrame, in one pass over others, where SQL needs joins and groupings of tokens; a
#: builder gets a function from SQL text to a DataFrame, and may return None to leave it at the SQL. DuckDB reads the relation of that name.
BUILT: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}
_REF = re.compile(r"\{([a-z_]\w*)\}")


def relation(f: Builder) -> Builder:
    RELATIONS[f.__name__] = f
    return f


def query(f: Builder) -> Builder:
    QUERIES[f.__name__] = f
    return f


def built(f):
    BUILT[f.__name__] = f
    return f


def spark_query(f):
    SPARK_ONLY[f.__name__] = f
    return f


def statement(body: str, d: Spark, given: frozenset[str] = TABLES) -> str:
    """``body`` with a WITH clause for every relation it needs that isn't given."""
    made: dict[str, str] = {}

    def need(text: str) -> str:
        for name in _REF.findall(text):
            if name not in given and name not in made:
                inner = need(RELATIONS[name](d))
                made[name] = inner
        return _REF.sub(r"\1", text)

    text = need(body)
    with_ = ",\n".join(f"{k} AS ({v})" for k, v in made.items())
    return f"WITH {with_}\n{text}" if made else text


def _built_in(body: str, given: frozenset[str], declined: set[str]) -> list[str]:
    """The ``BUILT`` relations that ``body`` reads, but for those behind given ones or behind others of them."""
    found, seen, todo = [], set(given), [body]
    while todo:
        for name in _REF.findall(todo.pop()):
            if name not in seen:
                seen.add(name)
                if name in BUILT and name not in declined:
                    found.append(name)
                else:
                    todo.append(RELATIONS[name](SPARK))
    return found


def _load() -> None:
    """Registration happens on import of the catalogue, which imports this module."""
    importlib.import_module("quire.plans.catalogue")


def run(name: str, spark: SparkSession, sf_dir: str | None = None, **relations: DataFrame) -> DataFrame:
    """A query over the driver's tables in ``sf_dir``, or over the given relations in their place."""
    _load()
    return run_sql(QUERIES[name](SPARK), spark, sf_dir, **relations)


def run_sql(body: str, spark: SparkSession, sf_dir: str | None = None, **relations: DataFrame) -> DataFrame:
    _load()
    own, declined = dict(relations), set()
    while todo := _built_in(body, TABLES | frozenset(relations), declined):
        got = BUILT[todo[0]](lambda inner, **more: run_sql(inner, spark, sf_dir, **own, **more))
        if got is None:
            declined.add(todo[0])
        else:
            relations[todo[0]] = got
    text = statement(body, SPARK, TABLES | frozenset(relations))
    used = [t for t in sorted(TABLES | set(relations)) if re.search(rf"\b{t}\b", text)]
    frames = {
        t: relations[t] if t in relations else spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for t in used
        if t in relations or sf_dir is not None
    }
    # DataFrames are bound as arguments, so no view is left in the session
    for t in frames:
        text = re.sub(rf"(?<=FROM )\b{t}\b|(?<=JOIN )\b{t}\b", "{" + t + "} AS " + t, text)
        text = text.replace("{" + t + "} AS " + t + " AS ", "{" + t + "} AS ")
    parts = re.split(r"(\{(?:" + "|".join(map(re.escape, frames)) + r")\})", text) if frames else [text]
    body = "".join(p if p[1:-1] in frames and p.startswith("{") else p.replace("{", "{{").replace("}", "}}") for p in parts)
    return spark.sql(body, **frames)


def duck(name: str) -> str:
    return statement(QUERIES[name](DUCK), DUCK)
