"""Feature blocks: named stages of SQL expressions, resolved by the columns they need before one plan is built.

A block is a function from a dialect to stages; a stage maps new columns to expressions over earlier ones. Columns whose
name begins with an underscore are working columns and end with the block. All stages of all blocks over one panel share
its partitioning by entity, so Spark exchanges and sorts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.dialect import Dialect, DuckDialect, SparkDialect

Stages = list[dict[str, str]]
REGISTRY: dict[str, Block] = {}


@dataclass(frozen=True)
class Block:
    name: str
    requires: tuple[str, ...]
    stages: Callable[[Dialect], Stages]
    produces: tuple[str, ...] = field(default=())
    #: Whether a value may depend on later rows of its entity.
    looks_ahead: bool = False


def block(*requires: str, looks_ahead: bool = False):
    """Register the function as a block that needs ``requires``; what it produces is read off its stages."""

    def made(fn: Callable[[Dialect], Stages]) -> Block:
        out = tuple(c for stage in fn(SparkDialect()) for c in stage if not c.startswith("_"))
        b = Block(fn.__name__, requires, fn, out, looks_ahead)
        REGISTRY[b.name] = b
        return b

    return made


def ordered(blocks: list[Block], have: set[str]) -> list[Block]:
    """The blocks in an order in which each finds what it needs (the first producer of a column counts); blocks whose
    needs nobody produces are an error that names them."""
    left, done, known = list(blocks), [], set(have)
    while left:
        ready = [b for b in left if set(b.requires) <= known]
        if not ready:
            raise ValueError("; ".join(f"{b.name} lacks {sorted(set(b.requires) - known)}" for b in left))
        for b in ready:
            known |= set(b.produces)
            done.append(b)
            left.remove(b)
    return done


def apply(df: DataFrame, *blocks: Block, dialect: Dialect | None = None) -> DataFrame:
    """``df`` with the columns of ``blocks``. A column that is there already is replaced; working columns are dropped."""
    q = dialect or SparkDialect()
    for b in ordered(list(blocks), set(df.columns)):
        work = []
        for stage in b.stages(q):
            df = df.withColumns({c: F.expr(e) for c, e in stage.items()})
            work += [c for c in stage if c.startswith("_")]
        df = df.drop(*work)
    return df


def as_sql(source: str, *blocks: Block, columns: list[str], have: set[str], dialect: Dialect | None = None) -> str:
    """The same in DuckDB's SQL, over the relation ``source``, with ``columns`` (SQL text) as the result."""
    q = dialect or DuckDialect()
    text = f"SELECT * FROM {source}"
    for b in ordered(list(blocks), have):
        work: list[str] = []
        for stage in b.stages(q):
            text = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM ({text})"
            work += [c for c in stage if c.startswith("_")]
        if work:
            text = f"SELECT * EXCLUDE ({', '.join(work)}) FROM ({text})"
    return f"SELECT {', '.join(columns)} FROM ({text})"
