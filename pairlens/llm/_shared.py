"""What the operators share: ids and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import mark, release, shared_dir, stored, unused

__all__ = ["LAST_ID", "id_order", "joined_spread", "mark", "release", "shared_dir", "stored", "unused"]

#: Stands for a null id inside an operator: such rows come after all others.
LAST_ID = (1 << 63) - 1
#: A key of more than this part of all rows is hot; there are fewer than 1 / HOT of them.
HOT = 1e-3


def id_order(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def joined_spread(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to the one row that facts has for a key; `count` says how many rows the key has. Hot keys, at most 1 / HOT
    of them whatever the input, are joined by broadcast, where their rows are; all others by a shuffle."""
    facts = stored(facts, "facts")
    total, most = facts.agg(F.sum(count), F.max(count)).first()
    least = (total or 0) * HOT
    if (most or 0) <= least:
        return rows.join(facts, key)
    hot = F.broadcast(facts.filter(F.col(count) > least))
    cold = rows.join(F.broadcast(facts.filter(F.col(count) > least).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(facts.filter(F.col(count) <= least), key))
