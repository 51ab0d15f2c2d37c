"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def _to_roots(hooks: DataFrame) -> DataFrame:
    """hooks (v, to), to < v, with ``to`` the last that is reached; each step doubles how far a hook goes."""
    while True:
        onward = hooks.select(F.col("v").alias("to"), F.col("to").alias("further"))
        jumped = save(hooks.join(onward, "to", "left").select("v", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks")
        release(hooks)
        hooks = jumped
        if hooks.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(v, component) of the vertices of links (a, b) that aren't the smallest of their component.

    Each round hooks every vertex to its smallest neighbour below it, lets hooks jump until
    all name a root, and contracts the links; what is left of them shrinks until none is left.
    A chain of n links, in whatever order, takes about log n steps.  Rounds are written to
    the shared folder, joins are plain equi-joins of stored tables, so a vertex with
    very many links is split by adaptive execution.
    """
    left = save(_oriented(links), "links")
    found: DataFrame | None = None
    while not left.isEmpty():
        hooks = _to_roots(save(left.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("to")), "hooks"))
        high = hooks.select(F.col("v").alias("hi"), F.col("to").alias("a"))
        low = hooks.select(F.col("v").alias("lo"), F.col("to").alias("b"))
        moved = left.join(high, "hi").join(low, "lo", "left").select("a", F.coalesce("b", "lo").alias("b"))
        rest = save(_oriented(moved), "links")
        release(left)
        left = rest
        step = hooks.select("v", F.col("to").alias("component"))
        if found is None:
            found = save(step, "components")
        else:
            # roots that are hooked now weren't among the vertices found before
            onward = hooks.select(F.col("v").alias("component"), "to")
            later = found.join(onward, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
            both = save(later.unionByName(step), "components")
            release(found)
            found = both
        release(hooks)
    if found is None:
        return left.select(F.col("lo").alias("v"), F.col("hi").alias("component"))
    release(left)
    return found
