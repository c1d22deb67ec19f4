"""Entities (configurations, data sources, artifacts, workspaces, memories) as folds of sparse changes.

A change has an id, a moment (at, seq), an operation and the names of the fields it gives: ``set`` writes these fields,
null included, ``delete`` is a tombstone for all that came before. Each field's value is its own last write, so changes
may arrive in any order. A fold is one aggregation with a partial sum per task: an entity with very many changes is
summed up before the shuffle, and no history is gathered in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(changes: DataFrame, fields: list[str], given: str = "given") -> DataFrame:
    """id, the fields, created_at, updated_at and deleted_at of each entity by its changes (id, at, seq, op, given, and the fields).

    An entity lives if a ``set`` follows its last ``delete``; fields not given since are null. created_at is the first
    moment of the entity, over all its lives; updated_at the last write; deleted_at the last tombstone if it is dead.
    """
    moment = F.struct("at", "seq")
    wrote = F.col("op") == "set"
    last = [F.max(F.when(wrote & F.array_contains(given, c), F.struct("at", "seq", F.col(c).alias("value")))).alias(f"last_{c}") for c in fields]
    out = changes.groupBy("id").agg(
        F.max(F.when(wrote, moment)).alias("last_set"), F.max(F.when(F.col("op") == "delete", moment)).alias("gone"), F.min(F.when(wrote, F.col("at"))).alias("created_at"), *last
    )
    since = lambda c: F.col("gone").isNull() | (F.struct(F.col(f"last_{c}.at").alias("at"), F.col(f"last_{c}.seq").alias("seq")) > F.col("gone"))
    lives = F.col("last_set").isNotNull() & (F.col("gone").isNull() | (F.col("last_set") > F.col("gone")))
    return out.select(
        "id", *(F.when(since(c), F.col(f"last_{c}.value")).alias(c) for c in fields), "created_at",
        F.col("last_set.at").alias("updated_at"), F.when(~lives, F.col("gone.at")).alias("deleted_at"), lives.alias("lives"),
    )


def living(folded: DataFrame) -> DataFrame:
    return folded.where("lives").drop("lives", "deleted_at")


def cascaded(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Folded children without those whose parent (folded, by ``key``) is dead or has died since the child's last write; children without a parent stay."""
    dead = parents.select(F.col("id").alias(key), F.col("lives").alias("parent_lives"), F.col("deleted_at").alias("parent_gone"))
    both = children.join(dead, key, "left")
    orphaned = F.coalesce(~F.col("parent_lives"), F.lit(False))
    return both.withColumn("lives", F.col("lives") & ~orphaned).withColumn("deleted_at", F.when(F.col("lives"), F.lit(None)).otherwise(F.coalesce("deleted_at", "parent_gone"))).select(*children.columns)


def as_changes(rows: DataFrame, fields: list[str], at: Column) -> DataFrame:
    """Present rows as changes that came before all others: each gives all its fields."""
    return rows.select("id", at.alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("set").alias("op"), F.array(*map(F.lit, fields)).alias("given"), *fields)


def patched(old: DataFrame, changes: DataFrame, fields: list[str], updated: str = "updated_at") -> DataFrame:
    """Old rows after the changes to them; ``updated`` moves to the last change that gives a field. Changes of unknown ids do nothing.

    Changes (id, at, seq, op, given, fields) may come several to an id and in any order. They are folded first, so that
    the old table meets one row per id; old rows that share an id all change. A tombstone takes rows out, unless the
    entity was set again after it: then its fields are those given since.
    """
    moment = F.struct("at", "seq")
    wrote = F.col("op") == "set"
    last = [F.max(F.when(wrote & F.array_contains("given", c), F.struct("at", "seq", F.col(c).alias("value")))).alias(f"last_{c}") for c in fields]
    news = changes.groupBy("id").agg(
        F.max(F.when(wrote & (F.size("given") > 0), moment)).alias("wrote"), F.max(F.when(F.col("op") == "delete", moment)).alias("gone"), *last
    )
    both = old.join(news, "id", "left").where(F.col("gone").isNull() | F.coalesce(F.col("wrote") > F.col("gone"), F.lit(False)))
    given = lambda c: F.struct(F.col(f"last_{c}.at").alias("at"), F.col(f"last_{c}.seq").alias("seq"))
    value = lambda c: (
        F.when(F.col(f"last_{c}").isNotNull() & (F.col("gone").isNull() | (given(c) > F.col("gone"))), F.col(f"last_{c}.value")).when(F.col("gone").isNull(), F.col(c))
    )
    taken = {c: value(c) for c in fields} | {updated: F.coalesce("wrote.at", updated)}
    return both.select(*((taken[c].alias(c) if c in taken else F.col(c)) for c in old.columns))
