"""Embedding inputs of graph records: fields in a fixed order, one line each, with every default written out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def entity_units(entities: DataFrame) -> DataFrame:
    """(target_id, utf8) of entities (id, title, entity_type, aliases, description?): aliases sorted, each once."""
    alias = F.to_json(F.array_sort(F.array_distinct("aliases")))
    described = F.when(F.col("description").isNotNull(), F.concat(F.lit("Description: "), "description"))
    return entities.select(
        F.col("id").alias("target_id"),
        _lines(F.concat(F.lit("Entity: "), quoted(F.col("title"))), F.concat(F.lit("Type: "), "entity_type"), F.concat(F.lit("Aliases: "), alias), F.lit("Status: active"), described).alias("utf8"),
    )


def assertion_units(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """(target_id, utf8) of assertions, their endpoints joined to the entities; an endpoint that isn't there has no title."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("title").alias("s"))
    o = entities.select(F.col("id").alias("object_id"), F.col("title").alias("o"))
    rows = assertions.join(s, "subject_id", "left").join(o, "object_id", "left")
    end = lambda i, t: F.to_json(F.struct(F.col(i).alias("id"), F.col(t).alias("title")))
    return rows.select(
        F.col("id").alias("target_id"),
        _lines(F.concat(F.lit("Subject: "), end("subject_id", "s")), F.concat(F.lit("Predicate: "), "predicate"), F.concat(F.lit("Object: "), end("object_id", "o")), F.concat(F.lit("Negated: "), F.col("negated").cast("string")), F.lit("Modality: asserted")).alias("utf8"),
    )


def graph_rows(entities: DataFrame, assertions: DataFrame, form: Callable[[Column], Column] = lambda c: c, between: str = " ") -> DataFrame:
    """(target_id, target_kind, title, name, aliases, endpoints, predicate, qualifiers, description) of both, as they are indexed.

    entities: id, title, aliases, description, eligibility; an entity has only its name, aliases and, while it is current, description.
    assertions: id, subject_id, predicate, object_id, negated; one has the titles and aliases of its subject, then of its object, and
    its qualifiers as JSON. An endpoint that is no entity has its id. Texts but title and aliases are given in a form, an
    endpoint's once for each entity; `between` is what stands between the forms of two endpoints.
    """
    empty, none = F.lit(""), F.array().cast("array<string>")
    e = entities.select(
        F.col("id").alias("target_id"), F.lit("entity").alias("target_kind"), "title", form(F.col("title")).alias("name"), "aliases", empty.alias("endpoints"), empty.alias("predicate"), empty.alias("qualifiers"),
        F.when(F.col("eligibility") == "current", form(F.coalesce("description", empty))).otherwise(empty).alias("description"),
    )
    named = entities.select("id", form(F.concat_ws(" ", "title", F.array_join("aliases", " "))).alias("words"))
    at = lambda side: named.select(F.col("id").alias(f"{side}_id"), F.col("words").alias(side)).hint("shuffle_hash")  # noqa: E731 - entities have each id once, so that the many assertions needn't be sorted
    a = assertions.join(at("subject"), "subject_id", "left").join(at("object"), "object_id", "left")
    json = lambda negated: form(F.lit(f'{{"modality":"asserted","negated":{negated}}}'))
    qualifiers = F.when(F.coalesce("negated", F.lit(False)), json("true")).otherwise(json("false"))
    a = a.select(
        F.col("id").alias("target_id"), F.lit("assertion").alias("target_kind"), F.col("id").alias("title"), empty.alias("name"), none.alias("aliases"),
        F.concat_ws(between, F.coalesce("subject", form(F.col("subject_id"))), F.coalesce("object", form(F.col("object_id")))).alias("endpoints"), form(F.col("predicate")).alias("predicate"), qualifiers.alias("qualifiers"), empty.alias("description"),
    )
    return e.unionByName(a)
