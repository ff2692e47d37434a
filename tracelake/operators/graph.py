"""Session-to-project graph and its deterministic layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import basename, unit_hash

# Spread around a hub, least size of a long session, least size and factor of nodes, colours.
SPREAD = 0.32
VIBE = 5
HUB_SIZE, OWN_SIZE = (2.5, 1.8), (1.1, 0.85)
COOL, WARM, HUB = "#4f9dff", "#ff6b4f", "#9b8cff"


def labelled(sessions: DataFrame) -> DataFrame:
    """Sessions with a project label; other folders of a known name get a hash of their path.

    The folder of a name's first session (by start, then id) keeps the bare name.
    """
    named = sessions.withColumn("name", basename(F.col("cwd"))).where(F.col("name").isNotNull())
    first = named.groupBy("name").agg(F.min_by("cwd", F.struct(F.col("started_at").isNull(), "started_at", "provider", "session_id")).alias("first_cwd"))
    tagged = F.concat("name", F.lit("#"), F.substring(F.sha1(F.col("cwd").cast("binary")), 1, 4))
    return named.join(first, "name").withColumn("label", F.when(F.col("cwd") == F.col("first_cwd"), F.col("name")).otherwise(tagged)).drop("name", "first_cwd")


def _session_id() -> Column:
    return F.concat("provider", F.lit(":"), "session_id")


def nodes(sessions: DataFrame) -> DataFrame:
    """Session nodes and one hub per project."""
    rows = labelled(sessions)
    events = F.greatest(F.coalesce("event_count", F.lit(0)), F.lit(0))
    own = rows.select(_session_id().alias("id"), F.lit("session").alias("kind"), "label", events.alias("size"), (events < VIBE).alias("vibe"))
    hubs = rows.groupBy("label").agg(F.count("*").alias("size")).select(F.concat(F.lit("hub:"), "label").alias("id"), F.lit("hub").alias("kind"), "label", "size", F.lit(False).alias("vibe"))
    return own.unionByName(hubs)


def links(sessions: DataFrame) -> DataFrame:
    return labelled(sessions).select(_session_id().alias("source"), F.concat(F.lit("hub:"), "label").alias("target"))


def points(sessions: DataFrame) -> DataFrame:
    """Nodes with colour, size and a place near their hub, from hashes of their ids alone."""
    every = nodes(sessions)
    hub = F.concat(F.lit("hub:"), "label")
    is_hub = F.col("kind") == "hub"
    place = []
    for salt, axis in enumerate("xyz", 1):
        centre = unit_hash(hub, salt) * 2 - 1
        at = F.round(F.when(is_hub, centre).otherwise(centre + (unit_hash(F.col("id"), salt) - 0.5) * SPREAD), 3)
        place.append(F.when(at == 0, 0.0).otherwise(at).alias(axis))  # no negative zero
    colour = F.when(is_hub, HUB).when(F.col("vibe"), COOL).otherwise(WARM)
    size = F.when(is_hub, F.greatest(F.lit(HUB_SIZE[0]), F.sqrt("size") * HUB_SIZE[1])).otherwise(F.greatest(F.lit(OWN_SIZE[0]), F.sqrt(F.col("size") + 1) * OWN_SIZE[1]))
    return every.select("id", *place, colour.alias("c"), F.round(size, 2).alias("s"))
