"""The zone table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ZONES, ZONES_AS_OF
from ..functions import geo
from ..schemas import ZONES as SCHEMA


def table(spark: SparkSession, zones: tuple = ZONES) -> DataFrame:
    return spark.createDataFrame(list(zones), SCHEMA)


def outlines(zones: DataFrame) -> DataFrame:
    """id, ring: each circle as a closed ring."""
    return zones.select("id", geo.disc_ring(F.col("lat"), F.col("lon"), F.col("radius_m")).alias("ring"))


def status_label(status):
    return F.when(status == "COMMISSIONING", "Being set up").when(status == "PLANNED", "Planned")


def signature(zones: tuple = ZONES) -> str:
    """Changes with ids, places, radii or their order; not with wording or status."""
    return hashlib.sha256(json.dumps([z[:4] for z in zones]).encode()).hexdigest()


def as_of() -> str:
    """The day on which the table was last checked."""
    return ZONES_AS_OF
