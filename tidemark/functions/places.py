"""The reference dimension of places: canonical names without spaces, and how people write them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import norm

# The canonical names.
COUNTIES = """
Adams Alexander Bond Boone Brown Bureau Calhoun Carroll Cass Champaign Christian Clark Clay Clinton Coles Cook
Crawford Cumberland DeKalb DeWitt Douglas DuPage Edgar Edwards Effingham Fayette Ford Franklin Fulton Gallatin Greene
Grundy Hamilton Hancock Hardin Henderson Henry Iroquois Jackson Jasper Jefferson Jersey JoDaviess Johnson Kane
Kankakee Kendall Knox Lake LaSalle Lawrence Lee Livingston Logan Macon Macoupin Madison Marion Marshall Mason Massac
McDonough McHenry McLean Menard Mercer Monroe Montgomery Morgan Moultrie Ogle Peoria Perry Piatt Pike Pope Pulaski
Putnam Randolph Richland RockIsland Saline Sangamon Schuyler Scott Shelby Stark StClair Stephenson Tazewell Union
Vermilion Wabash Warren Washington Wayne White Whiteside Will Williamson Winnebago Woodford
""".split()

# Names that are written with spaces.
DISPLAY = {"DeWitt": "De Witt", "JoDaviess": "Jo Daviess", "LaSalle": "La Salle", "RockIsland": "Rock Island", "StClair": "St. Clair"}


def dimension(spark: SparkSession, names: Sequence[str] = COUNTIES) -> DataFrame:
    """(name, norm): one row a canonical name."""
    return spark.createDataFrame([(n,) for n in names], "name string").withColumn("norm", norm(F.col("name")))


def display(name: Column) -> Column:
    out = None
    for key, text in DISPLAY.items():
        out = F.when(name == key, text) if out is None else out.when(name == key, text)
    return out.otherwise(name)
