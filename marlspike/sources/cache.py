"""Conversions that are kept by content: a file is converted once, however often, and under however many paths, it is seen.

Two folders grow beside each other. ``texts`` holds what a conversion gave, by a key of the content's digest and the
file's extension; ``places`` which key a file had in a state (path, time, length). A file in a known state isn't read;
one in a new state is read for its digest, and converted only if that is new, too. Each run adds its parts as a whole,
texts before places, so that a run that fails leaves nothing wrong, and two runs at once may add a key twice: its texts
are the same, and one of them is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from . import convert
from .folders import stored, write_whole

TEXTS = "key string, text string, error string"
PLACES = "path string, modificationTime timestamp, length long, key string"
STATE = ["path", "modificationTime", "length"]


def converted(files: DataFrame, folder: str, more: dict[str, convert.Converter] | None = None) -> DataFrame:
    """path, text and error of the files (path, modificationTime, length, content), from the cache in ``folder`` as far as it goes.

    Contents are read where they are and never shuffled. The cache decides by states and digests: what another version of
    a converter would give isn't known to it, a new folder is.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    places, texts = stored(spark, f"{folder}/places", PLACES), stored(spark, f"{folder}/texts", TEXTS)
    new = files.join(places.select(*STATE).distinct(), STATE, "left_anti")
    key = F.concat_ws(".", F.sha2("content", 256), parse.extension(F.col("path")))
    write_whole(new.select(*STATE, key.alias("key")), f"{folder}/_seen", run)
    seen = stored(spark, f"{folder}/_seen/{run}", PLACES)
    if not seen.isEmpty():
        wanted = seen.join(texts.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("path").alias("path"))
        if not wanted.isEmpty():
            some = files.join(wanted.select("path"), "path", "left_semi")
            write_whole(convert.convert(some, more).join(wanted, "path").select("key", "text", "error"), f"{folder}/texts", run)
        write_whole(seen, f"{folder}/places", run)
    texts, places = stored(spark, f"{folder}/texts", TEXTS), stored(spark, f"{folder}/places", PLACES)
    now = files.select(*STATE).join(places.groupBy(*STATE).agg(F.max("key").alias("key")), STATE)
    return now.join(texts.groupBy("key").agg(F.max(F.struct("text", "error")).alias("t")), "key").select("path", "t.text", "t.error")
