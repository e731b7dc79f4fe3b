"""Sitemaps that lead to sitemaps, fetched level by level under a budget for each source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybreak.functions.urls import host
from daybreak.session import ship
from daybreak.sources.fetch import fetch
from daybreak.sources.html import sitemap_udf
from daybreak.sources.items import MOST_PER_SOURCE
from daybreak.tables import remove, stored


class Crawl(NamedTuple):
    pages: DataFrame  # source, pos, url: locations in document order
    visited: DataFrame  # url, error: every address that was read, once
    rounds: int


def polite(addresses: DataFrame, fetcher: Callable[[str], str] = fetch, pause: float = 0.0, attempts: int = 2) -> DataFrame:
    """(url, payload, error) of addresses: those of a host lie in one task, which reads one after the other with a pause between them.

    A failed address is tried again before the next one; its last failure is its error and stops nothing.
    """
    ship(addresses.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            for url, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = error = None
                for _ in range(attempts):
                    time.sleep(max(0.0, last.get(of, -pause) + pause - time.monotonic()))
                    try:
                        payload, error = fetcher(url), None
                    except Exception as failure:  # one address doesn't end the others
                        error = f"{type(failure).__name__}: {failure}"
                    last[of] = time.monotonic()
                    if error is None:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (url, payload, error)], ["url", "payload", "error"])

    dealt = addresses.select("url", F.coalesce(host(F.col("url")), F.lit("")).alias("host")).repartition("host").sortWithinPartitions("host")
    return dealt.mapInArrow(read, "url string, payload string, error string")


def crawl_sitemaps(roots: DataFrame, fetcher: Callable[[str], str] = fetch, *, most: int = MOST_PER_SOURCE, pause: float = 0.0) -> Crawl:
    """The first `most` locations of each source (source, url) in document order, below its sitemap or sitemap index.

    A round reads the maps of one level, each address once for all sources that name it, and is written before the next one; a source follows an address
    once, and what another source has read is not read again. A map is left unread once its source has `most` locations that come before all the map could give.
    Payloads that can't be fetched or parsed give no locations; the former are told with their error.
    """
    spark = roots.sparkSession
    to_read = stored(roots.select("source", "url", F.array(F.lit(0)).alias("path")).distinct(), "frontier")
    found = spark.createDataFrame([], "source string, path array<int>, url string")
    known = spark.createDataFrame([], "url string, payload string, error string")  # every address read so far, in stored tables
    followed = spark.createDataFrame([], "source string, url string")
    rounds = 0
    while not to_read.isEmpty():
        rounds += 1
        known = known.unionByName(stored(polite(to_read.select("url").distinct().join(known.select("url"), "url", "left_anti"), fetcher, pause), "fetched"))
        followed = stored(followed.unionByName(to_read.select("source", "url")), "followed")
        parsed = to_read.join(known.where("error is null"), "url").withColumn("map", sitemap_udf("payload"))
        rows = stored(parsed.select("source", "path", "map.kind", F.posexplode("map.locations").alias("pos", "url")).select("source", F.concat("path", F.array("pos")).alias("path"), "kind", "url"), "locations")
        found = found.unionByName(rows.where("kind = 'urlset'").select("source", "path", "url"))
        place = F.row_number().over(Window.partitionBy("source").orderBy("path"))
        enough = found.withColumn("n", place).where(F.col("n") == most).select("source", F.col("path").alias("limit"))
        deeper = rows.where("kind = 'sitemapindex'").groupBy("source", "url").agg(F.min("path").alias("path"))
        useful = deeper.join(enough, "source", "left").where(F.col("limit").isNull() | (F.col("path") < F.col("limit"))).drop("limit")
        after = stored(useful.join(followed, ["source", "url"], "left_anti").select("source", "url", "path"), "frontier")
        remove(to_read)
        to_read = after
    place = F.row_number().over(Window.partitionBy("source").orderBy("path"))
    return Crawl(found.withColumn("pos", place).where(F.col("pos") <= most).select("source", "pos", "url"), known.select("url", "error"), rounds)
