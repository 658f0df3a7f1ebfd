"""JSON replies of web requests, as rows: a request a row in, its reply or its error out.

Requests are spread over tasks like any rows; a task sends one at a time. What cannot be had is a row with an error, not a
failed job. Replies can be kept in a folder and are then not asked for again.
"""

from __future__ import annotations

from collections.abc import Iterator
import json
import random
import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .records import request_key
from .tables import table_or_none

#: Seconds a request may take, tries after the first, first pause and longest pause in seconds, jitter.
TIMEOUT, RETRIES, PAUSE, LONGEST_PAUSE, JITTER = 20.0, 4, 0.5, 8.0, 0.25
#: Body of a reply that says there is nothing.
NO_DATA = '{"__wt_no_data":true}'
REPLY = "url string, url_key string, http_status int, body string, error string, tries int"


def get_json(url: str, contact: str, timeout: float = TIMEOUT, retries: int = RETRIES, pause: float = PAUSE) -> tuple[int | None, str | None, str | None, int]:
    """``(status, body, error, tries)`` of one request. 404 is no error but a reply that says there is nothing. Network failures,
    429 and server errors are tried again with growing pauses; other statuses, and what is no JSON, are errors at once."""
    for k in range(retries + 1):
        last = k == retries
        try:
            ask = urllib.request.Request(url, headers={"User-Agent": contact, "Accept": "application/json"})
            with urllib.request.urlopen(ask, timeout=timeout) as reply:
                body = reply.read().decode("utf-8")
                try:
                    json.loads(body)
                except ValueError:
                    return reply.status, body, "bad_json", k + 1
                return reply.status, body, None, k + 1
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return 404, NO_DATA, None, k + 1
            if e.code == 403:
                return 403, None, "forbidden", k + 1
            if not (e.code == 429 or e.code >= 500):
                return e.code, None, "http", k + 1
            if last:
                return e.code, None, "upstream", k + 1
        except (urllib.error.URLError, OSError, UnicodeDecodeError):
            if last:
                return None, None, "network", k + 1
        time.sleep(min(LONGEST_PAUSE, pause * 2**k) + random.uniform(0, JITTER if pause >= PAUSE else 0))
    raise AssertionError


def fetch_json(requests: DataFrame, contact: str, url: str = "url", kept: str | None = None, **how: float) -> DataFrame:
    """``(url, url_key, http_status, body, error, tries)`` of the distinct URLs of ``requests``, null ones left out.

    ``contact`` says who asks and must not be empty. ``kept``: a folder of replies (Parquet); what it has is not asked for
    again (``tries`` 0), and :func:`keep_replies` adds to it.
    """
    if not contact.strip():
        raise ValueError("missing_contact: servers want to know who asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *get_json(u, contact, **how)) for u in b["url"]]
            yield pd.DataFrame(rows, columns=["url", "http_status", "body", "error", "tries"]).astype({"http_status": "Int32"})

    asked = requests.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    got = None
    if kept is not None:
        there = table_or_none(requests.sparkSession, kept, REPLY).select("url", "http_status", "body", "error").where("error is null")
        got = asked.join(there.dropDuplicates(["url"]), "url").withColumn("tries", F.lit(0))
        asked = asked.join(there, "url", "left_anti")
    new = asked.mapInPandas(run, "url string, http_status int, body string, error string, tries int")
    return (new if got is None else new.unionByName(got)).select("url", request_key(F.col("url")).alias("url_key"), "http_status", "body", "error", "tries")


def keep_replies(replies: DataFrame, kept: str) -> None:
    """Adds the replies that were asked for to the folder; errors are not kept."""
    replies.where("tries > 0 and error is null").write.mode("append").parquet(kept)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.contact = options.get("contact", "")
        if not self.contact.strip():
            raise ValueError("missing_contact: servers want to know who asks")
        self.size = int(options.get("requests_a_task", "8"))
        self.retries = int(options.get("retries", str(RETRIES)))

    def partitions(self) -> list[_Part]:
        return [_Part(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for u in partition.urls:
            yield (u, *get_json(u, self.contact, retries=self.retries))


class JsonRequests(DataSource):
    """``spark.read.format("json_requests").option("urls", <JSON list>).option("contact", ...).load()``, for lists of URLs that fit into
    an option; :func:`fetch_json` takes any number."""

    @classmethod
    def name(cls) -> str:
        return "json_requests"

    def schema(self) -> str:
        return "url string, http_status int, body string, error string, tries int"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonRequests)
