"""Line-based inputs, fetching and component reports."""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import lexicon


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores where it has fewer files than there are cores, for work that costs far more than moving
    the rows. Splits say nothing: a file may be one row group, all of whose rows go to one of its splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: lines of a text file without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """term (lower case) and lang (null: all) of lines `term` or `term:lang`."""
    lines = url_list(spark, path)
    parts = F.split("url", ":", 2)
    return lines.select(F.lower(F.trim(parts[0])).alias("term"), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("lang")).distinct()


def whitelist_terms(listed: DataFrame, most: int = 100_000) -> tuple[str, ...]:
    """Terms of whitelist(), whatever their language, for AuditConfig(whitelist=...). A list of more than `most` terms
    is refused, as it is a part of every task."""
    terms = [r.term for r in listed.select("term").filter("term is not null").distinct().orderBy("term").limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"a whitelist has {most} terms at most")
    return tuple(terms)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and whether both make a fetchable URL."""
    scheme, netloc = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return scheme, netloc, scheme.isin("http", "https") & (netloc != "")


def recommended_fetcher(url: Column) -> Column:
    low = F.lower(url)
    hit = low.contains(lexicon.SCRIPT_HINTS[0])
    for hint in lexicon.SCRIPT_HINTS[1:]:
        hit = hit | low.contains(hint)
    return F.when(hit, "browser").otherwise("static")


def available(status: Column) -> Column:
    """Whether a probe's status says that a page is there: success or redirection."""
    return F.coalesce(status.between(200, 399), F.lit(False))


def backoff(attempt: int) -> int:
    """Seconds to wait before a further attempt."""
    return min(2**attempt, 3)


class FetchError(RuntimeError):
    """A page could not be fetched."""


def get_with_retries(get: Callable[[str], dict], url: str, retries: int = 3, fail_fast: bool = False, most: float = 30.0, sleep=time.sleep) -> dict:
    """Client errors (4xx) and fail_fast end at once; others are tried again until `retries` or `most` seconds."""
    began = time.monotonic()
    for attempt in range(1 + (0 if fail_fast else retries)):
        try:
            return get(url)
        except Exception as error:  # noqa: BLE001  any failure of a plugged-in client
            status = getattr(error, "status", None) or getattr(error, "code", None)
            last = fail_fast or attempt == retries or (status and 400 <= int(status) < 500) or time.monotonic() - began > most
            if last:
                raise FetchError(f"{url}: {error}") from error
            sleep(backoff(attempt))
    raise FetchError(url)


FETCHED = "url string, html string, status int, error string, final_url string, redirect_count int, content_type string, content_encoding string, content_length bigint, server string, last_modified string, etag string, response_time_seconds double, response_time_ms double, word_count bigint, line_count bigint"


def response_row(url: str, got: dict, seconds: float) -> tuple:
    """A row of FETCHED from what a client returned: content, status, url (the last one), history (redirects passed),
    encoding and headers, each if it has it."""
    headers, text = {k.lower(): v for k, v in (got.get("headers") or {}).items()}, got.get("content") or ""
    redirects = got.get("history") or ()
    return (url, got.get("content"), got.get("status"), None, got.get("url") or url, redirects if isinstance(redirects, int) else len(redirects), headers.get("content-type", ""), got.get("encoding") or "unknown", len(text), headers.get("server", ""), headers.get("last-modified", ""), headers.get("etag", ""), seconds, seconds * 1000, len(text.split()), text.count("\n"))


def _requests(urls: DataFrame, call: Callable[[str], tuple]) -> DataFrame:
    kinds = to_arrow_schema(StructType.fromDDL(FETCHED))

    def run(batches):
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                try:
                    out.append(call(url))
                except FetchError as error:
                    out.append((url, None, None, str(error), *[None] * (len(kinds) - 4)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], schema=kinds)

    return urls.select("url").mapInArrow(run, FETCHED)


def fetch(urls: DataFrame, get: Callable[[str], dict], retries: int = 3, fail_fast: bool = False) -> DataFrame:
    """A row of FETCHED for each url: page, status or error, and what the response says of itself. get(url) returns a
    dict (see response_row); it runs on executors. response_time_seconds holds all attempts and waits."""

    def call(url: str) -> tuple:
        began = time.monotonic()
        return response_row(url, get_with_retries(get, url, retries, fail_fast), time.monotonic() - began)

    return _requests(urls, call)


def probe(urls: DataFrame, head: Callable[[str], dict], retries: int = 3, fail_fast: bool = True) -> DataFrame:
    """fetch() with a client that asks for headers only: no html; content_length is what the headers say, and
    is_available whether the page is there."""

    def call(url: str) -> tuple:
        began = time.monotonic()
        got = get_with_retries(head, url, retries, fail_fast)
        row = list(response_row(url, {**got, "content": None}, time.monotonic() - began))
        size = {k.lower(): v for k, v in (got.get("headers") or {}).items()}.get("content-length")
        row[8] = int(size) if str(size or "").isdigit() else None
        return tuple(row)

    return _requests(urls, call).drop("word_count", "line_count").withColumn("is_available", available(F.col("status")))


def capabilities(spark: SparkSession) -> DataFrame:
    """family, component and whether its library can be imported; those without one are always there."""
    rows = [("fetcher", "static", "requests"), ("fetcher", "browser", "playwright"), ("extractor", "html", None), ("detector", "native", None), ("detector", "fasttext", "fasttext"), ("detector", "langid", "langid"), ("verifier", "placeholder", None), ("verifier", "heuristic", None), ("verifier", "languagetool", "language_tool_python")]
    return spark.createDataFrame([(f, c, m is None or importlib.util.find_spec(m) is not None) for f, c, m in rows], "family string, component string, available boolean")
