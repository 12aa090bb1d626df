"""Fetching pages as a plug-in: a function from URL to text, with retries, run by a bounded number of tasks. Survey IDs in brackets."""

from __future__ import annotations

import http.client
import random
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

# What is worth another try, and the limits of the two clients.
RETRYABLE = frozenset({408, 429, 500, 502, 503, 504})
RETRYABLE_CODES = frozenset({"ECONNRESET", "ETIMEDOUT", "EAI_AGAIN"})
TIMEOUT_S, RETRIES, LINEAR_S, BASE, JITTER_S = 30, 5, 1.0, 1.5, 0.25


class FetchError(Exception):
    def __init__(self, message: str, http_status: int | None = None, code: str = "-") -> None:
        super().__init__(message)
        self.http_status, self.code = http_status, code


def get(url: str, timeout: float = TIMEOUT_S) -> str:
    """One GET over HTTP; failures as FetchError."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise FetchError(str(e), e.code) from e
    except (OSError, http.client.HTTPException) as e:
        raise FetchError(str(e), None, error_code(e)) from e
    except ValueError as e:  # not a URL
        raise FetchError(str(e)) from e


def error_code(e: BaseException) -> str:
    """The code that goes with a failure; what fails while connecting is wrapped once more, and counts as what it is."""
    reason = e.reason if isinstance(e, urllib.error.URLError) and isinstance(e.reason, BaseException) else e
    if isinstance(reason, TimeoutError):
        return "ETIMEDOUT"
    if isinstance(reason, (ConnectionResetError, http.client.RemoteDisconnected, http.client.IncompleteRead)):
        return "ECONNRESET"
    if isinstance(reason, socket.gaierror) and reason.errno == socket.EAI_AGAIN:
        return "EAI_AGAIN"
    return "-"


def linear(n: int) -> float:
    """[NUM-04]"""
    return LINEAR_S * n


def exponential(n: int) -> float:
    """[NUM-03]"""
    return BASE**n + random.random() * JITTER_S


def with_retry(once: Callable[[str], str], url: str, retries: int = RETRIES, delay: Callable[[int], float] = linear, sleep: Callable[[float], None] = time.sleep) -> str:
    """once(url), again after each retryable failure, `retries` times in all [SRC-12]."""
    for n in range(1, retries + 1):
        try:
            return once(url)
        except FetchError as e:
            if n == retries or not (e.http_status in RETRYABLE or e.code in RETRYABLE_CODES):
                raise
            sleep(delay(n))
    raise FetchError("no tries")


def fetch_pages(rows: DataFrame, once: Callable[[str], str] = get, tasks: int = 1, threads: int = 5, url: str = "source_url", retries: int = RETRIES) -> DataFrame:
    """url, html, http_status, error_code, error_message for each row: a failing row never stops the others [ERR-01, UDF-03, SRC-13].

    tasks * threads bounds how many requests are under way in the whole cluster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(u: str | None) -> dict:
            row = {"url": u, "html": None, "http_status": None, "error_code": None, "error_message": None}
            try:
                if not u:
                    raise FetchError("no URL")
                return row | {"html": with_retry(once, u, retries)}
            except FetchError as e:
                return row | {"http_status": e.http_status, "error_code": e.code, "error_message": str(e)}

        kinds = pa.schema([("url", pa.string()), ("html", pa.string()), ("http_status", pa.int32()), ("error_code", pa.string()), ("error_message", pa.string())])
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pa.RecordBatch.from_pylist(list(pool.map(one, batch.column(0).to_pylist())), schema=kinds)

    return rows.select(url).coalesce(tasks).mapInArrow(run, "url string, html string, http_status int, error_code string, error_message string")
