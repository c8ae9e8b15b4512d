"""Fetching pages by a callable that is plugged in; the engine itself has no network code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, url_hash string, fetched_at timestamp, headers map<string,string>, body binary, status int, duration_ms double, bytes_downloaded long, error string"


def fetched(urls: DataFrame, call: Callable[[str], tuple[int, dict, bytes]], retries: int = 1, wait: tuple[float, float] = (2.0, 10.0), hosts_at_once: int = 64, min_gap: float = 0.0) -> DataFrame:
    """One row per row of ``urls`` (url). ``call(url)`` gives (status, headers, body) or raises.

    Rows are dealt by host, so a host is asked by one task and at most every ``min_gap`` seconds; between attempts the
    wait grows in equal steps between its bounds. A status from 400 on or the last exception becomes ``error``.
    """
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    low, high = wait

    def run(batches):
        import datetime
        import hashlib
        import time

        import pandas as pd

        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for url, h in zip(b["url"], b["host"]):
                error, status, headers, body = None, None, {}, None
                began = time.monotonic()
                for attempt in range(1, retries + 2):
                    time.sleep(max(0.0, last.get(h, -1e9) + min_gap - time.monotonic()))
                    last[h] = began = time.monotonic()
                    try:
                        status, headers, body = call(url)
                        error = f"status {status}" if status >= 400 else None
                        break
                    except Exception as e:  # whatever a plugged-in fetcher raises is the row's error
                        error = f"{type(e).__name__}: {e}"
                        if attempt <= retries:
                            time.sleep(min(high, low + (high - low) * (attempt - 1) / max(retries, 1)))
                rows.append((url, hashlib.sha256((url or "").encode()).hexdigest(), datetime.datetime.now(datetime.timezone.utc), list(headers.items()), body, status, (time.monotonic() - began) * 1000, None if body is None else len(body), error))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.replace("map<string,string>", "map").split(", ")])
            out["headers"] = out["headers"].map(dict)
            out["status"], out["bytes_downloaded"] = out["status"].astype("Int32"), out["bytes_downloaded"].astype("Int64")
            yield out

    dealt = urls.select("url", host.alias("host")).repartition(hosts_at_once, "host")
    return dealt.mapInPandas(run, FETCHED)
