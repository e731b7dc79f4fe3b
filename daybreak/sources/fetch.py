"""Pages by HTTP, on the executors; a caller may give a fetcher of its own."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from urllib.parse import quote
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame

from daybreak.session import ship

TIMEOUT = 20
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; daybreak)", "Accept": "text/html,application/xml,application/json;q=0.9,*/*;q=0.8", "Accept-Encoding": "gzip"}
#: What an address may hold as it is; other characters are quoted.
_PLAIN = "".join(chr(c) for c in range(33, 127))


def fetch(url: str, timeout: float = TIMEOUT) -> str:
    """The text at an address; gzip is told by its header or its first bytes."""
    with urlopen(Request(quote(url, safe=_PLAIN), headers=HEADERS), timeout=timeout) as response:
        data = response.read()
        packed = response.headers.get("Content-Encoding", "") == "gzip" or data[:2] == b"\x1f\x8b"
        return (gzip.decompress(data) if packed else data).decode(response.headers.get_content_charset() or "utf-8", "replace")


def fetched(addresses: DataFrame, fetcher: Callable[[str], str] = fetch) -> DataFrame:
    """(url, payload, error) of each address in `url`; a failure gives its message and stops nothing."""
    ship(addresses.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                payload = error = None
                try:
                    payload = fetcher(url)
                except Exception as failure:  # one address doesn't end the others
                    error = f"{type(failure).__name__}: {failure}"
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (url, payload, error)], ["url", "payload", "error"])

    return addresses.select("url").mapInArrow(read, "url string, payload string, error string")
