"""Extraction by a provider outside of the kernel: any callable, or a service that answers over HTTP."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str, str], str | None]


def http_provider(service: str, timeout: float = 15.0) -> Provider:
    """A provider that posts a page to `service`/extract and reads `markdown` from the answer; any failure gives None."""

    def ask(html: str, url: str) -> str | None:
        body = json.dumps({"url": url, "html": html, "output": "markdown", "includeMetadata": True}).encode()
        request = urllib.request.Request(f"{service.rstrip('/')}/extract", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                said = json.load(answer)
        except (OSError, ValueError, urllib.error.URLError):
            return None
        return said.get("markdown") if isinstance(said, dict) and said.get("success", True) else None

    return ask


def provided(pages: DataFrame, provider: Provider) -> DataFrame:
    """The pages (page_id, url, html) as page_id and provided, the provider's Markdown; null where it has none or fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [provider(html or "", url or "") for url, html in zip(batch["url"], batch["html"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "provided": pd.Series(said, dtype=object)})

    kind = dict(pages.dtypes)["page_id"]
    made = pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(run, "page_id string, provided string")
    return made.withColumn("page_id", F.col("page_id").cast(kind))


def chosen(local: Column, score: Column, remote: Column, least: float = 65.0) -> Column:
    """The local Markdown, or the provider's where the local one scores too low and there is another."""
    return F.when((score < least) & (F.length(F.trim(F.coalesce(remote, F.lit("")))) > 0), remote).otherwise(local)
