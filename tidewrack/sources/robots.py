"""Which addresses a site's robots.txt lets a crawler fetch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame


@lru_cache(maxsize=4096)
def _rules(text: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def allowed(frontier: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Rows of frontier(url, host, ...) that robots(host, robots_txt) doesn't forbid to the agent; a host without a text forbids nothing."""
    joined = frontier.join(robots.select("host", "robots_txt"), "host", "left").select(*frontier.columns, "robots_txt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yes = [not isinstance(text, str) or _rules(text).can_fetch(agent, url) for text, url in zip(batch["robots_txt"], batch["url"], strict=True)]
            yield batch[yes].drop(columns="robots_txt")

    return joined.mapInPandas(run, frontier.schema)
