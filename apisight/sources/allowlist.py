"""Allowlist files: endpoints and path patterns whose findings are known."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "line_number long, kind string, value string"
#: The first significant line: any name, then `-allowlist 1`.
HEADER = r"[a-z]+-allowlist 1"


class AllowlistError(ValueError):
    pass


def parse_allowlist(text: str) -> list[tuple[int, str, str]]:
    out, headed = [], False
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r").split("#", 1)[0].strip()
        if not line:
            continue
        if not headed:
            if not re.fullmatch(HEADER, line):
                raise AllowlistError(f"line {number}: the header is missing")
            headed = True
            continue
        kind, _, value = line.partition(" ")
        value = value.strip()
        if kind not in ("endpoint", "pattern") or not value:
            raise AllowlistError(f"line {number}: unknown rule")
        out.append((number, kind, value))
    if not headed:
        raise AllowlistError("the header is missing")
    return out


def read_allowlist(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_allowlist(text), SCHEMA)


def parse_allowlists(files: DataFrame, key: str) -> DataFrame:
    """key and the rules of each row's allowlist (column text), parsed in tasks. A text that is refused fails the query."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *rule) for k, text in zip(frame[key], frame["text"], strict=True) for rule in parse_allowlist(text)]
            yield pd.DataFrame(rows, columns=[key, "line_number", "kind", "value"])

    return files.select(key, "text").mapInPandas(work, f"{key} {dict(files.dtypes)[key]}, {SCHEMA}")
