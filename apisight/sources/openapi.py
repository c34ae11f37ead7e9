"""OpenAPI and Swagger documents as declared endpoints. A document is 8 MiB at most, so it is read on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from apisight.ruleset import HTTP_VERBS, MAX_SPEC_BYTES, MAX_SPEC_DEPTH

SCHEMA = "path_pattern string, methods array<string>, declared_auth_schemes array<string>"


class SpecError(ValueError):
    pass


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        pass
    for number, line in enumerate(text.split("\n"), 1):
        bare = re.sub(r"'[^']*'|\"[^\"]*\"", "''", line)
        bare = re.sub(r"(^|\s)#.*", "", bare)
        if re.search(r"(?:^|[:\-\[,{]\s*|^\s+)\*[A-Za-z0-9_]", bare):
            raise SpecError(f"line {number}: YAML aliases are refused")
    try:
        import yaml
    except ImportError as error:
        raise SpecError("the document is no JSON, and no YAML library is installed") from error
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise SpecError(f"neither JSON nor YAML: {error}") from error


def _too_deep(document) -> bool:
    todo = [(document, 1)]
    while todo:
        node, depth = todo.pop()
        if depth > MAX_SPEC_DEPTH:
            return True
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        todo += [(x, depth + 1) for x in inner]
    return False


def _schemes(security) -> set[str]:
    return {name for entry in security if isinstance(entry, dict) for name in entry} if isinstance(security, list) else set()


def _base(text: str) -> str:
    """A base path with a slash before it and none behind; the root is empty."""
    bare = text.rstrip("/")
    return bare if not bare or bare.startswith("/") else f"/{bare}"


def _bases(document: dict) -> set[str]:
    """The base paths under which a document's paths are served. What has no string where one belongs is left out."""
    given, servers = document.get("basePath"), document.get("servers")
    found = [given] if isinstance(given, str) else []
    for server in servers if isinstance(servers, list) else []:
        url = server.get("url") if isinstance(server, dict) else None
        if isinstance(url, str):
            _, slash, rest = url.partition("://")[2].partition("/")
            found.append(slash + rest if "://" in url else url)
    return {_base(x) for x in found} or {""}


def parse_spec(text: str) -> list[tuple[str, list[str], list[str]]]:
    """(path pattern, methods, scheme names) of each declared path, under each base path; patterns of one text are merged."""
    document = _load(text)
    if _too_deep(document):
        raise SpecError(f"nested deeper than {MAX_SPEC_DEPTH}")
    if not isinstance(document, dict) or not isinstance(document.get("paths"), dict):
        raise SpecError("no specification: it has no paths")
    bases = _bases(document)
    merged: dict[str, tuple[set, set]] = {}
    for path, item in document["paths"].items():
        verbs = {str(k).lower(): v for k, v in item.items() if str(k).lower() in HTTP_VERBS} if isinstance(item, dict) else {}
        for base in bases if verbs else ():
            methods, schemes = merged.setdefault(base + ("" if str(path).startswith("/") else "/") + str(path), (set(), set()))
            methods.update(v.upper() for v in verbs)
            schemes.update(_schemes(document.get("security")))
            for operation in verbs.values():
                schemes.update(_schemes(operation.get("security") if isinstance(operation, dict) else None))
    return [(p, sorted(m), sorted(s)) for p, (m, s) in sorted(merged.items())]


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """Declared endpoints of one file, by any path that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    if files.where(f"length > {MAX_SPEC_BYTES}").limit(1).count():
        raise SpecError(f"larger than {MAX_SPEC_BYTES} bytes")
    text = files.select("content").first()["content"].decode("utf-8")
    return spark.createDataFrame(parse_spec(text), SCHEMA)


def parse_specs(specs: DataFrame, key: str) -> DataFrame:
    """key and the declared endpoints of each row's specification (column text), parsed in tasks. A text that is refused fails the query."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *endpoint) for k, text in zip(frame[key], frame["text"], strict=True) for endpoint in parse_spec(text)]
            yield pd.DataFrame(rows, columns=[key, "path_pattern", "methods", "declared_auth_schemes"])

    return specs.select(key, "text").mapInPandas(work, f"{key} {dict(specs.dtypes)[key]}, {SCHEMA}")
