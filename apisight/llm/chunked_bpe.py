"""Byte-level BPE of long texts in overlapping chunks, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode, encoder

#: Characters from one chunk's start to the next one's, and by how many a chunk reaches into the next.
STRIDE, OVERLAP = 32768, 2048
#: A pre-token is sure only if it ends so many characters before the chunk: its pattern looks no further ahead.
AHEAD = 4


def boundaries(text: str, whole: bool) -> list[int]:
    """Where pre-tokens of the text begin and end; unless it is whole, only those that more text behind it can't change."""
    ends = [0]
    last = len(text) if whole else len(text) - AHEAD
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        if m.end() > last:
            break
        ends.append(m.end())
    return ends


def long_pieces(docs: DataFrame, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """The texts of docs (rid, doc_id, text, not empty; rid is unique) cut at pre-token boundaries: rid, doc_id, piece (from 0), body.

    Chunks of stride + overlap characters are pre-tokenised in parallel, each from its own start. Where a boundary in a chunk's overlap is also
    one of the next chunk, both go on alike from there: pre-tokens depend on nothing before their start. The first such place is the cut. A
    chunk before it with none (a run of letters longer than the overlap) has no cut, and its piece goes on through the next chunk. A chunk's
    boundaries are right from the end of its first pre-token on at the latest: begun inside a run, that one ends where the whole one ends.
    """
    kind = dict(docs.dtypes)["doc_id"]
    # cut once, in one pass over the text; rows then hold their chunks alone
    strides = docs.select("rid", "doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("s"))
    later = lambda s: F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit("")))
    bodies = F.zip_with("s", later(F.col("s")), lambda x, y: F.struct(F.concat(x, F.substring(y, 1, overlap)).alias("body"), (F.length(y) <= overlap).alias("short")))
    chunks = strides.select("rid", "doc_id", F.size("s").alias("n"), F.posexplode(bodies).alias("k", "c"))
    whole = (F.col("k") >= F.col("n") - 2) & F.col("c.short")
    chunks = chunks.select("rid", "doc_id", "k", "c.body", whole.alias("whole"), (F.col("k") == F.col("n") - 1).alias("last"))
    chunks = chunks.repartition("rid", "k")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [boundaries(b, w) for b, w in zip(frame["body"], frame["whole"], strict=True)]
            frame["head"] = [[x for x in f if x <= overlap] for f in found]
            frame["tail"] = [[x - stride for x in f if x >= stride] for f in found]
            yield frame

    marked = chunks.mapInPandas(work, f"rid long, doc_id {kind}, k int, body string, whole boolean, last boolean, head array<int>, tail array<int>")
    order = Window.partitionBy("rid", "doc_id").orderBy("k")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))  # in the next chunk
    marked = marked.select("rid", "doc_id", "k", "body", "last", cut.alias("cut"))
    marked = marked.withColumn("from", F.lag("cut").over(order)).withColumn("piece", F.coalesce(F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a chunk gives what lies from its cut (or start) to the next one's start, and to the cut after that
    end = F.when(F.col("last"), F.length("body")).otherwise(F.lit(stride) + F.coalesce("cut", F.lit(0)))
    begin = F.coalesce("from", F.lit(0))
    own = marked.select("rid", "doc_id", "piece", "k", F.substring("body", begin + 1, end - begin).alias("body"))
    parts = own.groupBy("rid", "doc_id", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "body"))).alias("parts"))
    return parts.select("rid", "doc_id", "piece", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("body"))


def _ids_frame(path: str, texts) -> list[bytes]:
    return [np.array(encode(path, t), np.uint32).tobytes() for t in texts]


def encode_texts(docs: DataFrame, path: str, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary: unsigned little-endian 32-bit) of every row, as the vocabulary's library encodes its whole text.

    Texts of up to stride characters are encoded where they are; longer ones by long_pieces, whose pieces are encoded in parallel and put
    together in order. Null texts are empty. Rows repeated under one doc_id are encoded each. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": _ids_frame(path, part["text"])})

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["ids"] = _ids_frame(path, frame["body"])
            yield frame.drop(columns="body")

    at_once = docs.where(F.length("text") <= stride).mapInPandas(short, f"doc_id {kind}, ids binary")
    long = docs.where(F.length("text") > stride).withColumn("rid", F.monotonically_increasing_id())
    encoded = long_pieces(long, stride, overlap).mapInPandas(pieces, f"rid long, doc_id {kind}, piece long, ids binary")
    joined = encoded.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    joined = joined.select("doc_id", F.transform("parts", lambda p: p["ids"]).alias("parts"))

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [b"".join(p) for p in frame["parts"]]})

    return at_once.union(joined.mapInPandas(together, f"doc_id {kind}, ids binary"))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to)."""
    kind = dict(encoded.dtypes)["doc_id"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.array([str(i) for i in range(encoder(path).n_vocab + 1)], object)
        for frame in frames:
            n, ids_sha, text_sha = [], [], []
            for raw in frame["ids"]:
                ids = np.frombuffer(raw, np.uint32)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(table[ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder(path).decode_bytes(ids.tolist())).hexdigest())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}).astype({"n_tokens": "int64"})

    return encoded.select("doc_id", "ids").mapInPandas(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
