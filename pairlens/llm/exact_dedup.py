"""Exact duplicates by composable polynomial fingerprints.

A text without its white space is a polynomial over its bytes, taken modulo two
primes. Chunks are hashed apart and composed: ``h(xy) = h(x) * B^len(y) + h(y)``.
Texts longer than ``chunk_chars`` are dealt out as chunks to many tasks. Equal
fingerprints are then compared chunk by chunk; where a chunk differs, the group
is parted by its digests.
"""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import map_rows, text_bytes, text_key

PRIMES = (2147483647, 2147483629)
BASES = (1315423911, 776531401)
CHUNK_CHARS = 1 << 16
SPACE = b" \t\n\v\f\r"
_BLOCK = 512
_POWERS = [np.array([pow(b, k, p) for k in range(_BLOCK - 1, -1, -1)], np.uint64) for b, p in zip(BASES, PRIMES)]
_STEPS = [pow(b, _BLOCK, p) for b, p in zip(BASES, PRIMES)]


def squeeze(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def chunk_hash(data: bytes) -> tuple[int, int, int, int]:
    """(h1, h2, s1, s2): the polynomial of ``data`` and the shift B^len, each modulo both primes."""
    n = len(data)
    # Leading zero bytes leave the polynomial as it is; the shift carries the true length.
    padded = np.frombuffer(bytes(-n % _BLOCK) + data, np.uint8).astype(np.uint64).reshape(-1, _BLOCK)
    out = []
    for powers, step, p in zip(_POWERS, _STEPS, PRIMES):
        h = 0
        for part in (padded @ powers % np.uint64(p)).tolist():
            h = (h * step + part) % p
        out.append(h)
    return (*out, *(pow(b, n, p) for b, p in zip(BASES, PRIMES)))


def compose(first: tuple[int, int, int, int], second: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The hash of two adjoining chunks from those of each."""
    h = [(a * s + b) % p for a, b, s, p in zip(first[:2], second[:2], second[2:], PRIMES)]
    return (*h, *(a * b % p for a, b, p in zip(first[2:], second[2:], PRIMES)))


def _fold(k: int) -> Column:
    """``compose`` over the array ``parts`` in order, as a Spark expression."""
    return F.aggregate("parts", F.lit(0).cast("long"),
                       lambda acc, c: (acc * c[f"s{k}"] + c[f"h{k}"]) % F.lit(PRIMES[k - 1]))


def _chunks(chunk_chars: int) -> Column:
    """Numbers of the chunks of a text; an empty text has one."""
    return F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / chunk_chars), F.lit(0)).cast("int"))


def fingerprints(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: doc_id, tkey, uid (tells repeated rows apart), n_chars, digest, fp1, fp2, n_bytes."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = map_rows(
        texts.select("doc_id", text_key().alias("tkey"), F.length("text").cast("long").alias("n_chars"), text_bytes().alias("__body"),
                     (F.length("text") > chunk_chars).alias("long")),
        lambda body, long: _row(body, long), ["__body", "long"], "digest string, n_bytes long, h1 long, h2 long")
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()))
    # Long texts: their chunks go to tasks of their own and are composed in order.
    pieces = (texts.where(F.length("text") > chunk_chars)
              .select("doc_id", text_key().alias("tkey"), "text", F.explode(_chunks(chunk_chars)).alias("no"))
              .select("doc_id", "tkey", "no", F.expr(f"substring(text, no * {chunk_chars} + 1, {chunk_chars})").alias("text"))
              .repartition("doc_id", "tkey", "no"))
    hashed = map_rows(pieces.select("doc_id", "tkey", "no", text_bytes().alias("__body")), lambda b: chunk_hash(squeeze(b)),
                      ["__body"], "h1 long, h2 long, s1 long, s2 long")
    whole = (hashed.dropDuplicates(["doc_id", "tkey", "no"]).groupBy("doc_id", "tkey")
             .agg(F.sort_array(F.collect_list(F.struct("no", "h1", "h2", "s1", "s2"))).alias("parts"))
             .select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), _fold(1).alias("f1"), _fold(2).alias("f2")))
    long = rows.where("h1 is null").join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left")
    return rows.where("h1 is not null").withColumnsRenamed({"h1": "fp1", "h2": "fp2"}).unionByName(
        long.select(*rows.drop("h1", "h2").columns, F.col("f1").alias("fp1"), F.col("f2").alias("fp2")))


def _row(body: bytes, long: bool) -> tuple:
    data = squeeze(body)
    h = (None, None) if long else chunk_hash(data)[:2]
    return (hashlib.sha256(data).hexdigest(), len(data), *h)


def differing(docs: DataFrame, twins: DataFrame, key: list[str], chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The keys of ``twins`` (doc_id, tkey, key) under which some chunk of the squeezed texts differs.

    Chunks of one place are reduced to their least and greatest, first within
    each task: a hot group is never gathered.
    """
    texts = docs.select("doc_id", text_key().alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    ids = twins.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), *key).distinct()
    met = texts.join(ids, texts["doc_id"].eqNullSafe(ids["d"]) & (texts["tkey"] == ids["t"]))
    squeezed = F.translate("text", SPACE.decode(), "")
    parts = (met.select(*key, squeezed.alias("text")).select(*key, "text", F.explode(_chunks(chunk_chars)).alias("no"))
             .select(*key, "no", F.expr(f"substring(text, no * {chunk_chars} + 1, {chunk_chars})").alias("part")))
    spread = parts.groupBy(*key, "no").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return spread.where("low <> high").select(*key).distinct()


def exact_duplicates(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, tkey, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest
    id (null last), then one of the repeated rows. Null texts are empty and all
    texts of white space are equal.
    """
    key = ["fp1", "fp2", "n_bytes"]
    rows = stage(fingerprints(docs, chunk_chars))
    # Written first: a join whose sides both come from a shuffle is one whose hot keys Spark splits.
    sizes = stage(rows.groupBy(*key).count().where("count > 1").drop("count"))
    twins = rows.join(sizes, key, "left_semi")
    mixed = stage(differing(docs, twins, key, chunk_chars).withColumn("mixed", F.lit(True)))
    parted = rows.join(mixed, key, "left").withColumn("part", F.when(F.col("mixed"), F.col("digest")).otherwise(F.lit("")))
    group = [*key, "part"]
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("x"), "doc_id", "uid"))
    heads = stage(parted.groupBy(*group).agg(best.alias("head"), F.count("*").alias("group_size")))
    out = parted.join(heads, group)
    return out.select("doc_id", "tkey", F.col("head.doc_id").alias("keep_id"), "group_size",
                      (F.col("uid") == F.col("head.uid")).alias("kept"), F.col("digest").alias("text_sha256"))
