"""Importance resampling towards a target distribution by bit-sliced aggregation.

Features (runs of words) fall into buckets by their crc32. A document's bucket counts are written as bit planes: plane k
has a bit for each bucket, set where bit k of the count is set. A bucket's gain, the log ratio of its share in the target
to that in the corpus, is cut into planes as well, in two's complement. A document's sum of gains is then exact by
ANDs and popcounts: sum of 2**k * (+/-)2**j * popcount(count plane k & gain plane j). Texts are read once; corpus and target
counts are sums over planes, one row for each bucket and task.

Documents are drawn by Gumbel top-k: the lowest score drawn comes from a histogram of scores (whole numbers within
the range of two logarithms of the input's size), and only the rows from it on are sorted, by ranges.

Defined cases: null and empty texts have no features, weight 0, and are never drawn, as are texts of fewer words than
min_words; texts of any length are read whole; rows that repeat are documents of their own; equal scores are ordered by doc_id
(null last), then by the text's hash, so only equal rows tie; a null doc_id draws its number as an empty one; an empty table gives an empty
result, an empty target draws by what is rare in the corpus; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, small, text_hash

BUCKETS, MAX_RUN, MIN_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024
#: Features that a worker keeps the bucket of (about 100 bytes each).
CACHE = 500_000
#: Planes that are multiplied with those of the gains at once.
BLOCK = 256
#: Bytes to words: digits, letters (A-Z lower-cased) and all bytes of other characters stay.
WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PLANES = "doc_id {}, text_hash long, n_words long, n_features long, planes binary"


class Buckets(dict):
    """Bucket of a feature, kept for the first CACHE different ones."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(self) < CACHE:
            self[feature] = bucket
        return bucket


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes, lower-cased A-Z alone."""
    return text.translate(WORD_BYTES).split()


def bit_planes(counts: np.ndarray) -> np.ndarray:
    """Plane k (a row of bytes, whole 64-bit units) has bit k of every count; none for counts of 0."""
    levels = int(counts.max(initial=0)).bit_length()
    bits = np.zeros((levels, -(-len(counts) // 64) * 64), np.uint8)
    bits[:, : len(counts)] = (counts[None, :] >> np.arange(levels)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little")


def signed_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of signed numbers in two's complement (rows of 64-bit units) and the power of two of each, the last one negative."""
    width = int(max(values.max(initial=0), -values.min(initial=0))).bit_length() + 1
    planes = bit_planes(np.append(values & ((1 << width) - 1), (1 << width) - 1))  # the last one makes all planes
    units = -(-len(values) // 64)
    planes = np.ascontiguousarray(planes).view(np.uint64)[:, :units].copy()
    if len(values) % 64:
        planes[:, -1] &= np.uint64((1 << len(values) % 64) - 1)
    powers = 1 << np.arange(width, dtype=np.int64)
    powers[-1] *= -1
    return planes, powers


def weighted_sums(planes: np.ndarray, gains: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """For each row of count planes the sum of the gains of its bits."""
    out = np.zeros(len(planes), np.int64)
    for k in range(0, len(planes), BLOCK):
        part = planes[k : k + BLOCK]
        out[k : k + BLOCK] = np.bitwise_count(part[:, None, :] & gains[None]).sum(2, dtype=np.int64) @ powers
    return out


def sliced(docs: DataFrame, id_column: str, n_buckets: int, max_run: int) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, planes for every row of docs."""

    def slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(n_buckets).__getitem__
        for batch in batches:
            n_words, n_features, planes = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                counts, n = np.bincount(np.fromiter(map(bucket, words), np.int64, len(words)), minlength=n_buckets), len(words)
                for k in range(2, min(max_run, len(words)) + 1):
                    runs = len(words) - k + 1
                    counts += np.bincount(np.fromiter((bucket(b" ".join(words[i : i + k])) for i in range(runs)), np.int64, runs), minlength=n_buckets)
                    n += runs
                n_words.append(len(words))
                n_features.append(n)
                planes.append(bit_planes(counts).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(planes, pa.binary())], names=["doc_id", "text_hash", "n_words", "n_features", "planes"])

    rows = docs.select(F.col(id_column).alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(slice_rows, PLANES.format(docs.schema[id_column].dataType.simpleString()))


def bucket_counts(sliced_rows: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, n: how many features of all rows are in it."""

    def sum_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = np.zeros(n_buckets, np.int64), -(-n_buckets // 64) * 8
        for batch in batches:
            for text in batch.column(0):
                planes = np.frombuffer(text.as_py(), np.uint8).reshape(-1, width)
                for k, plane in enumerate(np.unpackbits(planes, axis=1, count=n_buckets, bitorder="little")):
                    total += plane.astype(np.int64) << k
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return sliced_rows.select("planes").mapInArrow(sum_planes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for each bucket. At most n_buckets rows of each come to the driver."""
    s, t = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for row in counts.collect():
            into[row.bucket] = row.n
    all_s, all_t = float(s.sum() + n_buckets), float(t.sum() + n_buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def with_weights(sliced_rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """Adds weight, the floored mean gain of a row's features, in place of its planes."""
    planes, powers = signed_planes(gains)
    width = planes.shape[1]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, width) for x in batch.column(4)]
            levels = np.array([len(x) for x in parts], np.int64)
            first = np.cumsum(levels) - levels
            sums = weighted_sums(np.concatenate(parts), planes, powers) if parts else np.zeros(0, np.int64)
            nth = np.arange(len(sums)) - np.repeat(first, levels)
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sums << nth)])
            n = batch.column(3).to_numpy()
            weight = (upto[first + levels] - upto[first]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(weight, pa.int64())], names=["doc_id", "text_hash", "n_words", "n_features", "weight"])

    kind = sliced_rows.schema["doc_id"].dataType.simpleString()
    return sliced_rows.mapInArrow(weigh, PLANES.format(kind).replace("planes binary", "weight long"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A whole number from the Gumbel distribution, in thousandths, from the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(space: Workspace, rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank from 1 in the order. Rows are sorted by ranges; where a range begins is a sum over one row a range."""
    at = space.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    starts = small(space.save(starts, "range-starts"))
    out = at.withColumn("part", part).join(starts, "part")
    return out.withColumn("rank", F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, max_run: int = MAX_RUN, space: Workspace | None = None) -> DataFrame:
    """doc_id, text_hash, n_features, weight, score, rank for every row of docs; rank is null for those that are not drawn.

    target has text. floor(share percent) of the rows with at least min_words words are drawn.
    """
    space = space or Workspace(docs.sparkSession, "resample")
    rows = space.save(sliced(docs, "doc_id", n_buckets, max_run), "planes")
    aim = sliced(target.select(F.lit(0).alias("doc_id"), "text"), "doc_id", n_buckets, max_run)
    gains = bucket_gains(bucket_counts(rows, n_buckets), bucket_counts(aim, n_buckets), n_buckets)
    scored = space.save(with_weights(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")

    fit = F.col("n_words") >= min_words
    per_score = space.save(scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    n = share * (per_score.agg(F.sum("n")).first()[0] or 0) // 100
    # as many rows as there are different scores, some ten thousands whatever the input's size
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    least = per_score.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < n).agg(F.min("score")).first()[0]

    inside = fit & (F.col("score") >= least) if least is not None else F.lit(False)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    drawn = ranked(space, scored.filter(inside), order).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    out = drawn.unionByName(scored.filter(~inside).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "text_hash", "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are drawn, with their columns; rows with equal doc_id and text go together."""
    drawn = resample(docs, target, **settings).filter("rank is not null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["__id"]) & (text_hash(docs["text"]) == drawn["__hash"]), "left_semi")
