"""Near-duplicate lines across documents by a segment-partition edit join.

A line is a text between line feeds without the white space around it; empty lines take no part. Two lines are linked
if their edit distance in code points is at most the allowed edits of the shorter one, 0 below 20 characters, 1 below
40, else MAX_EDITS; or if their edit distance in words is at most the allowed edits of the one with fewer words, 0 below
10 words, 1 below 20, 2 below 40, else MAX_WORD_EDITS. So a word that is replaced, put in or left out in a long
line counts as one edit.

A line with t allowed edits is cut into t + 1 segments, of which a linked line must contain one unchanged, near its
place: lines file their segments under (length, number, hash) and look for the substrings of themselves that could be a
segment of a line as long or up to t shorter, once over code points and once over words. What meets is verified by edit
distance in a band of bits after common ends are cut off. Linked lines form components; the first occurrence (doc_id,
text hash, line number) in a component stays.

Keys are 64-bit hashes. They travel as packed columns, a row for each bucket of keys that a task has met; a task
sorts one bucket at a time and lets only groups with two different lines go on. A key that many lines share is told where
it is met, or where its rows pile up: its rows are spread over all tasks and passed through, and its bucket
gets the smallest and the largest line of each role, which is all that decides whether the group goes on. Groups
are then searched as near-duplicate documents are: every member against the group's smallest, and in blocks
what is still apart, where a task gives out links alone, one for each two components that meet.

Defined cases: null and empty texts have no lines; lines of any length are whole; rows that are equal in
doc_id and text share one fate; a null doc_id sorts first; an empty table gives an empty result; columns
besides doc_id and text are ignored by the search and kept by dedup_lines, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, small, text_hash
from svloom.llm.graph import components
from svloom.llm.hashing import mix, prefix_sums, range_hashes, word_hashes

MAX_EDITS, MAX_WORD_EDITS = 2, 3
#: Below the first bound no edit is allowed, below the second one, and so on.
CHAR_BOUNDS, WORD_BOUNDS = (20, 40), (10, 20, 40)
BLOCK = 2048
BINS = 32
CHUNK_CHARS = 1 << 21
#: Keys of a bucket, about (tens of MB); and buckets that one task sorts, one after the other.
BUCKET_KEYS, TASK_BUCKETS = 1 << 19, 4
#: Bytes of text for each key, about.
BYTES_PER_KEY = 4
#: Rows of one key in what a task packs at once, or among what a bucket holds, from which on they are passed through.
HOT_CHUNK, HOT_BUCKET = 64, 4096
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- edit distance
def within_edits(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether the edit distance of a and b, strings or lists of words, is at most `most`.

    After common ends are cut off, the vertical differences of the dynamic programme are kept as bits of a
    band of 2 * most + 1 rows that moves down with each column; the distance is summed along the diagonal
    on which the last cell lies.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    lo, end = 0, len(a)
    while lo < end and a[lo] == b[lo]:
        lo += 1
    cut = 0
    while cut < end - lo and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[lo : end - cut], b[lo : len(b) - cut]
    gap = len(b) - len(a)
    if not a:
        return gap <= most
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + most)
    mask = (1 << (2 * most + 1)) - 1
    # bit k at column j stands for row j - most + k; rows above the first have no vertical difference
    up, down, distance = mask >> most << most, 0, gap
    for j, c in enumerate(b, 1):
        same = (where.get(c, 0) >> (j - 1)) & mask
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right = (down | ~(diagonal | up)) & mask
        left = diagonal & up
        if j > gap and not diagonal >> (most - gap) & 1:
            distance += 1
            if distance > most:
                return False
        shifted = diagonal >> 1
        up = (left | ~(shifted | right)) & mask
        down = shifted & right
    return distance <= most


def linked(a: str, b: str, most: int = MAX_EDITS, most_words: int = MAX_WORD_EDITS) -> bool:
    """Whether two different lines are near enough, by code points or by words."""
    if within_edits(a, b, int(allowed(np.array(min(len(a), len(b))), CHAR_BOUNDS, most))):
        return True
    x, y = WORD.findall(a), WORD.findall(b)
    return within_edits(x, y, int(allowed(np.array(min(len(x), len(y))), WORD_BOUNDS, most_words)))


# ---------------------------------------------------------------- segments
def allowed(length: np.ndarray, bounds: tuple[int, ...], most: int) -> np.ndarray:
    """Allowed edits of a line of so many symbols."""
    return np.minimum(np.searchsorted(bounds, length, "right"), most)


def segment(length: np.ndarray, t: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of t + 1 even ones; the last ones are longer by one where it does not divide."""
    base, longer = length // (t + 1), length % (t + 1)
    short = t + 1 - longer
    return i * base + np.maximum(0, i - short), base + (i >= short)


def segment_keys(start: np.ndarray, length: np.ndarray, sums: np.ndarray, bounds: tuple[int, ...], most: int, level: int):
    """(line positions, keys, role) arrays of all lines: role 0 for own segments, 1 for substrings looked for."""
    t = allowed(length, bounds, most)
    for i in range(most + 1):
        at = np.flatnonzero((t > 0) & (i <= t))
        s, n = segment(length[at], t[at], i)
        yield at, _key(range_hashes(sums, start[at] + s, start[at] + s + n), length[at], i, level), 0
    for shorter in range(most + 1):
        other = length - shorter
        ot = allowed(other, bounds, most)
        for i in range(most + 1):
            fits = np.flatnonzero((other > 0) & (ot > 0) & (shorter <= ot) & (i <= ot))
            s, n = segment(other[fits], ot[fits], i)
            lo = np.maximum(np.maximum(s - i, s + shorter - (ot[fits] - i)), 0)
            hi = np.minimum(np.minimum(s + i, s + shorter + (ot[fits] - i)), length[fits] - n)
            for k in range(2 * most + 1):
                ok = lo + k <= hi
                if ok.any():
                    at, p = fits[ok], start[fits[ok]] + lo[ok] + k
                    yield at, _key(range_hashes(sums, p, p + n[ok]), other[at], i, level), 1


def _key(h: np.ndarray, length: np.ndarray, i: int, level: int) -> np.ndarray:
    return mix(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1 + (level << 32)))


def keys_of_lines(hashes: np.ndarray, lines: list[str], most: int, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line hash, role) of all segments and substrings of different lines, over code points and over words."""
    length = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(length) - length
    sums = prefix_sums(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32))
    parts = list(segment_keys(start, length, sums, CHAR_BOUNDS, most, 0))
    words, counts = word_hashes([x.encode("utf-8", "surrogatepass") for x in lines])
    counts = counts.astype(np.int64)
    parts += segment_keys(np.cumsum(counts) - counts, counts, prefix_sums(words), WORD_BOUNDS, most_words, 1)
    key = np.concatenate([k.view(np.int64) for _, k, _ in parts])
    h = np.concatenate([hashes[at] for at, _, _ in parts])
    return key, h, np.concatenate([np.full(len(at), role, np.int8) for at, _, role in parts])


def line_of(text: Column) -> Column:
    """The lines of a text, trimmed."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


# ---------------------------------------------------------------- Spark jobs
def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line, h of every line that is not empty."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.posexplode(line_of(F.col("text"))).alias("line_no", "line"))
    return rows.filter("line <> ''").withColumn("h", line_hash(F.col("line")))


#: Marks of a row of segment_groups: a member of a group that goes on, a row of a hot key, a hot key whose group goes on.
MEMBER, HOT_ROW, HOT_KEY = 0, 1, 2
#: Bit of a role: the row stands for further ones of its key that were passed through.
STANDS = 2


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return new, np.diff(np.concatenate([new, [len(key)]]))


def set_apart(key: np.ndarray, h: np.ndarray, role: np.ndarray, hot_from: int):
    """Rows in the order of key, and those of keys with hot_from rows or more: ((key, h, role), hot (key, h, role)).

    Of a hot key the rows with the smallest and the largest line of each role stay and stand for the others.
    """
    order = np.lexsort((h, role & 1, key))
    key, h, role = key[order], h[order], role[order]
    first, size = runs(key)
    hot = np.repeat(size >= hot_from, size)
    if not hot.any():
        return (key, h, role), None
    cut = np.concatenate([[True], (key[1:] != key[:-1]) | (role[1:] & 1 != role[:-1] & 1)])
    edge = hot & (cut | np.concatenate([cut[1:], [True]]))
    apart = (key[hot], h[hot], role[hot] & 1)
    role = np.where(edge, role | STANDS, role).astype(np.int8)
    stay = ~hot | edge
    return (key[stay], h[stay], role[stay]), apart


def segment_groups(docs: DataFrame, most: int, most_words: int, space: Workspace) -> DataFrame:
    """key, h, role of all groups of a key in which two different lines meet, in both roles."""
    lines = occurrences(docs).filter(F.char_length("line") >= CHAR_BOUNDS[0] - 1).select("line", "h")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(TASK_BUCKETS, -(-size // (BYTES_PER_KEY * BUCKET_KEYS)))
    packed = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("lines", pa.binary()), ("roles", pa.binary())])
    marked = pa.schema([("mark", pa.int8()), ("key", pa.int64()), ("h", pa.int64()), ("role", pa.int8())])

    def pack(batches):
        for batch in batches:
            hashes, texts = batch.column(1).to_numpy(), batch.column(0)
            _, first = np.unique(hashes, return_index=True)
            held, size = [], 0
            for k, at in enumerate(first.tolist()):
                text = texts[at].as_py()
                held.append((at, text))
                size += len(text)
                if size >= CHUNK_CHARS or k == len(first) - 1:
                    yield from packs(*keys_of_lines(hashes[[i for i, _ in held]], [x for _, x in held], most, most_words))
                    held, size = [], 0

    def packs(key, h, role):
        if not len(key):
            return
        cold, hot = set_apart(key, h, role, HOT_CHUNK)
        rows = []
        for sign, part in ((1, cold), (-1, hot)):
            if part is None:
                continue
            # rows of hot keys go to buckets below zero by their line, where they are only passed through
            bucket = ((part[0] if sign > 0 else mix(part[1].view(np.uint64)).view(np.int64)).view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            part, bucket = [c[order] for c in part], bucket[order]
            rows += [(sign * (int(bucket[a]) + (sign < 0)), *(c[a : a + n].tobytes() for c in part)) for a, n in zip(*runs(bucket), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), packed.types, strict=True)], schema=packed)

    def sort(batches):
        bucket, held, n = None, [], 0

        def result(mark, key, h, role):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), mark, np.int8)), pa.array(key), pa.array(h), pa.array(role)], schema=marked)

        def groups():
            key, h, role = together()
            order = np.argsort(key, kind="stable")
            key, h, role = key[order], h[order], role[order]
            new, size = runs(key)
            differ = np.minimum.reduceat(h, new) != np.maximum.reduceat(h, new)
            both = np.minimum.reduceat(role & 1, new) != np.maximum.reduceat(role & 1, new)
            keep = np.repeat(differ & both, size)
            yield result(MEMBER, key[keep], h[keep], role[keep] & 1)
            hot = new[differ & both & (np.maximum.reduceat(role, new) >= STANDS)]
            yield result(HOT_KEY, key[hot], h[hot], role[hot] & 1)

        def together():
            return [np.concatenate(c) for c in zip(*held, strict=True)]

        for batch in batches:
            for this, *part in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                part = [np.frombuffer(c.as_buffer(), t) for c, t in zip(part, (np.int64, np.int64, np.int8), strict=True)]
                if this < 0:
                    yield result(HOT_ROW, *part)
                    continue
                if this != bucket:
                    if held:
                        yield from groups()
                    bucket, held, n = this, [], 0
                held.append(part)
                n += len(part[0])
                if n >= 4 * BUCKET_KEYS:
                    cold, hot = set_apart(*together(), HOT_BUCKET)
                    held, n = [cold], len(cold[0]) // 2
                    if hot is not None:
                        yield result(HOT_ROW, *hot)
        if held:
            yield from groups()

    buckets = lines.mapInArrow(pack, "bucket long, keys binary, lines binary, roles binary").repartition(max(1, n_buckets // TASK_BUCKETS), "bucket")
    met = space.save(buckets.sortWithinPartitions("bucket").mapInArrow(sort, "mark byte, key long, h long, role byte"), "met")
    hot = met.filter(F.col("mark") == HOT_ROW).join(small(space.save(met.filter(F.col("mark") == HOT_KEY).select("key").distinct(), "hot-keys")), "key", "left_semi")
    return met.filter(F.col("mark") == MEMBER).select("key", "h", "role").unionByName(hot.select("key", "h", "role")).distinct()


def confirm_lines(pairs: DataFrame, lines: DataFrame, most: int, most_words: int) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines are linked."""
    rows = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(lines.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")

    def check(batches):
        for batch in batches:
            keep = [linked(x, y, most, most_words) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return rows.select("a", "b", "line_a", "line_b").mapInArrow(check, "a long, b long")


def bins(line: str) -> np.ndarray:
    """Counts of code points, then of words, by their value modulo BINS: an edit changes its half by 2 in sum at most."""
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BINS for w in WORD.findall(line)], np.int64)
    return np.concatenate([np.bincount(chars, minlength=BINS), np.bincount(words, minlength=BINS)]).astype(np.int32)


def link_groups(members: DataFrame, most: int, most_words: int) -> DataFrame:
    """Confirmed links (a, b) within groups, enough to join every two components that have one.

    members: key, n, h, component, leader, line. Groups are dealt out in pairs of blocks of about BLOCK rows; lines whose
    counts are near enough are compared, and components that were joined in a task are not compared again in it.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("h"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h", "component", "leader", "line").distinct()

    def found(key, rows):
        if len(rows) < 2:
            return
        counts = np.stack([bins(r[4]) for r in rows])
        own, h, component, leader = (np.array([r[k] for r in rows]) for k in range(4))
        leads = h == leader
        root: dict[int, int] = {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        for x in range(len(rows) - 1):
            fits = (component[x + 1 :] != component[x]) & ~leads[x + 1 :] & ~leads[x]
            if key[1] != key[2]:
                fits &= own[x + 1 :] != own[x]
            at = np.flatnonzero(fits) + x + 1
            off = np.abs(counts[at] - counts[x]).reshape(-1, 2, BINS).sum(2)
            for y in at[(off[:, 0] <= 2 * most) | (off[:, 1] <= 2 * most_words)].tolist():
                a, b = top(int(component[x])), top(int(component[y]))
                if a != b and linked(rows[x][4], rows[y][4], most, most_words):
                    root[max(a, b)] = min(a, b)
                    yield min(h[x], h[y]), max(h[x], h[y])

    def search(batches):
        key, rows, out = None, [], []

        def result():
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(map(int, a), pa.int64()), pa.array(map(int, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for this, *row in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
                if this != key:
                    out += found(key, rows)
                    key, rows = this, []
                rows.append(row)
            if len(out) >= 10_000:
                yield result()
                out = []
        out += found(key, rows)
        yield result()

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h")
    return ordered.mapInArrow(search, "a long, b long").distinct()


def line_components(space: Workspace, docs: DataFrame, most: int, most_words: int) -> DataFrame:
    """h, component (the smallest line hash) of every line that is linked with another."""
    groups = space.save(segment_groups(docs, most, most_words, space), "groups")
    sizes = small(space.save(groups.groupBy("key").agg(F.min("h").alias("leader"), F.countDistinct("h").alias("n")), "sizes"))
    members = space.save(groups.join(sizes, "key").select("key", "n", "leader", "h").distinct(), "members")
    space.drop(groups)
    wanted = small(space.save(members.select("h").distinct(), "wanted"))
    lines = space.save(occurrences(docs).select("h", "line").join(wanted, "h", "left_semi").dropDuplicates(["h"]), "lines")
    stars = members.filter("h <> leader").select(F.col("leader").alias("a"), F.col("h").alias("b")).distinct()
    links = space.save(confirm_lines(stars, lines, most, most_words), "star-links")
    comp = components(space, links.toDF("u", "v"))
    placed = members.filter("n > 2").join(comp, F.col("h") == F.col("node"), "left").withColumn("component", F.coalesce("component", "h")).drop("node")
    placed = space.save(placed, "placed")
    open_keys = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("several")).filter("several").select("key")
    rest = placed.join(small(space.save(open_keys, "open-keys")), "key", "left_semi").join(lines, "h")
    more = space.save(link_groups(rest, most, most_words), "more-links")
    comp = components(space, comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.toDF("u", "v")))
    nodes = comp.select(F.col("node").alias("h"), "component").union(comp.select(F.col("component").alias("h"), "component"))
    return space.save(nodes.distinct(), "components")


def judge_lines(docs: DataFrame, most: int = MAX_EDITS, most_words: int = MAX_WORD_EDITS, space: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, text_hash, line_no, h, n_chars), and those to drop (also near: the component has other lines too)."""
    space = space or Workspace(docs.sparkSession, "linedup")
    of_line = line_components(space, docs, most, most_words)
    lines = space.save(occurrences(docs).select("doc_id", "text_hash", "line_no", "h", F.char_length("line").alias("n_chars")).distinct(), "occurrences")
    repeated = lines.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    affected = repeated.join(of_line, "h", "full").select("h", F.coalesce("component", "h").alias("component"), F.col("component").isNotNull().alias("near"))
    at = space.save(lines.join(small(space.save(affected, "affected")), "h"), "occurrences-affected")
    first = at.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first"))
    first = space.save(first.select(F.col("component").alias("__c"), F.col("first.doc_id").alias("__d"), F.col("first.text_hash").alias("__t"), F.col("first.line_no").alias("__l")), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")) & (F.col("line_no") == F.col("__l"))
    return lines, at.join(small(first), F.col("component") == F.col("__c")).filter(~stays).select("doc_id", "text_hash", "line_no", "n_chars", "near")


def line_report(docs: DataFrame, most: int = MAX_EDITS, most_words: int = MAX_WORD_EDITS, space: Workspace | None = None) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, n_near (dropped from components with other lines), kept_chars."""
    lines, gone = judge_lines(docs, most, most_words, space)
    key = ["doc_id", "text_hash"]
    per = lines.select(*key, F.lit(1).alias("line"), F.lit(0).alias("drop"), F.lit(0).alias("near"), "n_chars")
    per = per.union(gone.select(*key, F.lit(0), F.lit(1), F.col("near").cast("int"), -F.col("n_chars")))
    blank = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).distinct()
    sums = per.union(blank).groupBy(*key).agg(*[F.sum(c).alias(n) for c, n in (("line", "n_lines"), ("drop", "n_dropped"), ("near", "n_near"), ("n_chars", "kept_chars"))])
    return sums.select("doc_id", "n_lines", "n_dropped", "n_near", "kept_chars")


def dedup_lines(docs: DataFrame, most: int = MAX_EDITS, most_words: int = MAX_WORD_EDITS) -> DataFrame:
    """docs with the dropped lines taken out of text; texts that lose no line stay as they are."""
    _, gone = judge_lines(docs, most, most_words)
    per = gone.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(per, docs["doc_id"].eqNullSafe(per["__id"]) & (text_hash(docs["text"]) == per["__hash"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda _, i: ~F.array_contains(per["__gone"], i)), "\n")
    text = F.when(per["__gone"].isNull(), docs["text"]).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else docs[c] for c in docs.columns])
