"""Near-duplicate documents by MinHash.

1. Each text gives its shingle set's size, a 128-bit digest, HASHES universal hash minima (16 bits each) and
   one key for each of BANDS bands of them.
2. Documents with equal sets are one class; only its smallest document goes on.
3. In every bucket of a band, members are compared with the bucket's smallest document: first the
   signatures, then the full sets of the texts. Confirmed links give components.
4. Buckets that still hold several components are searched in full. Members are dealt out in pairs of blocks with
   their signatures alone; a task tells which members have a counterpart of another component whose signature
   passes. Only these bring their texts to a second task of the same pair of blocks, which confirms on full sets and
   gives out links alone, one for each two components that meet. So no link that a band shows is lost, no task gives
   out more rows than it reads, and a bucket of copies, which is one component by then, costs nothing.
5. Components by alternating large-star and small-star.

A similarity at the threshold shares no band with probability (1 - s**ROWS)**BANDS, 7e-7 at 0.85 and 7e-5
at 0.8, and fails the signature test (4 standard deviations below) with 3e-5.

Defined cases: null texts and texts without words have an empty set and link with nothing; a text of fewer
words than a shingle has one shingle of all its words; equal rows are one document; rows of one doc_id with
different sets are documents of their own, linked only if they are similar; a row with null doc_id links with nothing,
has a null component and is kept; very long texts are whole; an empty table gives an empty result; columns besides
doc_id and text are ignored by the search and kept by deduplicate, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, free_name, small, text_hash
from svloom.llm.graph import components
from svloom.llm.hashing import mix, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: Members of a block of a bucket; a bucket of n gives out each member ceil(n / BLOCK) times.
BLOCK = 2048
CHUNK_BYTES = 1 << 22
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash (a x + b mod 2**64, upper 32 bits) over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        part = _A[:, None] * hashes[None, k : k + 2048]
        part += _B[:, None]
        np.minimum(least, part.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, from its number and its minima as the signature has them."""
    rows = least.astype(np.uint16).astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return h.view(np.int64)


def batches_of_sets(batch: pa.RecordBatch, column: int, k: int):
    """(first row, shingle sets of the rows after it), a bounded number of bytes at a time."""
    texts, size, first = [], 0, 0
    for i, text in enumerate(batch.column(column).cast(pa.binary())):
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield first, _sets(texts, k)
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, _sets(texts, k)


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [shingles(words[e - c : e], k) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1, d2 (digest), signature, keys for every row of docs."""

    def sketch(batches):
        for batch in batches:
            ids, n, d1, d2, signatures, keys = batch.column(0), [], [], [], [], []
            for _, sets in batches_of_sets(batch, 1, k):
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        d1.append(0), d2.append(0), signatures.append(None), keys.append(None)
                        continue
                    least = minima(s)
                    d1.append(int(s.sum().view(np.int64)))
                    d2.append(int(mix(s).sum().view(np.int64)))
                    signatures.append(least.astype("<u2").tobytes())
                    keys.append(band_keys(least))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "signature", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"))
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, signature binary, keys array<long>")


def _agree(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(a), "<u2").reshape(-1, HASHES)
    return (x == np.frombuffer(b"".join(b), "<u2").reshape(-1, HASHES)).sum(1)


def least_agreement(similarity: float) -> int:
    """Equal minima that a pair of this similarity has, less 4 standard deviations."""
    return max(1, math.ceil(HASHES * (similarity - 4 * math.sqrt(similarity * (1 - similarity) / HASHES))))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts (rep, text) whose full shingle sets are similar enough.

    The ratio is compared in whole hundredths. Pairs come sorted by a, whose set is made once in a row.
    """
    hundredths = round(similarity * 100)
    rows = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        last, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for first, sets in batches_of_sets(batch, 3, k):
                for i, other in enumerate(sets, first):
                    if last != a[i]:
                        last, own = a[i], _sets([batch.column(2)[i].as_py().encode()], k)[0]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * common >= hundredths * (len(own) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], names=["a", "b"])

    return rows.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(check, "a long, b long")


def agreeing(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least so many places."""
    rows = pairs.join(signatures.select(F.col("rep").alias("a"), F.col("signature").alias("s")), "a").join(signatures.select(F.col("rep").alias("b"), F.col("signature").alias("t")), "b")

    def check(batches):
        for batch in batches:
            mask = pa.array(_agree(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return rows.select("a", "b", "s", "t").mapInArrow(check, "a long, b long")


def _by_group(batches, work, names: list[str]):
    """Arrow batches of whole numbers that work(key, rows) yields for each run of rows with equal first three columns."""
    key, rows, out = None, [], []

    def result():
        return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in range(len(names))], names=names)

    for batch in batches:
        for this, *row in zip(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True), *(c.to_pylist() for c in batch.columns[3:]), strict=True):
            if this != key:
                out += work(key, rows)
                key, rows = this, []
            rows.append(row)
        if len(out) >= 10_000:
            yield result()
            out = []
    out += work(key, rows)
    yield result()


class Group:
    """The members of a pair of blocks of a bucket: own block, rep, component, leads, signature, in the order of rep."""

    def __init__(self, key: tuple, rows: list, least: int):
        self.crossed, self.least = key[1] != key[2], least
        self.own, self.rep, self.component, self.leads = (np.array([r[k] for r in rows]) for k in range(4))
        self.signature = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(-1, HASHES)
        bands = np.stack([band_keys(s) for s in self.signature])
        #: keys of the bands before the bucket's own: a pair that shares one is left to that bucket
        self.before = bands[:, : int(np.flatnonzero(bands[0] == key[0])[0])]

    def counterparts(self, x: int) -> np.ndarray:
        """The later members that x may be linked with: of another component and, between two blocks, of the other block.

        Pairs with the leader were compared before.
        """
        at = slice(x + 1, None)
        fits = (self.component[at] != self.component[x]) & ~self.leads[at]
        if self.leads[x] or not fits.any():
            return np.zeros(0, np.int64)
        if self.crossed:
            fits &= self.own[at] != self.own[x]
        at = np.flatnonzero(fits) + x + 1
        at = at[(self.signature[at] == self.signature[x]).sum(1) >= self.least]
        return at[~(self.before[at] == self.before[x]).any(1)]


def candidates(members: DataFrame, least: int) -> DataFrame:
    """key, i, j, own, rep of members that have a counterpart in a pair of blocks (i, j) of their bucket.

    members: key, n, rep, component, leader, signature. Each pair of blocks of about BLOCK rows is one group.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", (F.col("rep") == F.col("leader")).alias("leads"), "signature")

    def found(key, rows):
        if len(rows) < 2:
            return
        group, hit = Group(key, rows, least), set()
        for x in range(len(rows) - 1):
            at = group.counterparts(x)
            if len(at):
                hit.add(x)
                hit.update(at.tolist())
        for x in sorted(hit):
            yield *key, group.own[x], group.rep[x]

    names = ["key", "i", "j", "own", "rep"]
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return ordered.mapInArrow(lambda batches: _by_group(batches, found, names), "key long, i long, j long, own long, rep long")


def link_candidates(rows: DataFrame, least: int, k: int, similarity: float) -> DataFrame:
    """Confirmed links (a, b) within groups, enough to join every two components that have one.

    rows: key, i, j, own, rep, component, leads, signature, text. Components that were joined in a task are not
    compared again in it.
    """
    hundredths = round(similarity * 100)

    def found(key, rows):
        if len(rows) < 2:
            return
        group, sets = Group(key, rows, least), {}
        root: dict[int, int] = {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        def set_of(x):
            if x not in sets:
                sets[x] = _sets([rows[x][5].encode()], k)[0]
            return sets[x]

        for x in range(len(rows) - 1):
            for y in group.counterparts(x).tolist():
                a, b = top(int(group.component[x])), top(int(group.component[y]))
                if a == b:
                    continue
                one, other = set_of(x), set_of(y)
                common = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * common >= hundredths * (len(one) + len(other) - common):
                    root[max(a, b)] = min(a, b)
                    yield group.rep[x], group.rep[y]

    ordered = rows.select("key", "i", "j", "own", "rep", "component", "leads", "signature", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return ordered.mapInArrow(lambda batches: _by_group(batches, found, ["a", "b"]), "a long, b long").distinct()


#: Nodes of further sets of one doc_id lie above all others.
FURTHER = 1 << 62


def with_nodes(space: Workspace, rows: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """rows with `node`: the doc_id, or a number above FURTHER for a set beyond the first of its doc_id.

    Also the table node, doc_id of the latter, if there are any, and whether a doc_id repeats at all.
    """
    digest = F.struct("n_shingles", "d1", "d2")
    spans = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(digest).alias("first"), F.max(digest).alias("last"), F.count("*").alias("n")).filter("n > 1")
    spans = space.save(spans, "repeated-ids")
    several = spans.filter("first <> last").select("id", "first")
    if several.isEmpty():
        return rows.withColumn("node", F.col("doc_id")), None, not spans.isEmpty()
    joined = rows.join(small(several), F.col("doc_id") == F.col("id"), "left")
    other = F.lit(FURTHER) + F.shiftrightunsigned(F.xxhash64("doc_id", "n_shingles", "d1", "d2"), 3)
    out = joined.withColumn("node", F.when(F.col("id").isNotNull() & (digest != F.col("first")), other).otherwise(F.col("doc_id"))).drop("id", "first")
    return out, space.save(out.filter(F.col("node") >= FURTHER).select("node", "doc_id").distinct(), "further"), True


def classify(docs: DataFrame, space: Workspace, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, text_hash, n_shingles, node, component (a node) for every row of docs, and the nodes that are no doc_id."""
    rows = space.save(sketches(docs, shingle), "sketches")
    rows, further, repeats = with_nodes(space, rows)
    digest = ["n_shingles", "d1", "d2"]
    solid = rows.filter("doc_id is not null and n_shingles > 0")
    classes = space.save(solid.groupBy(*digest).agg(F.min("node").alias("rep"), F.count("*").alias("copies")), "classes")
    of_class = [F.col(c) == F.col(f"c_{c}") for c in digest]
    copied = classes.filter("copies > 1").select(*[F.col(c).alias(f"c_{c}") for c in digest], "rep")
    same = solid.join(copied, of_class).filter("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v")).distinct()
    links = [space.save(same, "copies")]

    heads = solid.join(classes.select(*[F.col(c).alias(f"c_{c}") for c in digest], "rep"), of_class).filter("node = rep")
    heads = space.save(heads.groupBy("rep").agg(F.min(F.struct("signature", "keys", "doc_id", "text_hash")).alias("h")).select("rep", "h.*"), "heads")
    signatures = heads.select("rep", "signature")
    banded = heads.select("rep", F.explode("keys").alias("key"))
    buckets = space.save(banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = space.save(banded.join(small(buckets), "key"), "members")
    least = least_agreement(similarity)
    stars = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = space.save(agreeing(stars, signatures, least), "stars")

    wanted = heads.join(small(space.save(members.select("rep").distinct(), "wanted")), "rep", "left_semi").select("rep", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("hash"), "text")
    texts = texts.join(small(space.save(wanted, "wanted-texts")), ["id", "hash"]).select("rep", "text")
    texts = space.save(texts.groupBy("rep").agg(F.min("text").alias("text")) if repeats else texts, "texts")
    links.append(space.save(confirm(stars, texts, shingle, similarity), "star-links"))
    comp = components(space, _edges(links))

    placed = members.join(comp, F.col("rep") == F.col("node"), "left").select("key", "n", "leader", "rep", F.coalesce("component", "rep").alias("component"))
    placed = space.save(placed.filter("n > 2"), "placed")
    open_keys = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("several")).filter("several").select("key")
    rest = space.save(placed.join(small(space.save(open_keys, "open-keys")), "key", "left_semi").join(signatures, "rep"), "open")
    chosen = space.save(candidates(rest, least), "candidates")
    rows_of = rest.select("key", "rep", "component", (F.col("rep") == F.col("leader")).alias("leads"), "signature")
    more = space.save(link_candidates(chosen.join(rows_of, ["key", "rep"]).join(texts, "rep"), least, shingle, similarity), "more-links")
    comp = components(space, _edges([comp.select(F.col("node").alias("u"), F.col("component").alias("v")), more]))
    for done in (classes, heads, buckets, members, stars, texts, placed, rest, chosen, more, *links):
        space.drop(done)
    comp = comp.select(F.col("node").alias("linked"), "component")
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(comp, F.col("node") == F.col("linked"), "left")
    return out.select("doc_id", "text_hash", "n_shingles", "node", F.coalesce("component", "node").alias("component")), further


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, space: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    found, further = classify(docs, space or Workspace(docs.sparkSession, "neardup"), shingle, similarity)
    component = F.col("component")
    if further is not None:
        found = found.join(further.select(F.col("node").alias("component"), F.col("doc_id").alias("of")), "component", "left")
        component = F.coalesce("of", "component")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _edges(links: list[DataFrame]) -> DataFrame:
    edges = None
    for x in links:
        x = x.toDF("u", "v")
        edges = x if edges is None else edges.union(x)
    return edges


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates: the rows of docs that are kept.

    A row is known by its doc_id and its text's hash. Of several rows of the document that is kept, the one stays
    whose text, then whose columns all together, hash to the smallest number. Rows with a null doc_id all stay.
    """
    keep = Workspace(docs.sparkSession, "dedup")
    with Workspace(docs.sparkSession, "neardup") as space:
        found, _ = classify(docs, space, shingle, similarity)
        found = space.save(found.filter("doc_id is not null"), "found")
        per = found.groupBy("node").agg(F.count("*").alias("n"), F.min("text_hash").alias("stays"), F.max("text_hash").alias("last"), F.max("component").alias("c"))
        per = space.save(per.filter("node <> c or n > 1").select(F.col("node").alias("of"), "n", F.when(F.col("of") == F.col("c"), F.col("stays")).alias("stays")), "nodes")
        touched = found.join(small(per), F.col("node") == F.col("of"))
        gone = touched.filter("stays is null or text_hash <> stays").select("doc_id", "text_hash", F.lit(True).alias("gone"))
        repeated = touched.filter("text_hash = stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id", "text_hash", F.lit(False).alias("gone"))
        apart = keep.save(gone.union(repeated).distinct().select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone")), "apart")

    def same(rows: DataFrame):
        return docs["doc_id"].eqNullSafe(rows["__id"]) & (text_hash(docs["text"]) == rows["__hash"])

    near, repeated = small(apart), apart.filter("not __gone")
    single = docs.join(near, same(near), "left_anti")
    if repeated.isEmpty():
        return single
    name = free_name(docs, "row")
    order = Window.partitionBy("doc_id", text_hash(F.col("text"))).orderBy(F.xxhash64(*docs.columns))
    repeated = small(repeated)
    first = docs.join(repeated, same(repeated), "left_semi").withColumn(name, F.row_number().over(order)).filter(F.col(name) == 1).drop(name)
    return single.unionByName(first)
