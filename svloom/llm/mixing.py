"""Mix sources to target weights by hash-threshold histograms.

A document's place in its source is a hash of its doc_id. Words are summed by source and by the top bits
of the hash; the bucket in which a source's budget ends is refined by the next bits, again and again, and
everything below the threshold that results is taken. Two more passes fill what the document at a boundary
left of a budget with smaller ones. No source is sorted, and a hot source is spread over
all its buckets before anything is shuffled.

Defined cases: a null text has size 0; a null source is a source of its own (the last); rows with the same
doc_id share a hash and are taken together; a source of size 0 has target 0; an empty table gives an empty
result; further columns are kept by mix_documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, free_name, small, text_hash

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
HASH_BITS = 60
LEVEL_BITS = 10
PASSES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """A hash of 60 bits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_sources(space: Workspace, sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, weight: by code point, null last; ranks are summed over range partitions."""
    per = space.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    order = [F.col("source").asc_nulls_last()]
    parts = space.save(per.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "source-ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return space.save(parts.join(before, "part").select("source", "source_size", weight.cast("long").alias("weight")), "sources")


def targets(space: Workspace, sources: DataFrame, max_repeats: int) -> DataFrame:
    """Adds target. Each round caps the sources whose share is too large; a round sends one row to the driver."""
    cap = max_repeats * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    free, weight = total, sources.filter("source_size > 0").agg(F.sum("weight")).first()[0] or 0
    capped = 0
    while weight:
        over = (F.col("source_size") > 0) & (F.lit(float(free)) * F.col("weight") / float(weight) > cap)
        row = sources.filter(over).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if row[0] == capped:
            break
        capped, free = row[0], total - row[1]
        weight = (sources.filter("source_size > 0").agg(F.sum("weight")).first()[0]) - row[2]
    share = F.lit(float(free)) * F.col("weight") / F.lit(float(weight or 1))
    full = F.lit(not weight) | (share > cap)
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, cap.cast("double")).otherwise(share)
    return space.save(sources.withColumn("target", target), "targets")


def thresholds(space: Workspace, sizes: DataFrame, budgets: DataFrame, name: str, nearest: bool) -> DataFrame:
    """source, cut, left from budgets (source, budget): documents of sizes with a place below cut are taken.

    Each level sums words by the next LEVEL_BITS bits within the bucket that holds the boundary, for all
    sources at once; a level has at most 2**LEVEL_BITS sums for each source. Only the rows of the boundary buckets
    go on to the next level, which is the last one if no source has more than 2**LEVEL_BITS hash values among them.
    What is taken stays within the budget, or with nearest goes beyond it where that is nearer. left: the budget
    that remains.
    """
    state = space.save(budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("low")), f"{name}-0")
    inside, done = sizes, 0
    while done < HASH_BITS:
        if done:
            edges = small(state).select(F.col("source").alias("s"), "low")
            within = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(1 << (HASH_BITS - done)))
            inside = space.save(inside.join(edges, inside.source.eqNullSafe(edges.s)).filter(within).select("source", "place", "size"), f"{name}-inside{done}")
            values = inside.groupBy("source").agg(F.countDistinct("place").alias("n")).agg(F.max("n")).first()[0] or 0
        last = done + LEVEL_BITS >= HASH_BITS or done and values <= 1 << LEVEL_BITS
        shift = 0 if last else HASH_BITS - done - LEVEL_BITS
        sums = inside.groupBy(F.col("source").alias("s"), F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("upto", F.sum("words").over(run))
        beyond = F.col("upto") > F.col("left")
        edge = (
            state.join(upto, state.source.eqNullSafe(upto.s), "left")
            .groupBy("source", "left", "low")
            .agg(F.min(F.when(beyond, F.struct("bucket", "upto"))).alias("e"), F.coalesce(F.max(F.when(~beyond, F.col("upto"))), F.lit(0)).alias("below"))
        )
        low = F.coalesce(F.shiftleft(F.col("e.bucket"), shift), F.col("low") + F.lit(1 << (HASH_BITS - done)))
        left = F.col("left") - F.col("below")
        if nearest and last:
            # the rows of one hash value are taken together if that brings the sum nearer to the budget
            more = F.col("e").isNotNull() & (F.col("e.upto") - F.col("left") < left)
            low, left = F.when(more, F.col("e.bucket") + 1).otherwise(low), F.when(more, F.col("left") - F.col("e.upto")).otherwise(left)
        done = HASH_BITS if last else done + LEVEL_BITS
        state = space.save(edge.select("source", left.alias("left"), low.alias("low")), f"{name}-{done}")
    return state.withColumnRenamed("low", "cut")


def _fits(k: int) -> Column:
    """Whether pass k looks at a document: its size is within what the pass before left, in the last pass within twice that."""
    return F.lit(True) if k == 0 else F.col("size") <= F.col(f"left{k - 1}") * (2 if k == PASSES - 1 else 1)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS, space: Workspace | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of docs; as mix_rows, without what tells rows apart."""
    return mix_rows(docs, weights, max_repeats, space).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS, space: Workspace | None = None) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies, taken for every row of docs.

    A source's rows are taken floor(target / source_size) times, and those below its thresholds once more.
    The first threshold leaves what the document at the boundary would have exceeded; the next ones look
    among the documents that are not larger than what is left, so the sum comes ever nearer.
    """
    space = space or Workspace(docs.sparkSession, "mix")
    sizes = space.save(docs.select("doc_id", "source", text_hash(F.col("text")).alias("text_hash"), word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")), "sizes")
    sources = targets(space, ranked_sources(space, sizes, weights), max_repeats)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = sources.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * size)
    budgets, rest, cuts = state.select("source", "budget"), sizes, []
    for k in range(PASSES):
        cut = thresholds(space, rest.filter(_fits(k)), budgets, f"pass{k}", nearest=k == PASSES - 1)
        cut = small(cut.select(F.col("source").alias(f"s{k}"), F.col("cut").alias(f"cut{k}"), F.col("left").alias(f"left{k}")))
        cuts.append(cut)
        if k < PASSES - 1:
            untaken = rest.join(cut, rest.source.eqNullSafe(cut[f"s{k}"])).filter(~(_fits(k) & (F.col("place") < F.col(f"cut{k}"))))
            rest = space.save(untaken.select("doc_id", "source", "size", "place", f"left{k}"), f"rest{k}")
            budgets = cut.select(F.col(f"s{k}").alias("source"), F.col(f"left{k}").alias("budget"))
    out, taken = sizes.join(small(state.select(F.col("source").alias("s"), "source_size", "target", "epochs")), sizes.source.eqNullSafe(F.col("s"))), F.lit(False)
    for k, cut in enumerate(cuts):
        out = out.join(cut, out.source.eqNullSafe(cut[f"s{k}"]))
        taken = taken | (_fits(k) & (F.col("place") < F.col(f"cut{k}")))
    copies = F.least(F.col("epochs") + taken.cast("long"), F.lit(max_repeats))
    return out.withColumn("copies", copies).select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with the columns of docs."""
    key = [F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "text_hash")]
    with Workspace(docs.sparkSession, "mix") as space:
        # rows that agree in these three are taken alike: a doc_id may have several texts, and lie in several sources
        copies = mix_rows(docs, weights, max_repeats, space).filter("copies > 0").groupBy(*key).agg(F.max("copies").alias("__copies"))
        copies = small(Workspace(docs.sparkSession, "copies").save(copies, "copies"))
    same = docs["doc_id"].eqNullSafe(copies["__doc_id"]) & docs["source"].eqNullSafe(copies["__source"]) & (text_hash(docs["text"]) == copies["__text_hash"])
    name = free_name(docs, "copy")
    return docs.join(copies, same).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), copies["__copies"])).alias(name)).drop(name)
