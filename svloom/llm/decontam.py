"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Texts become templates: numbers, in figures or in English words (from two on), the units after them, and names
(capitalised words but for function words) turn into typed placeholders, other words are lower-cased, punctuation goes.
A name of several words, and a number of several, is one placeholder. Windows of WINDOW template tokens
of documents are hash-joined with those of the benchmark. For the few pairs that meet, the values that the
placeholders stand for are compared: along one alignment of document and item, each value of the item must
stand for one value of the document, and each name or unit of the document for one of the item; two different numbers
may become equal ones, as new parameters do. An item is found in a document if the windows that pass cover at
least COVERAGE of its windows, so exact copies and copies with other numbers, units or names are caught, or
if windows that pass along one alignment cover RUN tokens on end, so that a long passage of a longer item is
caught as well. An item of fewer than WINDOW tokens is one window as a whole.

A second set of windows has the tokens as they stand, in lower case and without placeholders, so that copies
in other case, in which names are told from words no more, are caught. An item is found if either set passes.

Windows with fewer than MIN_WORDS plain words are too unspecific to count. An item that has no others, such as a sum
in figures, is found where all its windows are, as they stand.

Pairs of document and item are told from anchors first: those of an item's windows that fewest items share, so many
that a pair that passes has one of them. Windows that many items share, such as instructions, so make no pairs.

Defined cases: null and empty texts have no windows; an item of fewer than MIN_WORDS tokens matches nothing; a null
item_id is kept as null; rows that repeat give the same pair once; documents are known by doc_id and text together; an empty
table on either side gives no pair; columns besides doc_id, text and item_id are ignored by the search and
kept by drop_contaminated, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import BROADCAST_ROWS, Workspace, small, text_hash

WINDOW, MIN_WORDS, COVERAGE = 5, 3, 0.5
#: So many tokens on end along one alignment are a passage of an item, whatever the share of the item.
RUN = 13
#: The units that are recognised after a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg lb lbs oz t ml cl dl l gal ms s sec secs min mins h hr hrs hour hours day days week weeks month months year years minute minutes second seconds meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars cent cents euro euros degree degrees percent watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb mph kmh"
#: Groups that repeat do so possessively (nothing stands after them, so they match the same): Java's matcher recurses for every
#: round of others, and a text of a few thousand capitalised words, number words or groups of figures on end overflows its stack.
FIGURES = r"\p{N}+(?:[.,]\p{N}+)*+"
TOKEN = rf"{FIGURES}|[\p{{L}}\p{{M}}]+"
#: English number words in order, from two on; one is a word of its own but beside another number word.
SMALL = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "hundred thousand million billion".split()
#: The figures of number words below a hundred, so that a value may be written either way.
VALUES = {w: str(k) for k, w in enumerate(SMALL, 2)} | {w: str(10 * k) for k, w in enumerate(TENS, 2)}
VALUES |= {f"{t}{gap}{w}": str(10 * k + n) for k, t in enumerate(TENS, 2) for gap in " -" for n, w in enumerate(["one", *SMALL[:8]], 1)}
#: The longest word first, as an alternation takes the first that fits.
_WORD = "|".join(sorted([*SMALL, *TENS, *SCALES], key=lambda w: (-len(w), w)))
_END = r"(?![\p{L}\p{M}])"
NUMBER = (
    rf"{FIGURES}|(?=[bfhmnoste])(?<![\p{{L}}\p{{M}}])(?:one[\x20\-](?=(?:{'|'.join(SCALES)}){_END}))?(?:{_WORD}){_END}"
    rf"(?:(?:(?<=hundred|thousand|million|billion)\x20and\x20|[\x20\-])(?:{_WORD}|one){_END})*+"
)
#: Function words that begin sentences and are no names (English, German, French, Spanish).
FUNCTION_WORDS = "a about after all also an and any are as at because before but by can could did do does during each every few find first for from give given had has have he her here his how i if in into is it its let many may more most much must my no not of on one only or other our over please several she should since so some suppose than that the their then there these they this those through to two under until up was we what when where whether which while who whom whose why will with would you your aber als am auf aus bei das dass dem den der des die doch ein eine einen einer er es für hat hier ich ihr im ist man mit nach nicht noch nun nur ob oder sein seine sich sie sind um und unter uns viele von vor wann war wenn wer wie wir wird wo zu zum zur au aux avec ce ces cette comme dans de deux donc du elle elles en est et il ils je la le les leur lorsque mais ne nous où par pas pour quand que quel quelle qui sa sans se ses si son sont sous sur un une vous al algunos como con cuando cual cuánto del desde dos el ella ellos entre esta este esto están hay las lo los más muchos nos o para pero por qué quién ser sin sobre su sus también todos una unos y ya"
#: A capital letter is looked for first, as most places have none.
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}])(?!(?:{'|'.join(sorted(map(str.capitalize, [*FUNCTION_WORDS.split(), *SMALL, *TENS, *SCALES]), key=lambda w: (-len(w), w)))})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?![\p{{L}}\p{{M}}])"
NAME = rf"{_NAME}(?:[\x20\-]{_NAME})*+"
#: Placeholders are single letters of the private use area, which no word contains.
NUM, UNI, NAM = "\ue000", "\ue001", "\ue002"
#: A unit is a whole word after a number.
UNIT = rf"{NUM}([\x20 \-]?)(?:{'|'.join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{M}}])"


def _clean(text: Column) -> Column:
    return F.translate(text, NUM + UNI + NAM, "   ")


def raw_tokens(text: Column) -> Column:
    """The tokens of the template as they stand, names and numbers of several words whole."""
    return F.regexp_extract_all(_clean(text), F.lit(rf"{NAME}|(?i:{NUMBER})|[\p{{L}}\p{{M}}]+"), F.lit(0))


def template_tokens(text: Column) -> Column:
    """The tokens of the template; as many as raw_tokens has."""
    marked = F.lower(F.regexp_replace(_clean(text), NAME, NAM))
    marked = F.regexp_replace(marked, NUMBER, NUM)
    marked = F.regexp_replace(marked, UNIT, f"{NUM}$1{UNI}")
    return F.regexp_extract_all(marked, F.lit(rf"[{NUM}{UNI}{NAM}]|[\p{{L}}\p{{M}}]+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Words and figures as they stand, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def plain_kinds(text: Column) -> Column:
    """plain_tokens with placeholders for figures and the units after them."""
    marked = F.regexp_replace(F.lower(_clean(text)), FIGURES, NUM)
    return F.regexp_extract_all(F.regexp_replace(marked, UNIT, f"{NUM}$1{UNI}"), F.lit(rf"[{NUM}{UNI}]|[\p{{L}}\p{{M}}]+"), F.lit(0))


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the hashes of text's tokens, h of the template and p of the plain ones."""
    return rows.select(*keys, *[F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias(name) for tokens, name in ((template_tokens, "h"), (plain_tokens, "p"))])


def _windows(name: str, size: int) -> Column:
    """Hashes of the windows of an array of hashes, in order."""
    some = F.transform(F.sequence(F.lit(0), F.size(name) - size), lambda i: F.xxhash64(*[F.get(name, i + k) for k in range(size)]))
    return F.when(F.size(name) >= size, some).otherwise(F.array().cast("array<bigint>"))


def window_hashes(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """keys and every different window hash of text, of each size and both sets."""
    arrays = [_windows(name, size).alias(f"{name}{size}") for size in sizes for name in ("h", "p")]
    both = _hashed(rows, keys).select(*keys, *arrays)
    return both.select(*keys, F.explode(F.array_distinct(F.concat(*[f"{name}{size}" for size in sizes for name in ("h", "p")]))).alias("hash"))


def placed_windows(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """keys, plain, place and hash of every window of text, of each size and both sets."""
    sets = [F.struct(F.lit(name == "p").alias("plain"), _windows(name, size).alias("hashes")) for size in sizes for name in ("h", "p")]
    each = _hashed(rows, keys).select(*keys, F.explode(F.array(*sets)).alias("set"))
    return each.select(*keys, "set.plain", F.posexplode("set.hashes").alias("place", "hash"))


def benchmark_windows(items: DataFrame, window: int, min_words: int, coverage: float, space: Workspace) -> DataFrame:
    """item_id, plain, place, size, hash, n_slots of the windows that count.

    Also total, the item's number of different ones of the set, need, the share of them that must be found, and anchor.
    """
    rows = items.select("item_id", "text").distinct()
    text = F.col("text")
    sets = [F.struct(F.lit(plain).alias("plain"), tokens.alias("tokens"), kinds.alias("kinds")) for plain, tokens, kinds in ((False, template_tokens(text), template_tokens(text)), (True, plain_tokens(text), plain_kinds(text)))]
    sized = rows.select("item_id", F.explode(F.array(*sets)).alias("set")).select("item_id", "set.*").filter(F.size("tokens") > 0)
    sized = sized.withColumn("size", F.least(F.lit(window), F.size("tokens"))).withColumn("h", F.transform("tokens", lambda t: F.xxhash64(t)))
    at = sized.select("item_id", "plain", "kinds", "h", "size", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("size"))).alias("place"))
    part = F.slice("kinds", F.col("place") + 1, window)
    words = F.size(F.filter(part, lambda t: ~t.isin(NUM, UNI, NAM)))
    slots = F.when(F.col("plain"), 0).otherwise(F.size(F.filter(part, lambda t: t.isin(NUM, UNI, NAM))))
    # tokens beyond a short item are null, which xxhash64 passes over
    hashed = at.select("item_id", "plain", "place", "size", words.alias("words"), slots.alias("n_slots"), F.xxhash64(*[F.get("h", F.col("place") + k) for k in range(window)]).alias("hash"))
    vague = F.max("words").over(Window.partitionBy("item_id")) < min_words
    counted = hashed.withColumn("vague", vague).filter((F.col("words") >= min_words) | F.col("vague") & F.col("plain") & (F.col("size") >= min_words))
    counted = space.save(counted.withColumn("need", F.when(F.col("vague"), 1.0).otherwise(coverage)), "counted")
    shared = counted.groupBy(F.col("hash").alias("__hash")).agg(F.countDistinct("item_id").alias("n_items"))
    totals = counted.groupBy(F.col("item_id").alias("__item"), F.col("plain").alias("__plain")).agg(F.countDistinct("hash").alias("total"))
    known = counted.join(shared, F.col("hash") == F.col("__hash")).join(totals, F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("plain") == F.col("__plain")))
    # of so many of the rarest windows a pair that reaches the share has one; a run has a whole piece of `window` places in it
    order = F.dense_rank().over(Window.partitionBy("item_id", "plain").orderBy("n_items", "hash"))
    piece = F.row_number().over(Window.partitionBy("item_id", "plain", F.floor(F.col("place") / window)).orderBy("n_items", "hash"))
    anchor = (order <= F.col("total") - F.ceil(F.col("need") * F.col("total")) + 1) | (piece == 1)
    return known.select("item_id", "plain", "place", "size", "hash", "n_slots", "total", "need", anchor.alias("anchor"))


def longest_runs(hits: DataFrame, keys: list[str], window: int) -> DataFrame:
    """hits with `run`: the tokens on end that the hits around cover along one alignment.

    Hits up to `window` places apart leave no token between them uncovered.
    """
    line = [*keys, "line"]
    before = F.lag("item_place").over(Window.partitionBy(*line).orderBy("item_place"))
    cut = hits.withColumn("cut", F.when(F.col("item_place") - before <= window, 0).otherwise(1))
    island = cut.withColumn("island", F.sum("cut").over(Window.partitionBy(*line).orderBy("item_place")))
    of = Window.partitionBy(*line, "island")
    return island.withColumn("run", F.max(F.col("item_place") + F.col("size")).over(of) - F.min("item_place").over(of)).drop("cut", "island")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, coverage: float = COVERAGE, run: int = RUN, space: Workspace | None = None) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, coverage, n_slots of every item found in a document."""
    space = space or Workspace(docs.sparkSession, "decontam")
    bench = space.save(benchmark_windows(items, window, min_words, coverage, space), "benchmark")
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    sizes = sorted({window, *(r[0] for r in bench.select("size").distinct().collect())})
    doc = ["doc_id", "text_hash"]
    pair = [*doc, "item_id"]
    side = [*pair, "plain"]
    anchors = bench.filter("anchor").select("item_id", "plain", "hash").distinct()
    # Spark sizes what was exploded by the file it came from, so it must not choose to broadcast it
    met = window_hashes(keyed, doc, sizes).join(F.broadcast(anchors) if bench.count() <= BROADCAST_ROWS else anchors.hint("merge"), "hash")
    pairs = space.save(met.select(*side).distinct(), "pairs")
    # of the documents of a pair, every window that its item has
    wanted = small(space.save(pairs.select(*doc).distinct(), "documents"))
    texts = space.save(_semi(keyed, wanted, doc).distinct(), "texts")
    known = bench.select(F.col("item_id").alias("item"), F.col("plain").alias("set"), F.col("place").alias("item_place"), "size", "hash", "n_slots", "total", "need")
    expected = pairs.join(known, F.col("item_id").eqNullSafe(F.col("item")) & (F.col("plain") == F.col("set"))).drop("item", "set")
    here = placed_windows(texts, doc, sizes).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("plain").alias("p"), "place", F.col("hash").alias("found"))
    hits = expected.join(here.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("plain") == F.col("p")) & (F.col("hash") == F.col("found")))
    line = (F.col("place") - F.col("item_place")).alias("line")
    hits = space.save(hits.select(*side, "place", "item_place", line, "size", "hash", "n_slots", "total", "need").distinct(), "hits")

    def passing(rows: DataFrame) -> DataFrame:
        sums = longest_runs(rows, side, window).groupBy(*side, "total", "need").agg(F.countDistinct("hash").alias("n_windows"), F.max("run").alias("run"), F.max("n_slots").alias("n_slots"))
        return sums.filter((F.col("n_windows") >= F.col("need") * F.col("total")) | (F.col("run") >= run))

    likely = space.save(passing(hits).select(*side), "likely")
    hits = _semi(hits, likely, side)
    bad = _inconsistent(space, hits.filter("not plain"), texts, items, window).withColumn("plain", F.lit(False))
    found = passing(_anti(hits, bad.hint("merge"), [*side, "line", "item_place"]))
    share = F.round(F.col("n_windows") / F.col("total"), 4).alias("coverage")
    # figures of the templates, or of the plain windows where these alone pass
    best = found.groupBy(*pair).agg(F.max(F.struct(~F.col("plain"), share, "n_windows", F.col("n_slots").cast("long").alias("n_slots"))).alias("best"))
    return best.select(*pair, "best.n_windows", "best.coverage", "best.n_slots")


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return left.join(other, on, how)


def _semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return _match(left, right, keys, "left_semi")


def _anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return _match(left, right, keys, "left_anti")


def _inconsistent(space: Workspace, hits: DataFrame, texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash, item_id, line, item_place of windows with a slot whose values along the line do not answer one another.

    All slots between the first and the last hit of a line are compared, those outside windows that count as well.
    """
    pair = ["doc_id", "text_hash", "item_id"]
    lines = hits.groupBy(*pair, "line").agg(F.min("item_place").alias("first"), F.max(F.col("item_place") + F.col("size")).alias("end"), F.max("n_slots").alias("slots")).filter("slots > 0")
    lines = space.save(lines.drop("slots"), "lines")
    docs = texts.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), raw_tokens(F.col("text")).alias("doc_raw"), template_tokens(F.col("text")).alias("doc_template"))
    bench = _semi(items.select("item_id", "text"), lines, ["item_id"]).distinct().select(F.col("item_id").alias("__i"), raw_tokens(F.col("text")).alias("item_raw"), template_tokens(F.col("text")).alias("item_template"))
    rows = lines.join(docs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))).join(bench, F.col("item_id").eqNullSafe(F.col("__i")))
    here, there = F.col("k"), F.col("k") + F.col("line")
    at = rows.select(*pair, "line", "doc_raw", "doc_template", "item_raw", "item_template", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("k"))
    kind = F.get("item_template", here)
    at = at.filter(kind.isin(NUM, UNI, NAM) & (F.get("doc_template", there) == kind))
    figures = F.create_map(*[F.lit(x) for entry in VALUES.items() for x in entry])

    def value(tokens: str, place: Column) -> Column:
        token = F.lower(F.get(tokens, place))
        return F.coalesce(F.when(kind == NUM, F.try_element_at(figures, token)), token)

    slots = space.save(at.select(*pair, "line", "k", kind.alias("kind"), value("item_raw", here).alias("was"), value("doc_raw", there).alias("now")), "slots")
    bad, of = None, [*pair, "line", "kind"]
    # a value of the item with several of the document; a name or unit of the document with several of the item
    for one, other, rows in (("was", "now", slots), ("now", "was", slots.filter(F.col("kind") != NUM))):
        mixed = rows.groupBy(*of, one).agg(F.countDistinct(other).alias("n")).filter("n > 1")
        part = _semi(rows, mixed, [*of, one]).select(*pair, "line", "k")
        bad = part if bad is None else bad.union(part)
    return bad.select(*pair, "line", F.explode(F.sequence(F.col("k") - window + 1, F.col("k"))).alias("item_place")).distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item is found."""
    with Workspace(docs.sparkSession, "decontam") as space:
        found = find_contamination(docs, items, **options, space=space).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
        found = small(Workspace(docs.sparkSession, "contaminated").save(found, "contaminated"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (text_hash(docs["text"]) == found["__hash"]), "left_anti")
