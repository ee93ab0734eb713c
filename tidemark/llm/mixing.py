"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in a pseudorandom order, form one run of words cut into blocks of ``BLOCK`` words (the last may be shorter). A
source's target is its weighted share of ``factor`` times all words, at most ``most`` times its own. It takes whole rounds of its blocks
while the target holds one, then blocks in permuted order until the target is met; of the last of these it takes the beginning only, so
that a source however small meets its target to the word.

The mix is made shard by shard. The slots of all sources fall on the output shards by a multinomial draw (each slot by a hash of
source and slot), which gives each shard its number of slots of each source; that many consecutive slot numbers are its own. Slot j
takes block (a * j + c) mod n of its source, a pseudorandom permutation of the n blocks (a is one of a few primes above any n; c puts
the short last block at a pseudorandom slot that is known) that starts again after each round, so nothing is taken three times before all
is taken twice. Slots join blocks, and blocks the
documents that lie in them, by index.

Running sums are two-level (pseudorandom buckets of about ``BUCKET`` rows inside each source, then the buckets), so a source with
a third of the corpus is spread over many tasks. Only tables of one row a source, bucket or shard are windowed as a whole. Texts
take no part in sorting; they join at the end.

Null texts have size 0 and are taken 0 times. A null source is a source of its own, last in order. A null doc_id is an id like
any other; repeated rows each hold their place in the run. Everything is derived from hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import parted, written

WEIGHTS = (5, 2, 1)
BLOCK, SHARDS, BUCKET = 4096, 64, 50_000
# The sixteen largest primes below 2**61, as what they are short of it.
_SHORT = (1, 31, 45, 229, 259, 283, 339, 391, 403, 465, 531, 579, 675, 759, 799, 819)
_WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def _hash(*what) -> Column:
    """Non-negative 62-bit hash of columns (or their names) and numbers."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in what]), 2)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    A source stops at most * its size exactly if its weight share at the common level reaches that. In order of the level
    at which they stop, the stopped ones are a prefix: the level is what is left after them over the weights after them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("weight"))
    t = t.select("*", (F.col("source_size") * F.lit(float(most))).alias("cap"))
    stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(factor)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest"),
    )
    # the first source that doesn't stop sets the level; if all stop, there is none
    t = t.select("*", F.when(F.col("weight") * F.col("left") / F.col("rest") < F.col("cap"), F.col("left") / F.col("rest")).alias("level"))
    t = t.select("*", F.max("level").over(everything).alias("top"))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("top")), F.col("cap"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _sized(documents: DataFrame, texts: bool) -> DataFrame:
    """rid (a number of the row), doc_id, source, size, key, and row (all columns) if texts are wanted; written, so that it is
    the same wherever it is read."""
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if texts else []
    d = documents.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("key"), *row)
    return written(d.withColumn("rid", F.monotonically_increasing_id()), "sized")


def _plan(sized: DataFrame, block: int, seed: int, weights: tuple, factor: float, most: float):
    """placed (rid, doc_id, source, size, start) in the run of each source, and sources with their targets, blocks and slots."""
    sized = sized.drop("row")
    # written, so that its size is known and the rows aren't dealt by source to meet it
    rows = written(sized.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BUCKET)).alias("cuts")), "counts")
    cut = sized.alias("p").join(rows.alias("r"), F.expr("p.source <=> r.source")).select("p.*", F.pmod(_hash(seed, "p.doc_id", "p.key"), "r.cuts").alias("bucket"))
    buckets = cut.groupBy("source", "bucket").agg(F.sum("size").alias("m"))
    first = Window.partitionBy("source").orderBy("bucket")
    buckets = buckets.select("source", "bucket", (F.sum("m").over(first) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("source")).alias("source_size"))
    buckets = written(buckets, "buckets")
    sources = targets(buckets.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, factor, most)
    n_blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    words = F.least(F.floor(F.lit(most) * F.col("source_size")), F.round("target")).cast("long")
    sources = sources.select("*", F.lit(block).cast("long").alias("block"), n_blocks.alias("n_blocks"), words.alias("words"))
    # one slot more than full blocks would need, since the short one may be among them
    rest = F.expr("words % source_size")
    last = F.when(rest > 0, F.least("n_blocks", F.ceil(rest / F.lit(block)) + 1)).otherwise(0)
    slots = F.when(F.col("n_blocks") > 0, F.expr("words div source_size") * F.col("n_blocks") + last).otherwise(0)
    sources = written(sources.select("*", slots.cast("long").alias("slots")), "sources")
    order = _hash(seed + 1, "doc_id", "key").alias("turn")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.select("*", order).select("*", (F.sum("size").over(inside) - F.col("size")).alias("within"))
    both = placed.alias("p").join(buckets.alias("b"), F.expr("p.source <=> b.source and p.bucket = b.bucket"))
    return both.select("p.rid", "p.doc_id", "p.source", "p.size", (F.col("p.within") + F.col("b.before")).alias("start")), sources


def _numbers(rows: DataFrame, first: str, count: str, out: str, *by: str, chunk: int = 4096) -> DataFrame:
    """rows, each repeated for out = first, first + 1, ... (count of them); ranges are cut and dealt before they are spread out."""
    end = F.col(first) + F.col(count)
    rows = rows.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.col(first), end - 1, F.lit(chunk).cast("long"))).alias("_from"))
    rows = rows.repartition(parted(rows.sparkSession), *by, "_from")
    return rows.select("*", F.explode(F.sequence("_from", F.least(F.col("_from") + chunk, end) - 1)).alias(out)).drop("_from")


def draws(sources: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """source, shard, first, count: how many slots of each source a shard takes - a multinomial draw - and the first of them."""
    s = _numbers(sources.select("source", "slots", F.lit(0).cast("long").alias("zero")), "zero", "slots", "slot", "source")
    drawn = s.groupBy("source", (_hash(seed + 3, "source", "slot") % shards).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    return drawn.select("source", "shard", "count", (F.sum("count").over(Window.partitionBy("source").orderBy("shard")) - F.col("count")).alias("first"))


def slots(sources: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """The mix: one row (shard, source, slot, round, block_no, take) for each block taken; take: how many of its words, from its first."""
    d = written(draws(sources, shards, seed), "draws")
    prime = F.element_at(F.array(*[F.lit((1 << 61) - x) for x in _SHORT]), (_hash(seed, "source") % len(_SHORT) + 1).cast("int"))
    least = F.greatest("n_blocks", F.lit(1))
    s = sources.select("source", "n_blocks", "source_size", "block", "words", F.pmod(prime, least).alias("a"), F.pmod(_hash(seed + 2, "source"), least).alias("short"))
    s = d.alias("d").join(s.alias("s"), F.expr("d.source <=> s.source")).select("d.*", *[f"s.{c}" for c in s.columns if c != "source"])
    s = _numbers(s, "first", "count", "slot", "source")
    # slots count from the one of the last block, n - 1; the product runs in decimals: exact for any number of blocks
    n = F.col("n_blocks").cast("decimal(20,0)")
    product = F.col("a").cast("decimal(19,0)") * F.pmod(F.col("slot") - F.col("short"), "n_blocks").cast("decimal(18,0)")
    block = F.pmod(product + F.col("n_blocks").cast("decimal(20,0)") - 1, n).cast("long")
    s = s.select("*", F.expr("slot div n_blocks").cast("int").alias("round"), F.expr("slot % n_blocks").alias("j"), block.alias("block_no"))
    short_by = F.expr("n_blocks * block - source_size")
    length = F.col("block") - F.when(F.col("j") == F.col("short"), short_by).otherwise(0)
    ahead = F.col("j") * F.col("block") - F.when(F.col("j") > F.col("short"), short_by).otherwise(0)
    take = F.when(F.expr("round < words div source_size"), length).otherwise(F.least(length, F.expr("words % source_size") - ahead))
    return s.select("shard", "source", "slot", "round", "block_no", take.alias("take")).where("take > 0")


#: A null source joins as an empty string behind a flag, so that joins stay equalities.
def _named() -> list[Column]:
    return [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")]


def _parts(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each block that a document lies in; texts aren't carried."""
    p = placed.where("size > 0").alias("p").join(sources.alias("s"), F.expr("p.source <=> s.source")).select("p.*", "s.block")
    last = F.expr("(start + size - 1) div block")
    p = p.select("*", F.explode(F.sequence(F.expr("start div block"), last)).alias("block_no"))
    return p.select("rid", *_named(), "block_no", "block", "start", "size")


def _taken(placed: DataFrame, sources: DataFrame, taken: DataFrame) -> DataFrame:
    """rid, shard, round, block_no, size, begin and end: the words of the document, counted in it, that a slot takes."""
    hit = _parts(placed, sources).join(taken.select("shard", "round", *_named(), "block_no", "take"), ["none", "name", "block_no"])
    first = F.col("block_no") * F.col("block")
    begin, end = F.greatest("start", first) - F.col("start"), F.least(F.col("start") + F.col("size"), first + F.col("take")) - F.col("start")
    return hit.select("rid", "shard", "round", "block_no", "size", begin.alias("begin"), end.alias("end")).where("end > begin")


def mixed(documents: DataFrame, block: int = BLOCK, seed: int = 17, weights: tuple = WEIGHTS, factor: float = 1.5, most: float = 2.0, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document that the mix takes, repeats counted), source."""
    placed, sources = _plan(_sized(documents, False), block, seed, weights, factor, most)
    placed = written(placed, "placed")
    hit = _taken(placed, sources, slots(sources, shards, seed)).groupBy("rid").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    out = placed.join(hit, "rid", "left").select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source")).select("o.doc_id", "o.size", "s.source_size", "s.target", "o.taken", "o.source")


def mix(documents: DataFrame, block: int = BLOCK, seed: int = 17, weights: tuple = WEIGHTS, factor: float = 1.5, most: float = 2.0, shards: int = SHARDS, shard: str | None = None) -> DataFrame:
    """The mix as documents (doc_id, source, text and any other columns): for each shard and round the runs of words taken in it.

    A document that one shard takes whole in a round keeps its text as it is; of others the words taken stay, joined by one space. Only
    words that follow each other in the document make one row: a document taken by two shards, in two rounds, or in blocks that
    aren't neighbours gives several. n_chars, if there is such a column, is that of the text given. `shard` names a further column for
    the number of the shard.
    """
    sized = _sized(documents, True)
    placed, sources = _plan(sized, block, seed, weights, factor, most)
    hit = _taken(placed, sources, slots(sources, shards, seed))
    # blocks of a document that follow each other in a shard and round make one run
    own = Window.partitionBy("rid", "shard", "round").orderBy("begin")
    hit = hit.select("*", F.coalesce((F.col("begin") != F.lag("end").over(own)).cast("int"), F.lit(0)).alias("gap"))
    hit = hit.select("*", F.sum("gap").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    hit = hit.groupBy("rid", "shard", "round", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("size").alias("size"))
    j = hit.join(sized.select("rid", "row"), "rid")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"({_WORDS})"), 1)
    some = F.array_join(F.slice(words, (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")), " ")
    text = F.when(F.expr("begin = 0 and end = size"), F.col("row.text")).otherwise(some)
    j = j.select("row", "shard", text.alias("new"))
    given = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return j.select(*[given.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns], *([F.col("shard").alias(shard)] if shard else []))
