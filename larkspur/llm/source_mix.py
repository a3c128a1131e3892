"""Mixing sources to target weights with a low-discrepancy schedule.

All words are shared out by weight, at most ``most`` times a source's own words
(the excess is shared again).  A source asks for as many turns as blocks of words make
up its target, and has a stretch of 0..1 as long as its part of all turns.  Slots 0, 1,
2, ... each map their golden-ratio point through these stretches to a source; the r-th
slot of a source takes its r-th block, starting anew after the last, until the words
given meet its target, so its last turn may take a part of a block.  Blocks are equal
runs of words of the source's documents in shuffled order; the last one of a source may
be shorter.  So any stretch of the schedule is close to the targets, and the whole meets
them.  Slots that fall to a source after its last turn are void.

Points are whole numbers: slot * PHI modulo ONE, two neighbours of Fibonacci's sequence,
so no rounding adds up.  The gaps between M of them are below 1.9 * ONE / M, and a turn has
ONE / N of the line if there are N turns, so RUN * N slots give every source all of its
turns, however small its target is.

Only built-in functions run.  Ranks and running sums go in two steps, within a
range and over the ranges, so a source with a third of all rows is spread out.  A slot
finds its source by the cell of 0..1 that its point lies in.  The table of sources has
a row for each source; ranking them is the one step that a single task does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import cluster

PHI, ONE = 956722026041, 1548008755920  # the 59th and 60th number of Fibonacci
DIGIT = 20  # bits of a slot's number that are multiplied at once, so that products stay below 2**63
RUN = 17 / 8  # slots for each turn
RANGES = 256  # and as many more as there are millions of words or slots
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source (source, rank, source_size, weight, target): the words that the mix takes of it.

    Sources by code point, null last, have the weights in turn.  A source is
    capped if its cap lies below its share of what the others leave; caps fill in
    ascending order of cap / weight, so one pass of running sums finds them.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)), F.col("weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
        .withColumn("capped", F.col("cap") < F.col("weight") * F.col("level"))
        .withColumn("free", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(F.try_divide(F.col("weight") * F.col("free"), F.col("free_weight")), F.lit(0.0))))
    )
    return ranked.select("source", "rank", "source_size", "weight", "target")


def with_stretches(shares: DataFrame, block: int) -> DataFrame:
    """Adds goal (words), blocks, turns, all_turns, and the points after <= point < upto that are the source's."""
    goal, size, b = F.col("goal"), F.col("source_size"), F.lit(block)
    rows = shares.withColumn("goal", F.round("target").cast("long")).withColumn("blocks", F.ceil(size / b).cast("long"))
    turns = F.when(goal > 0, F.expr("goal div source_size") * F.col("blocks") + F.ceil(goal % size / b)).otherwise(0)
    rows = rows.withColumn("turns", turns.cast("long")).withColumn("all_turns", F.sum("turns").over(Window.partitionBy()))
    rows = rows.withColumn("done", F.sum("turns").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = lambda turns: F.expr(f"case when all_turns > 0 then cast({turns} as decimal(19, 0)) * {ONE} div all_turns else 0 end").cast("long")
    return rows.withColumn("after", end("done - turns")).withColumn("upto", end("done")).drop("done")


def ranges(n: int) -> int:
    """Stretches in which n slots or documents of any source are ranked side by side."""
    return max(RANGES, -(-n // 1_000_000))


def point(slot: Column) -> Column:
    """slot * PHI modulo ONE, for slots below 2**40."""
    high, low = F.shiftright(slot, DIGIT), slot.bitwiseAND((1 << DIGIT) - 1)
    return (high * F.lit((PHI << DIGIT) % ONE) % ONE + low * F.lit(PHI) % ONE) % ONE


def turns(spark: SparkSession, shares: DataFrame, n_turns: int) -> DataFrame:
    """(rank, turn, slot): which slot is the source's turn, from 0; shares as with_stretches() has them."""
    n_slots = int(n_turns * RUN) + 1 if n_turns else 0
    if n_slots >> 2 * DIGIT:
        raise ValueError(f"{n_slots} slots are too many for whole points; take larger blocks")
    per = max(1, -(-n_slots // ranges(n_slots)))
    cell = lambda x: F.expr(f"{x} * {CELLS} div {ONE}")
    bounds = shares.where("upto > after").select("rank", "turns", "after", "upto").withColumn("cell", F.explode(F.sequence(cell("after"), cell("(upto - 1)"))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", cell("point"))
    slots = slots.join(bounds, "cell").where("point >= after and point < upto").select("slot", F.floor(F.col("slot") / per).alias("stretch"), "rank", "turns")
    counted = slots.groupBy("rank", "stretch").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # stretches that begin after a source's last turn have none of its turns
    inner = slots.join(before, ["rank", "stretch"]).where("before < turns").withColumn("within", F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("slot")) - 1)
    return inner.select("rank", (F.col("before") + F.col("within")).alias("turn"), "slot", "turns").where("turn < turns").drop("turns")


def schedule(spark: SparkSession, shares: DataFrame, block: int, n_turns: int) -> DataFrame:
    """(rank, block_no, slots, last_slot, part): slots that take a block whole, in turn, and the one that takes its first words only.

    A block has at most ``most`` turns and one more; words of the last turn end with the target, rounded.
    """
    size = F.col("source_size")
    # the table of sources has a row for each source
    taken = turns(spark, shares, n_turns).join(shares.select("rank", "source_size", "goal", "blocks"), "rank").withColumn("block_no", F.pmod("turn", "blocks"))
    whole = F.least(F.lit(block), size - F.col("block_no") * block)
    left = F.col("goal") - (F.expr("turn div blocks") * size + F.col("block_no") * block)
    cut = left < whole
    return taken.groupBy("rank", "block_no").agg(F.array_sort(F.collect_list(F.when(~cut, F.col("slot")))).alias("slots"), F.max(F.when(cut, F.col("slot"))).alias("last_slot"), F.coalesce(F.max(F.when(cut, left)), F.lit(0)).alias("part"))


def laid_out(sized: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Each document's first word in the shuffled run of its source: adds begin; n is the number of documents."""
    bits = max(1, (ranges(n) - 1).bit_length())
    key = F.xxhash64(F.lit(seed), "row_key")
    sized = sized.withColumn("shuffle", key).withColumn("stretch", F.shiftright("shuffle", 64 - bits))
    by = Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("rank", "stretch").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("n")
    inner = Window.partitionBy("rank", "stretch").orderBy("shuffle", "row_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return sized.join(before, ["rank", "stretch"]).withColumn("begin", F.col("before") + F.col("within")).drop("before", "within", "stretch", "shuffle")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 64, doc_id: str = "doc_id", text: str = "text", source: str = "source", row_key: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, first_slot, n_slots, and pieces (first word, words, times, slots) taken.

    A block has ``block`` words, whatever the size of the input.  The words taken of a
    source are its target, rounded to a word.  Slots tell the order of the mix: first_slot
    is the first that takes words of the row (null: none does), n_slots how many do, and a piece
    has the slots that take it, in turn.  A string column named as ``row_key`` is
    passed on as row_key and orders the rows in place of the id and a hash of the text.
    Null texts have size 0 and nothing taken; a null source is a source of its own; null
    ids and repeated rows are rows like others (rows that agree in id and text follow
    each other in an arbitrary order).  An empty table gives an empty result.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("mark"), *([F.col(row_key).alias("row_key")] if row_key else []))
    folder = cluster.shared_folder(spark)
    sized = cluster.written(sized, folder, "sizes")
    # a row for each source, read by all plans that follow
    shares = cluster.written(with_stretches(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), block), folder, "shares")
    n_turns, n = int(shares.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]), sized.count()
    # each part is computed by a plan of its own: one plan of all of them takes much of the driver's memory where partitions are many
    taken = cluster.written(schedule(spark, shares, block, n_turns), folder, "schedule")
    order = F.col("row_key") if row_key else F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("mark").cast("string"))
    # the table of sources has a row for each source; null equals null here
    known = sized.join(shares.select("source", "rank", "source_size", "target"), sized["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    placed = cluster.written(laid_out(known.withColumn("row_key", order), n), folder, "placed")
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    parts = placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(first, last)))
    parts = parts.join(taken, ["rank", "block_no"])
    low = F.greatest(F.col("begin"), F.col("block_no") * block)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * block)
    # a block's first words up to the cut are taken once more than the others
    cut = F.least(F.greatest(F.col("block_no") * block + F.col("part"), low), high)
    more = F.concat("slots", F.array_compact(F.array("last_slot")))
    two = [F.struct((a - F.col("begin")).alias("first"), (b - a).alias("words"), s.alias("slots"), n.alias("new")) for a, b, s, n in ((low, cut, more, F.size(more)), (cut, high, F.col("slots"), F.when(cut > low, 0).otherwise(F.size("slots"))))]
    parts = parts.select("rank", "begin", F.inline(F.array(*two))).where("words > 0 and size(slots) > 0").withColumn("times", F.size("slots").cast("long"))
    parts = parts.groupBy("rank", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min(F.col("slots")[0]).alias("first_slot"), F.sum("new").alias("n_slots"), F.array_sort(F.collect_list(F.struct("first", "words", "times", "slots"))).alias("pieces"))
    # (rank, begin) is one document, but for empty ones, which get nothing
    some = F.when(F.col("size") > 0, F.col("begin"))
    out = placed.withColumn("begin", some).join(parts, ["rank", "begin"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "pieces", *(["row_key"] if row_key else []))
