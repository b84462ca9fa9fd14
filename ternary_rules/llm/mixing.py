"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents in a fixed pseudorandom order, form one sequence that is cut
into blocks of fixed length. A source's target is filled by whole passes over its blocks and part
of a further pass, each pass in an order of its own: a pseudorandom permutation of block indices
that is computed from the index alone. The sources of an output shard's slots are drawn one by one,
with the targets as chances, so that the source counts of a shard are a multinomial draw. The k-th
slot that a source draws, over all shards in order, takes its k-th block; the last draws of a source
beyond its target, about as many as the square root of all slots, go to the sources that fell short.
Slots and the documents' pieces meet in a join on (source, block).

The permutation is "swap or not": each round pairs an index x with k - x modulo n and swaps the
two or not by a hash of the pair. It is a bijection for any n, and so needs neither a sort nor
trial and error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, restored, shielded, stored

BLOCK_WORDS = 256
SHARD_BLOCKS = 4096
ROUNDS = 24
#: Slots that a key of the join of draws and sources spans.
DRAW_RANGE = 8192
#: Documents of a source whose sizes one window sums up.
RUN_ROWS = 20_000
WEIGHTS = (3, 1, 2)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *seed: Column, inverse: bool = False) -> Column:
    """The place of index x in a pseudorandom permutation of 0 to n-1 that the seed names."""
    rounds = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *seed), n) - at, n)
        return F.when(F.xxhash64(r, F.greatest(at, other), F.lit(7), *seed).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), step)


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_no (by code point, null last), source_size, target. sizes: (source,
    source_size), one row a source. The sources share `share` of all sizes by weight, weights
    repeating along source_no; none gets over `most` times its size, and what it would exceed goes
    to the others by weight until none is above.

    In order of most * size / weight the sources that are held are a prefix: with those before it
    held, a source is held if the rest of the total would give it more than its bound."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(one) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * F.lit(float(most))
    table = numbered.withColumn("weight", weight).withColumn("bound", bound)
    every = Window.orderBy(F.col("bound") / F.col("weight"), "source_no")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(share),
        "weights": F.sum("weight").over(Window.partitionBy(F.lit(1))),
        "held": F.coalesce(F.sum("bound").over(before), F.lit(0.0)),
        "held_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    rest = (F.col("total") - F.col("held")) / (F.col("weights") - F.col("held_weight"))
    table = table.withColumn("level", rest).withColumn("nth", F.row_number().over(every))
    open_ = F.when(F.col("bound") > F.col("level") * F.col("weight"), F.col("nth"))
    all_ = Window.partitionBy(F.lit(1))
    table = table.withColumn("first_open", F.min(open_).over(all_)).withColumn("open_level", F.min_by("level", open_).over(all_))
    target = F.when(F.col("nth") >= F.col("first_open"), F.col("weight") * F.col("open_level")).otherwise(F.col("bound"))
    return table.select("source", "source_no", "source_size", target.alias("target"))


def _placed(rows: DataFrame, order: list[str], seed: int) -> DataFrame:
    """rows (source, size, ...) with `begin`, the words of its source before it. Sums are taken in
    runs of a source's rows, then over the runs, so that no task gets a whole source."""
    runs = max(32, -(-rows.count() // RUN_ROWS))
    mixed = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    run = rows.withColumn("__h", mixed).withColumn("__run", F.shiftrightunsigned(F.col("__h"), 1) % F.lit(runs))
    sums = run.groupBy("source", "__run").agg(F.sum("size").alias("__words"))
    along = Window.partitionBy("source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sums.select(F.col("source").alias("__s"), F.col("__run").alias("__r"), F.coalesce(F.sum("__words").over(along), F.lit(0)).alias("__base")))
    inside = Window.partitionBy("source", "__run").orderBy("__h", *order, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = run.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(base, placed["source"].eqNullSafe(base["__s"]) & (placed["__run"] == base["__r"]))
    return joined.withColumn("begin", F.col("__base") + F.col("__in")).drop("__h", "__run", "__in", "__s", "__r", "__base")


def slots(goals: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> DataFrame:
    """The output's plan: shard, slot, source_no, pass, block and words (the words of the block
    that the slot takes, from the block's start). goals: the rows of targets()."""
    size, want = F.col("source_size"), F.round("target").cast("long")
    plan = goals.where("source_size > 0").select("source_no", size.alias("n_words"), F.ceil(size / block_words).alias("blocks"), F.least(want, 2 * size).alias("want"))
    plan = plan.withColumn("whole", F.floor(F.col("want") / F.col("n_words"))).withColumn("part", F.col("want") % F.col("n_words"))
    # The last pass takes blocks in the order of its permutation until `part` words are full; only
    # the short last block makes that other than part / block_words.
    tail = F.col("n_words") - (F.col("blocks") - 1) * block_words
    plan = plan.withColumn("tail", tail).withColumn("tail_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("whole"), inverse=True))
    whole_before = F.ceil(F.col("part") / block_words)
    with_tail = F.when(F.col("part") <= F.col("tail_at") * block_words, whole_before).otherwise(F.greatest(F.col("tail_at") + 1, F.ceil((F.col("part") - F.col("tail")) / block_words) + 1))
    plan = plan.withColumn("part_blocks", F.when(F.col("part") > 0, with_tail).otherwise(F.lit(0)))
    plan = plan.withColumn("n_slots", F.col("whole") * F.col("blocks") + F.col("part_blocks"))
    along = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    plan = stored(plan.withColumn("first", F.coalesce(F.sum("n_slots").over(along), F.lit(0))).where("n_slots > 0"))
    out = drawn(plan.select("source_no", "n_slots", "first"), shard_blocks, seed).join(plan, "source_no")
    out = out.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).withColumn("at", F.col("k") % F.col("blocks"))
    out = out.withColumn("block", permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("pass")))
    full = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block_words))
    before = F.col("at") * block_words - F.when(F.col("at") > F.col("tail_at"), block_words - F.col("tail")).otherwise(0)
    words = F.when(F.col("pass") < F.col("whole"), full).otherwise(F.least(full, F.col("part") - before))
    return out.select("shard", "slot", "source_no", "pass", "block", words.cast("long").alias("words"))


def _running(rows: DataFrame, key: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of value over the rows of their key before them in order (a long
    that is unique in the key): first in runs of RUN_ROWS of it, then over the runs."""
    rows = rows.withColumn("__run", F.floor(F.col(order) / RUN_ROWS))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*key, "__run").agg(F.sum(value).alias("__sum"))
    runs = runs.withColumn("__base", F.coalesce(F.sum("__sum").over(before(Window.partitionBy(*key).orderBy("__run"))), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy(*key, "__run").orderBy(order))), F.lit(0))
    return rows.withColumn("__in", inside).join(runs, [*key, "__run"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__run", "__in", "__base")


def drawn(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> DataFrame:
    """shard, slot, source_no and k, the index of the slot among those of its source. plan: a stored
    table (source_no, n_slots, first), one row a source, first the slots of the sources before it.

    A slot draws a number below all slots; the source whose range it falls in is the slot's. Ranges
    are cut by DRAW_RANGE, which gives the join its key. A source's index runs over the shards. What
    it draws beyond n_slots is dealt, in order, to the sources that drew too few."""
    spark = plan.sparkSession
    n = plan.agg(F.sum("n_slots")).first()[0] or 0
    cut = lambda c: F.floor(c / DRAW_RANGE)
    ranges = plan.select("source_no", "n_slots", "first", F.explode(F.sequence(cut(F.col("first")), cut(F.col("first") + F.col("n_slots") - 1))).alias("range"))
    places = spark.range(0, n, 1, int(max(1, min(n // 100_000 + 1, 20_000))))
    draw = places.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(11)), F.lit(max(n, 1)))).withColumn("range", cut(F.col("draw")))
    met = draw.join(ranges, "range").where((F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("n_slots")))
    shard = F.floor(F.col("id") / shard_blocks)
    counts = met.groupBy(shard.alias("shard"), "source_no", "n_slots").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"))  # SHARD_BLOCKS at most
    counts = stored(_running(stored(counts), ["source_no"], "shard", "n", "base"))
    each = counts.select("source_no", "n_slots", "base", F.posexplode("ids").alias("pos", "id")).withColumn("k", F.col("base") + F.col("pos"))
    own = each.where(F.col("k") < F.col("n_slots")).select("id", "source_no", "k")
    surplus = each.where(F.col("k") >= F.col("n_slots")).select("id")
    nth = _running(stored(surplus.withColumn("one", F.lit(1).cast("long"))), [], "id", "one", "nth").select("id", "nth")
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = plan.join(got, "source_no", "left").select("source_no", F.coalesce("got", F.lit(0)).alias("got"), (F.col("n_slots") - F.coalesce("got", F.lit(0))).alias("lacks")).where("lacks > 0")
    before = F.coalesce(F.sum("lacks").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = short.withColumn("begin", before)
    gaps = short.select("source_no", "got", "begin", "lacks", F.explode(F.sequence(cut(F.col("begin")), cut(F.col("begin") + F.col("lacks") - 1))).alias("range"))
    dealt = nth.withColumn("range", cut(F.col("nth"))).join(gaps, "range").where((F.col("nth") >= F.col("begin")) & (F.col("nth") < F.col("begin") + F.col("lacks")))
    whole = own.unionByName(dealt.select("id", "source_no", (F.col("got") + F.col("nth") - F.col("begin")).alias("k")))
    return whole.select(shard.alias("shard"), (F.col("id") % shard_blocks).alias("slot"), "source_no", "k")


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document's words reach into."""
    last = F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    return placed.where("size > 0").select("source_no", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block_words), last)).alias("block"))


def _numbered(placed: DataFrame, goals: DataFrame) -> DataFrame:
    """placed with its source's row of goals. There is one row of goals per source."""
    named = goals.withColumnRenamed("source", "__s")
    return placed.join(named, placed["source"].eqNullSafe(named["__s"])).drop("__s")


def plan_mix(rows: DataFrame, order: list[str], block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """rows (source, size, and the columns of `order`, which tell rows apart) with source_no,
    source_size, target and begin; and the mix: shard, slot, source_no, begin (of the document),
    pass, low and high (the document's words low to high-1 that the slot holds)."""
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    placed = stored(_numbered(_placed(rows, order, seed), goals))
    pieces = _pieces(placed, block_words)
    dealt = slots(goals, block_words, shard_blocks, seed)
    # sorted runs on both sides: the slots come from few rows, which makes their size look small
    both = pieces.join(dealt.hint("merge"), ["source_no", "block"])
    from_ = F.greatest(F.col("block") * block_words, F.col("begin")) - F.col("begin")
    to = F.least(F.col("block") * block_words + F.col("words"), F.col("begin") + F.col("size")) - F.col("begin")
    return placed, both.withColumn("low", from_).withColumn("high", to).where("high > low").select("shard", "slot", "source_no", "begin", "pass", "low", "high")


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the document in the mix,
    repeats counted) of every row of docs (doc_id, text, source). A null text has size 0; a null
    source is a source of its own, the last; rows that repeat are documents of their own."""
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(F.col("text")).alias("size")))
    placed, mix = plan_mix(rows, ["doc_id"], block_words, seed=seed)
    sums = mix.groupBy("source_no", "begin").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    # documents without words share their place with the next one
    key = F.when(F.col("size") > 0, F.col("begin"))
    out = placed.withColumn("__b", key).join(sums.select(F.col("source_no").alias("__n"), F.col("begin").alias("__at"), "taken"), (F.col("source_no") == F.col("__n")) & (F.col("__b") == F.col("__at")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each pass that takes words of a
    document. Where a pass takes all its words the text is unchanged; else it is the words taken,
    in order, joined by spaces. n_chars is counted anew. Documents without words stay once."""
    names, needed = docs.columns, ("doc_id", "text", "source", "n_chars")
    kind = docs.schema["n_chars"].dataType if "n_chars" in names else None
    rows = shielded(docs, needed).withColumn("source", F.col("source").cast("string")).withColumn("size", words_in(F.col("text"))).withColumn("__text", F.xxhash64("text"))
    rows = stored(rows)
    light = rows.select("doc_id", "source", "size", "__text")
    placed, mix = plan_mix(light, ["doc_id", "__text"], block_words, seed=seed)
    ranges = mix.groupBy("source_no", "begin", "pass").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"), F.sum(F.col("high") - F.col("low")).alias("got"))
    nth = Window.partitionBy("doc_id", "source", "__text", "size").orderBy("begin")
    own = placed.withColumn("__nth", F.row_number().over(nth))
    # documents without words share their place with the next one, whose passes are not theirs
    empty = own.where("size = 0").withColumns({"got": F.lit(None).cast("long"), "ranges": F.lit(None).cast("array<struct<low:bigint,high:bigint>>")})
    own = own.where("size > 0").join(ranges.drop("pass"), ["source_no", "begin"]).unionByName(empty)
    own = own.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__text").alias("__t"), "__nth", F.when(F.col("got") < F.col("size"), F.col("ranges")).alias("__ranges"))
    copies = Window.partitionBy("doc_id", "source", "__text", "size").orderBy(F.lit(0))
    texts = rows.withColumn("__nth", F.row_number().over(copies))
    same = texts["doc_id"].eqNullSafe(own["__d"]) & texts["source"].eqNullSafe(own["__s"]) & texts["__text"].eqNullSafe(own["__t"]) & (texts["__nth"] == own["__nth"])
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform(F.col("__ranges"), lambda r: F.slice(F.col("__words"), (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")))), " ")
    out = texts.drop("size").join(own.drop("size"), same).withColumn("__words", F.when(F.col("__ranges").isNotNull(), words))
    out = out.withColumn("text", F.when(F.col("__ranges").isNotNull(), cut).otherwise(F.col("text")))
    if kind is not None:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return restored(out, names, needed)
