"""Mixing sources to target weights by Sainte-Laguë apportionment.

The token stream of a source (its documents in a seeded order, laid end to
end) is cut into blocks of equal size. Sainte-Laguë hands out the blocks of
the whole mix one by one to the source with the highest quotient
``target / (2 * blocks held + 1)``. The first blocks in that order fill the first
shard, the next ones the second, and so on, which gives every shard integer
quotas near the mixture. A source then takes its blocks in the seeded order: all
of them once per full pass, and in the last pass a seeded even selection. Laid
end to end they are dealt to the shards, each of which gets as many as its
quota says; a document's words are those of its part of the blocks dealt.

Only sums per source and per cell of a source are ever brought together; a
document's share of the selected blocks follows from its place in the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.shard import CELLS_PER_PARTITION, _cell, _unit
from pagesift.session import stage

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of (skey, source, source_size): weights repeat over the sources
    in code point order (null last); a target stops at ``max_repeats`` times the
    source's size and the excess is shared again by weight. The level at which
    that ends is found in one pass over the sources in the order of
    size / weight: the first ones are full, all others get the same amount per
    unit of weight."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sources.withColumn("weight", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("skey"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("full", F.col("cap") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("level")))).over(everything)
    return s.withColumn("at", level["level"]).select(
        "skey", "source", "source_size", "weight",
        F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(targets: DataFrame, block: int, n_shards: int, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Integer quotas: (skey, shard, quota, upto) in blocks, ``upto`` those of all
    shards so far.

    For the first ``round(total * j / n_shards)`` blocks of the order of highest
    quotients, j = 1..n_shards, the holders are counted. A source's count lies
    within ``(sources / 2 + 1) * share + 1`` of its ideal count, so only the seats in
    that window are listed and ranked: a few per source."""
    whole = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = targets.filter(F.col("target") > 0).select(
        "skey", "target", (max_repeats * F.ceil(F.col("source_size") / block)).cast("long").alias("most"),
        F.sum("target").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("sources"))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    t = t.withColumn("seats", F.round(F.col("total") * (F.col("shard") + 1) / (block * n_shards)).cast("long"))
    ideal = F.col("seats") * F.col("target") / F.col("total")
    reach = (F.col("sources") / 2 + 1) * F.col("target") / F.col("total") + 1
    t = t.withColumn("lo", F.greatest(F.floor(ideal - reach), F.lit(0)).cast("long"))
    t = t.withColumn("hi", F.greatest(F.ceil(ideal + reach), F.lit(0)).cast("long"))
    held = t.groupBy("shard").agg(F.sum("lo").alias("sure"))
    seats = (t.withColumn("i", F.explode(F.sequence("lo", "hi"))).join(held, "shard")
             .withColumn("rank", F.row_number().over(
                 Window.partitionBy("shard").orderBy((F.col("i") + 0.5) / F.col("target"), "skey"))))
    won = F.sum(F.when(F.col("rank") <= F.col("seats") - F.col("sure"), 1).otherwise(0))
    upto = seats.groupBy("skey", "shard").agg(
        F.least(F.min("lo") + won, F.max("most")).cast("long").alias("upto"))
    last = Window.partitionBy("skey").orderBy("shard")
    return upto.select("skey", "shard", (F.col("upto") - F.coalesce(F.lag("upto").over(last), F.lit(0))).alias("quota"), "upto")


def mix(df: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), block: int = 64, n_shards: int = 16,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """Words that the mix takes of every document.

    Returns (id, size, source, source_size, target, taken, blocks, shards) and the
    input columns named in ``keep``: one row per input row, ``size`` in words, ``blocks``
    the quota of the source over all shards, ``shards`` an array of (shard, words)
    with the words that each shard takes, ``taken`` their sum. ``taken`` is at most
    ``MAX_REPEATS`` times ``size``, and the words taken of a source differ from its
    target by about one block. A shard gets exactly its quota's words of a source;
    what the source's last words are short of or above a block falls to the last one.

    Defined cases: a null source is a source of its own, last in the order; a
    null or blank text has size 0 and is never taken; a null id orders like an
    empty string; repeated rows are documents of their own; if no document has
    a word all targets are 0; an empty table gives no rows. Other columns are
    ignored unless kept.
    """
    spark = df.sparkSession
    cells = CELLS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    order = _unit(F.concat_ws(":", F.lit(f"mix{seed}"), F.col(id_col).cast("string")))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("skey"), order.alias("rnd"),
        n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"),
        *([F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []),
    ).withColumn("cell", _cell(F.col("rnd"), cells))
    rows = stage(rows, "mix-rows")  # the texts are read and split once
    sums = rows.groupBy("skey", "cell").agg(F.sum("size").alias("n"), F.min("source").alias("source"))
    by_source = Window.partitionBy("skey")
    starts = sums.select(
        "skey", "source", "cell",
        F.coalesce(F.sum("n").over(by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_source).alias("source_size"))
    per_source = starts.groupBy("skey").agg(F.min("source").alias("source"), F.max("source_size").alias("source_size"))
    targets = source_targets(per_source, weights)
    # The counts so far never fall, so their order is that of the shards.
    quotas = sainte_lague(targets, block, n_shards).groupBy("skey").agg(
        F.sum("quota").alias("blocks"), F.sort_array(F.collect_list("upto")).alias("dealt"))
    # What a source takes: `passes` whole passes, then `rest` of its `n` full
    # blocks, spread evenly from a seeded phase. The words left over at the end
    # of the stream, less than a block, belong to whole passes only.
    plan = (targets.join(quotas, "skey", "left").fillna(0, ["blocks"])
            .withColumn("words", F.least(F.col("blocks") * block, F.col("source_size") * MAX_REPEATS))
            .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
            .withColumn("n", F.expr(f"source_size div {block}"))
            .withColumn("rest", F.least(F.col("n"), F.round((F.col("words") - F.col("passes") * F.col("source_size")) / block).cast("long")))
            .withColumn("phase", F.when(F.col("n") > 0, F.pmod(_unit(F.concat_ws(":", F.lit(f"phase{seed}"), F.col("skey"))), F.col("n"))).otherwise(0))
            .withColumn("all_words", F.col("passes") * F.col("source_size") + F.col("rest") * block)
            .withColumn("ends", F.expr(f"transform(coalesce(dealt, array(0L)), (u, j) -> if(j = size(dealt) - 1, all_words, least(u * {block}, all_words)))"))
            .withColumn("starts", F.expr("concat(array(0L), slice(ends, 1, size(ends) - 1))"))
            .select("skey", "source_size", "target", "blocks", "n", "passes", "rest", "phase", "starts", "ends"))
    cells_of = starts.select("skey", "cell", "before").join(plan, "skey")
    within = Window.partitionBy("skey", "cell").orderBy("rnd", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("upto", F.sum("size").over(within))
              .join(cells_of, ["skey", "cell"])
              .withColumn("hi", F.col("before") + F.col("upto"))
              .withColumn("lo", F.col("hi") - F.col("size")))
    # Blocks below b that the last pass selects (in decimals: the product passes
    # 64 bits on large corpora), and the words of the stream below x in them.
    def chosen(b: str) -> str:
        return f"((cast({b} as decimal(18,0)) * cast(rest as decimal(18,0)) + phase) div n)"

    def covered(x: str) -> str:
        b = f"({x} div {block})"
        return (f"(CASE WHEN rest = 0 THEN 0L WHEN {b} >= n THEN rest * {block} ELSE {chosen(b)} * {block} + "
                f"({chosen(b + ' + 1')} - {chosen(b)}) * ({x} - {b} * {block}) END)")

    # Where a document lies in the blocks taken of its source, laid end to end:
    # once in every whole pass, and once in the last one.
    places = F.expr(f"""concat(
        transform(if(passes > 0, sequence(0L, passes - 1), cast(array() as array<bigint>)),
                  p -> named_struct('lo', p * source_size + lo, 'hi', p * source_size + hi)),
        array(named_struct('lo', passes * source_size + {covered('lo')}, 'hi', passes * source_size + {covered('hi')})))""")
    words = F.expr("""filter(
        transform(ends, (e, j) -> named_struct('shard', j, 'words', aggregate(
            places, 0L, (sum, p) -> sum + greatest(0L, least(p.hi, e) - greatest(p.lo, starts[j]))))),
        x -> x.words > 0)""")
    taken = F.expr("aggregate(shards, 0L, (sum, x) -> sum + x.words)")
    return placed.withColumn("places", places).withColumn("shards", words).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.alias("taken"), "blocks", "shards",
        *[F.col(f"kept.`{c}`").alias(c) for c in keep if c not in (id_col, source_col)])


def draw(df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0,
         **options) -> DataFrame:
    """The mix as whole documents, with all columns of ``df``: each document
    comes ``taken / size`` times, rounded down or up by a seeded draw, so that a
    source's words come near its target. Documents without a word are not
    drawn."""
    names = df.columns
    mixed = mix(df.select(F.struct(*[F.col(c) for c in names]).alias("row"), id_col, source_col, text_col),
                id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, keep=("row",), **options)
    share = _unit(F.concat_ws(":", F.lit(f"draw{seed}"), F.col(id_col).cast("string"))) / F.lit(float(1 << 60))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + share)).otherwise(0).cast("int")
    drawn = mixed.select("row", copies.alias("n")).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
