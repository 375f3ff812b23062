"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

A source's texts are laid out in an order drawn by a hash and cut into blocks of equally many words. A source needs as
many slots as its target has blocks; the mix has the slots that all sources need. Slot i falls on the point
frac((i + 1) * golden ratio), which the sources' cumulative needs map to a source; the k-th slot of a source takes its
k-th block, over again for a second pass. The last block is cut at the target. The points come within a few slots of
each source's need: slots beyond it are left out, and a source that is short of some gets these evenly spread over the mix, so each takes its
target to the word.

Sums along a source or the slots are taken within small buckets and added to sums over buckets, so no source is one
group. Null and empty texts have size 0 and take nothing; a very long text is as many blocks as it has. A null source is
a source, the last. Repeated rows are told apart and lie next to each other; with all sizes 0 nothing is taken, and an
empty table gives an empty table. Columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

#: Words in a block; texts in a bucket, about; slots in a chunk; cells of the weight axis.
BLOCK, BUCKET, CHUNK, CELLS = 32, 2_000, 1 << 14, 1024
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Golden ratio's fraction, and that of 2^14 times it.
_PHI = (math.sqrt(5) - 1) / 2
_PHI_CHUNK = (CHUNK * _PHI) % 1


def words(text: Column) -> Column:
    """Runs of characters that are no ASCII white space, counted; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, source_size. Adds sid (order by code point, null last), weight, target.

    Water-filling: the target is the lesser of most * size and level * weight, with the one level at which targets
    add up. Sources are few next to texts; sums over them run in one task.
    """
    n = len(weights)
    ranked = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % n + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = W.partitionBy()
    before = by.rowsBetween(W.unboundedPreceding, -1)
    # If the sources before this one in order of cap / weight stop at their cap, the rest shares at this level.
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("try", level)
    fits = F.when(F.col("try") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "try"))
    ranked = ranked.withColumn("level", F.min(fits).over(whole).getField("try"))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return ranked.select("source", "sid", "source_size", "weight", target.alias("target"))


def _layout(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """rid, doc_id, source, size, h (of the text), key: one row a text, in files."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), F.xxhash64(text).alias("h"))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return C.scratch(source.withColumn("key", key).withColumn("rid", F.monotonically_increasing_id()), "sizes")


def schedule(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """Two tables. Texts: rid, doc_id, h, source, size, source_size, target. Mix: slot, sid, rank, rid, start, length: the
    words of a text (from start in it) that a slot takes. The mix is in order of slot, then sid, rank and start."""
    texts = _layout(docs, id_col, text_col, source_col, seed)
    by_source = texts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_texts"))
    plan = targets(by_source.select("source", "source_size"), weights, share, most)
    plan = plan.join(by_source.select(F.col("source").alias("s2"), "n_texts"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    # Slots for whole passes, and for the blocks that the last pass begins.
    goal, size = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    need = F.floor(goal / size) * F.ceil(size / block) + F.ceil((goal % size) / block)
    plan = C.scratch(plan.withColumn("goal", goal).withColumn("need", F.when(F.col("source_size") > 0, need).otherwise(0).cast("long")), "plan")
    total = plan.agg(F.sum("need").alias("slots"), F.count("*").alias("n")).first()
    n_slots = total["slots"] or 0

    # Where each text starts in its source: sums over buckets of the hash order, then within the bucket.
    known = texts.join(F.broadcast(plan) if total["n"] <= 10_000 else plan, texts["source"].eqNullSafe(plan["source"])).select("rid", "doc_id", "h", texts["source"], "size", "key", "sid", "source_size", "target", "n_texts")
    buckets = F.ceil(F.col("n_texts") / BUCKET)
    known = known.withColumn("bucket", F.floor((F.shiftrightunsigned("key", 33) / F.lit(float(1 << 31))) * buckets))
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    within = W.partitionBy("sid", "bucket").orderBy(F.shiftrightunsigned("key", 33), "key", "doc_id", "size", "h", "rid")
    inside = known.withColumn("inner", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = C.scratch(inside.join(starts, ["sid", "bucket"]).withColumn("at", F.col("before") + F.col("inner")).drop("before", "inner", "key", "bucket", "n_texts"), "placed")

    # The source at each slot: cells of the axis of needs join the points to the few sources that reach into a cell.
    edge = F.sum("need").over(W.orderBy("sid"))
    facts = ("sid", "source_size", "goal", "need")
    axis = plan.select(*facts, ((edge - F.col("need")) / max(1, n_slots)).alias("lo"), (edge / max(1, n_slots)).alias("hi")).where("need > 0")
    last = F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS).cast("int"))
    cells = C.scratch(axis.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), last))), "axis")
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    turn = F.col("chunk") * F.lit(_PHI_CHUNK) + (F.col("slot") % CHUNK + 1) * F.lit(_PHI)
    slots = slots.withColumn("point", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    drawn = slots.join(F.broadcast(cells) if total["n"] <= 10_000 else cells, "cell").where("lo <= point AND point < hi").select("slot", "chunk", *facts)
    drawn = C.scratch(drawn, "slots")

    # Rank of a slot among its source's: counts by chunk, then within the chunk.
    counts = C.scratch(drawn.groupBy("sid", "chunk").count(), "counts")
    ahead = counts.select("sid", "chunk", (F.sum("count").over(W.partitionBy("sid").orderBy("chunk")) - F.col("count")).alias("ahead"))
    near = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("near", near).join(ahead, ["sid", "chunk"]).withColumn("rank", F.col("ahead") + F.col("near")).where("rank < need")
    # The few slots that a source is short of, from a place that differs by source.
    given = counts.groupBy("sid").agg(F.sum("count").alias("given"))
    short = plan.select(*facts).join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long"))).where("given < need")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("need") - 1)))
    place = F.col("sid") * F.lit(_PHI) + (F.col("rank") - F.col("given") + 0.5) / (F.col("need") - F.col("given"))
    short = short.withColumn("slot", F.floor((place - F.floor(place)) * n_slots).cast("long"))
    ranked = ranked.select("slot", "rank", *facts).unionByName(short.select("slot", "rank", *facts))
    n_blocks = F.ceil(F.col("source_size") / block)
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / n_blocks)).withColumn("block", F.col("rank") % n_blocks)
    left = F.col("goal") - F.col("pass") * F.col("source_size") - F.col("block") * block
    ranked = ranked.withColumn("words", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block, left))

    pieces = placed.where("size > 0").select("sid", "rid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    joined = ranked.select("sid", "block", "slot", "rank", "words").join(pieces, ["sid", "block"])
    start = F.greatest(F.col("at"), F.col("block") * block)
    stop = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words"))
    mix = joined.select("slot", "sid", "rank", "rid", (start - F.col("at")).alias("start"), (stop - start).alias("length")).where("length > 0")
    return placed.select("rid", "doc_id", "h", "source", "size", "source_size", "target"), mix


def _counts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    texts, mix = schedule(spark, docs, **options)
    taken = mix.groupBy("rid").agg(F.sum("length").alias("taken"))
    return texts.join(taken, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix_counts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """A row for each text: doc_id, size, source_size, target, taken."""
    return _counts(spark, docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of docs that the mix takes, with the columns of docs: as often as whole, and once cut to the words taken
    beyond that. Texts that it does not take are absent. Rows of one id, source and text share what all of them have."""
    p = "_mix"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    size, taken, part, key, src, h = (f"{p}{x}" for x in ("size", "taken", "part", "id", "source", "h"))
    counts = _counts(spark, docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy(F.col("doc_id").alias(key), F.col("source").alias(src), F.col("h").alias(h)).agg(F.sum("size").alias(size), F.sum("taken").alias(taken))
    counts = C.scratch(counts, "taken").where(F.col(taken) > 0)
    joined = docs.join(counts, docs[id_col].eqNullSafe(counts[key]) & docs[source_col].cast("string").eqNullSafe(counts[src]) & (F.xxhash64(docs[text_col].cast("string")) == counts[h]))
    whole = F.floor(F.col(taken) / F.col(size)).cast("int")
    rest = F.col(taken) / F.col(size) - whole
    some = F.round(rest * words(F.col(text_col))).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(some > 0, F.array(some)).otherwise(F.array().cast("array<int>")))
    out = joined.withColumn(part, F.explode(parts))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), 1, F.greatest(F.col(part), F.lit(1))), " ")
    out = out.withColumn(text_col, F.when(F.col(part) < 0, F.col(text_col)).otherwise(cut))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
