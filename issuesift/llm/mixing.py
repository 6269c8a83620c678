"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents in a seeded random order,
cut into blocks of equal length. The mix is a sequence of slots. Slot ``n``
has the golden-ratio point ``frac(n * 0.618...)``; the cumulative shares of
the sources map it to a source, its rank among that source's slots names the
block it takes (a source's second pass starts when its blocks are used up),
and a join of slots and blocks yields the words of each document the mix
takes. No Python runs on the data and no step gathers a source in one task:
running sums and ranks go over cells of bounded size plus cell offsets.

Defined cases: null text has no words; a null source is a source of its own,
ordered last; documents without words are returned with 0 words taken;
repeated rows are separate documents; an empty table gives an empty result;
columns other than the three named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage

GOLDEN = 1327217885  # round(2**31 * (sqrt(5) - 1) / 2), odd: a full cycle modulo 2**31
RING = 1 << 31
POINT_CELL = 1 << 21  # 1,024 cells of points for the range join
SLOT_CELL = 1 << 14  # slots ranked together
DOC_CELL = 1024  # documents summed together, about
SPARE = 8  # slots beyond a source's blocks, above the sequence's discrepancy


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """Words wanted of each source. ``sizes``: one row per source
    (``source``, ``source_size``). Sources in code-point order, null last, get
    ``weights`` in turn and share ``budget`` times all words; a share above
    ``cap`` times the source's size stops there and the excess is shared again.

    Water-filling in closed form: with sources ordered by size per weight, a
    source is full when the level of those after it reaches its own."""
    everyone = Window.partitionBy()
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.element_at(cycle, (F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1).cast("int")))
    before = Window.orderBy("per_weight", "src").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(c: str | Column) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0.0))

    most = F.lit(cap) * F.col("source_size")
    leveled = (ranked.withColumn("most", most).withColumn("per_weight", F.col("most") / F.col("w"))
               .withColumn("all", F.lit(budget) * F.sum("source_size").over(everyone))
               .withColumn("level", (F.col("all") - so_far("most")) / (F.sum("w").over(everyone) - so_far("w")))
               .withColumn("full", F.col("per_weight") <= F.col("level")))
    left = F.col("all") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everyone)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everyone)
    return leveled.select("source", "src", "source_size", F.when(F.col("full"), F.col("most")).otherwise(
        F.try_divide(left * F.col("w"), open_w)).alias("target"))


class Mix:
    """The parts of a mix: ``docs`` (one row per document: ``doc_id``,
    ``source``, ``copy``, ``size``, ``source_size``, ``target``) and ``slots``
    (one row per slot and document it takes words from: ``slot``, ``epoch``,
    ``doc_id``, ``source``, ``copy``, ``word_start``, ``n_words``)."""

    def __init__(self, docs: DataFrame, slots: DataFrame):
        self.docs, self.slots = docs, slots

    def taken(self) -> DataFrame:
        """``docs`` with the words the mix takes of each, repeats counted."""
        key = ["doc_id", "source", "copy"]
        used = self.slots.groupBy(*key).agg(F.sum("n_words").alias("taken"))
        d, u = self.docs.alias("d"), used.alias("u")
        on = [F.col(f"d.{c}").eqNullSafe(F.col(f"u.{c}")) for c in key]
        return d.join(u, on, "left").select("d.*", F.coalesce("u.taken", F.lit(0)).alias("taken"))


def numbered_copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """``doc_id``, ``source``, ``copy``: rows that share id and source are
    numbered from 1, by their text's hash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *more,
                       F.xxhash64(F.col(text_col)).alias("_text"))
    w = Window.partitionBy("doc_id", "source").orderBy("_text")
    return rows.withColumn("copy", F.row_number().over(w)).drop("_text")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, block: int = 128,
        seed: int = 7) -> Mix:
    """Mix the sources of ``docs`` to their targets in blocks of ``block`` words.
    The same input gives the same mix, whatever the partitioning."""
    sized = stage(numbered_copies(docs, id_col, text_col, source_col, n_words(F.col(text_col)).alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per_source = stage(per_source, "mix-sources")
    plan = stage(_plan(targets(per_source.drop("n_docs"), weights, budget, cap), per_source, block), "mix-plan")

    d = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    full = d.select("d.*", "p.source_size", "p.target")
    pieces = _pieces(d.where("d.size > 0").select("d.doc_id", "d.copy", "d.size", "p.src", "p.source", "p.cells"), block, seed)
    chosen = _slots(plan.where("blocks > 0"))
    p, s = pieces.alias("p"), chosen.alias("s")
    limit = F.col("s.words") - F.col("s.epoch") * F.col("s.source_size")
    length = F.least(F.col("p.piece_end"), limit) - F.col("p.piece_start")
    slots = (p.join(s, (F.col("p.src") == F.col("s.src")) & (F.col("p.block") == F.col("s.block")))
             .select("s.slot", "s.epoch", "p.doc_id", "p.source", "p.copy",
                     (F.col("p.piece_start") - F.col("p.doc_start")).alias("word_start"), length.alias("n_words"))
             .where("n_words > 0"))
    return Mix(full, slots)


def _plan(wanted: DataFrame, per_source: DataFrame, block: int) -> DataFrame:
    """Per source: its words, passes and blocks to take, its interval of
    points, and the cells its documents are summed in."""
    w, n = wanted.alias("w"), per_source.alias("n")
    p = w.join(n, F.col("w.source").eqNullSafe(F.col("n.source"))).select("w.*", "n.n_docs")
    size = F.col("source_size")
    p = (p.withColumn("words", F.when(size > 0, F.floor("target")).otherwise(F.lit(0)).cast("long"))
         .withColumn("n_blocks", F.ceil(size / F.lit(block)).cast("long"))
         .withColumn("passes", F.when(size > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
         .withColumn("blocks", F.col("passes") * F.col("n_blocks")
                     + F.ceil((F.col("words") - F.col("passes") * size) / F.lit(block)).cast("long"))
         .withColumn("share", F.when(F.col("blocks") > 0, F.col("blocks") + SPARE).otherwise(0))
         .withColumn("upto", F.sum("share").over(Window.orderBy("src")))
         .withColumn("n_slots", F.sum("share").over(Window.partitionBy()))
         .withColumn("cells", F.ceil(F.col("n_docs") / DOC_CELL).cast("long")))
    scale = F.lit(float(RING)) / F.greatest(F.col("n_slots"), F.lit(1))
    return (p.withColumn("lo", F.floor((F.col("upto") - F.col("share")) * scale).cast("long"))
            .withColumn("hi", F.floor(F.col("upto") * scale).cast("long")))


def _pieces(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """Each document's share of each block of its source's shuffled words."""
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(1 << 40)))
    rows = rows.withColumn("_cell", F.floor(F.col("_h") / F.lit(float(1 << 40)) * F.col("cells")).cast("long"))
    order = Window.partitionBy("src", "_cell").orderBy("_h", "doc_id", "copy")
    run = rows.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = rows.groupBy("src", "_cell").agg(F.sum("size").alias("_sum"))
    cells = cells.withColumn("_base", F.sum("_sum").over(Window.partitionBy("src").orderBy("_cell")) - F.col("_sum"))
    run = run.join(cells.drop("_sum"), ["src", "_cell"])
    end = F.col("_base") + F.col("_end")
    run = run.withColumn("doc_end", end).withColumn("doc_start", end - F.col("size"))
    run = run.withColumn("block", F.explode(F.sequence(F.expr(f"doc_start div {block}"), F.expr(f"(doc_end - 1) div {block}"))))
    return run.select("src", "source", "block", "doc_id", "copy", "doc_start",
                      F.greatest("doc_start", F.col("block") * block).alias("piece_start"),
                      F.least("doc_end", (F.col("block") + 1) * block).alias("piece_end"))


def _slots(plan: DataFrame) -> DataFrame:
    """The schedule: slot, its source, the pass and the block it takes."""
    spark = plan.sparkSession
    n = plan.agg(F.max("n_slots")).first()[0] or 0
    points = spark.range(n).select(F.col("id").alias("slot"),
                                   F.pmod(F.pmod(F.col("id"), F.lit(RING)) * GOLDEN, F.lit(RING)).alias("point"))
    points = points.withColumn("_c", F.expr(f"point div {POINT_CELL}"))
    ranges = plan.where("hi > lo").withColumn(
        "_c", F.explode(F.sequence(F.expr(f"lo div {POINT_CELL}"), F.expr(f"(hi - 1) div {POINT_CELL}"))))
    hit = (points.join(ranges.select("_c", "src", "lo", "hi"), "_c").where("point >= lo and point < hi")
           .select("slot", "src", F.expr(f"slot div {SLOT_CELL}").alias("_part")))
    ranked = hit.withColumn("_r", F.row_number().over(Window.partitionBy("src", "_part").orderBy("slot")))
    base = hit.groupBy("src", "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_base", F.sum("_n").over(Window.partitionBy("src").orderBy("_part")) - F.col("_n")).drop("_n")
    rank = ranked.join(base, ["src", "_part"]).select("slot", "src", (F.col("_base") + F.col("_r") - 1).alias("rank"))
    out = rank.join(plan.select("src", "blocks", "n_blocks", "source_size", "words"), "src").where("rank < blocks")
    return out.select("slot", "src", F.expr("rank div n_blocks").alias("epoch"),
                      F.expr("rank % n_blocks").alias("block"), "source_size", "words")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **settings) -> DataFrame:
    """The mix as documents: a document appears once for each pass that takes
    it, a document that a pass takes in part ends after the words taken, one
    that is not taken is left out. Columns are those of ``docs``."""
    names = docs.columns
    m = mix(docs, id_col, text_col, source_col, **settings)
    passes = m.slots.groupBy("doc_id", "source", "copy", "epoch").agg(F.sum("n_words").alias("_take"))
    p, k = passes.alias("p"), m.docs.alias("k")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("doc_id", "source", "copy")]
    use = p.join(k, same).select("p.doc_id", "p.source", "p.copy", "p._take", "k.size")

    # the window and the join share one partitioning by these, so texts are shuffled once
    def keys(df: DataFrame, i: str, s: str) -> DataFrame:
        return df.withColumns({"_i": F.coalesce(F.col(i).cast("string"), F.lit("")), "_in": F.col(i).isNull(),
                               "_s": F.coalesce(F.col(s), F.lit("")), "_sn": F.col(s).isNull()})

    key = ["_i", "_in", "_s", "_sn"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
                         F.col(f"`{source_col}`").alias("_src"), F.xxhash64(F.col(f"`{text_col}`")).alias("_h"))
    rows = keys(packed, "_id", "_src").withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy("_h")))
    r, u = rows.alias("r"), keys(use, "doc_id", "source").alias("u")
    on = [F.col(f"r.{c}") == F.col(f"u.{c}") for c in key]
    got = r.join(u, [*on, (F.col("r._copy") - F.col("u.copy")) == 0]).select("_row", "_take", "size")
    whole = F.col("_row")[text_col]
    # the split's last part is all that follows the words wanted
    rest = F.element_at(F.split(F.concat(F.lit("x "), whole), r"[\x20\x09-\x0D]+", (F.col("_take") + 2).cast("int")), -1)
    cut = whole.substr(F.lit(1), F.length(whole) - F.length(rest))
    text = F.when(F.col("_take") < F.col("size"), cut).otherwise(whole)
    return got.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in names])
