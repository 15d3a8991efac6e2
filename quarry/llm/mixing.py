"""Mixing sources to target weights by Pareto order sampling.

Sources share the wanted words by weight; none takes more than ``cap`` times its size, the excess
being shared again. Within a source a document's expected copies grow slowly with its length class,
so that the source's words meet its target. Whole copies are certain. For the rest, documents are
ranked by the Pareto order: random odds u / (1 - u) over inclusion odds p / (1 - p), with u a hash of
doc_id. The first ones are taken until the words are spent; the last one is taken in part. Ranks are
cut into bins by source, and the bin in which the words are spent into as many again, so only what
stands in one of these is ever sorted, without texts. A source's last rank is sent to all tasks.

Defined results: a null text has size 0 and is taken 0 times, a null source is a source of its own,
the last one; a null doc_id is replaced by a hash of the text in the odds; documents of equal odds are ordered by
doc_id, then by a hash of the text. Rows that are equal in all these count each; if the words are spent among them,
they share the rest equally, rounded down. An empty table
gives an empty result; other columns are kept by ``mix``, but for those named size, source_size,
target or taken, which it replaces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Expected copies grow by this share with each doubling of a document's length.
FAVOUR = 0.05
#: Bins of a source's ranks.
BINS = 4096
#: The bound of what goes to the driver: 64 length classes of so many sources.
MAX_SOURCES = 100_000
#: Rows of that plan, of about 60 bytes, up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+ of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words wanted of each source: ``share`` of all sizes by weight, none above ``cap`` times its size."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        for i in above or open_:
            out[i] = cap * sizes[i] if above else unit * weights[i]
        if not above:
            break
        rest -= sum(out[i] for i in above)
        open_ -= above
    return out


def expected(sizes: dict[int, int], target: float, cap: float = CAP, favour: float = FAVOUR) -> dict[int, float]:
    """Expected copies of a document of each length class, min(cap, x * (1 + favour * class)), that meet the target."""
    free, out = {k: 1 + favour * k for k, v in sizes.items() if v}, {k: 0.0 for k in sizes}
    while free:
        x = target / sum(sizes[k] * w for k, w in free.items())
        above = {k for k, w in free.items() if x * w > cap}
        for k in above or list(free):
            out[k] = cap if above else x * free[k]
            target -= cap * sizes[k] if above else 0
            del free[k]
    return out


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, text: str | None = "text", seed: int = 42) -> DataFrame:
    """``docs`` with size, source_size, target and taken (long, words). With ``text`` None the columns size and text_hash are given."""
    spark = docs.sparkSession
    given = [c for c in docs.columns if c != "size" or not text]
    docs = docs.withColumn("size", words(F.col(text))).withColumn("_text", text_hash(F.col(text))) if text else docs.withColumn("_text", F.col("text_hash"))
    docs = docs.withColumn("_id", F.col("doc_id"))
    lean = docs.select("doc_id", "_id", "source", "size", "_text")
    lean = keep(lean, "sizes") if text else lean
    klass = F.floor(F.log2(F.col("size") + 1.0)).cast("int")
    rows = lean.groupBy("source", klass.alias("class")).agg(F.sum("size").alias("words")).limit(64 * MAX_SOURCES + 1).collect()
    of: dict[str | None, dict[int, int]] = {}
    for r in rows:
        of.setdefault(r["source"], {})[r["class"]] = r["words"]
    names = sorted(of, key=lambda x: (x is None, x or ""))
    if len(names) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sizes = [sum(of[x].values()) for x in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, cap)
    plan = []
    for name, size, goal in zip(names, sizes, wanted):
        expected_ = expected(of[name], goal, cap)
        certain = sum(math.floor(expected_[k]) * n for k, n in of[name].items())
        plan += [(name, k, expected_[k], size, float(goal), round(goal) - certain) for k in of[name]]
    kind = docs.schema["source"].dataType.simpleString()
    few = (lambda x: F.broadcast(x)) if len(plan) <= BROADCAST_ROWS else (lambda x: x)
    plan = few(spark.createDataFrame(plan, f"_source {kind}, _class int, _copies double, source_size long, target double, _rest long"))

    def ranked(frame: DataFrame) -> DataFrame:
        """With the odds, and two bins: ``_bin`` of BINS and ``_fine`` of BINS in each."""
        out = frame.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (klass == F.col("_class")))
        u = (F.shiftrightunsigned(F.when(F.col("_id").isNull(), F.xxhash64(F.lit(seed), "_text")).otherwise(F.xxhash64(F.lit(seed), "_id")), 11) + 0.5) / float(1 << 53)
        p = F.col("_copies") - F.floor("_copies")
        odds = F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))
        place = F.col("_odds") / (1 + F.col("_odds")) * BINS
        return out.withColumn("_odds", odds).withColumn("_bin", F.floor(place)).withColumn("_fine", F.floor(place * BINS))

    def spent(frame: DataFrame, by: str, before: Column) -> DataFrame:
        """(_at, _edge: by, _before): of each source the first bin within which the words are spent, and the words before it."""
        sums = frame.groupBy("_source", by).agg(F.sum("size").alias("_words"), F.max("_rest").alias("_rest"), F.max(before).alias("_start"))
        up = Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # BINS rows at most
        sums = sums.withColumn("_upto", F.col("_start") + F.sum("_words").over(up)).filter("_upto > _rest")
        edge = sums.groupBy("_source").agg(F.min_by(F.struct(F.col(by), (F.col("_upto") - F.col("_words")).alias("_before")), by).alias("_edge"))
        return keep(edge.select(F.col("_source").alias("_at"), F.col(f"_edge.{by}").alias("_edge"), "_edge._before"), "edges")

    at = F.col("_source").eqNullSafe(F.col("_at"))
    draws = ranked(lean).filter("_odds IS NOT NULL")
    edge = spent(draws, "_bin", F.lit(0))
    inner = draws.join(F.broadcast(edge), at).filter("_bin = _edge").withColumnRenamed("_before", "_outer").drop("_at", "_edge")  # a row per source
    fine = spent(inner, "_fine", F.col("_outer"))
    last = inner.join(F.broadcast(fine), at).filter("_fine = _edge").groupBy("_source", "_odds", "_id", "_text").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n"), F.max("_rest").alias("_rest"), F.max("_before").alias("_before"))
    rank = F.struct("_odds", "_id", "_text")
    order = Window.partitionBy("_source").orderBy("_odds", "_id", "_text").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_upto", F.col("_before") + F.sum("_words").over(order)).filter("_upto > _rest")
    last = last.groupBy("_source").agg(F.min_by(F.struct(rank.alias("_rank"), F.floor((F.col("_rest") - F.col("_upto") + F.col("_words")) / F.col("_n")).alias("_part")), rank).alias("_last"))
    last = keep(last.select(F.col("_source").alias("_at"), F.col("_last._rank").alias("_rank"), F.col("_last._part").alias("_part")), "last")
    all_ = ranked(docs).join(F.broadcast(last), at, "left")  # a row per source
    drawn = F.when(F.col("_odds").isNull(), F.lit(0)).when(F.col("_rank").isNull() | (rank < F.col("_rank")), F.col("size")).when(rank == F.col("_rank"), F.least(F.col("size"), F.greatest(F.lit(0), F.col("_part")))).otherwise(F.lit(0))
    taken = F.floor("_copies") * F.col("size") + drawn
    columns = [c for c in given if c not in ("size", "source_size", "target", "taken")]
    return all_.select(*columns, "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a mix, each as often as it is taken; a part of a text is its first words."""
    rest = F.col("taken") % F.col("size")
    whole = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(pieces, 1, rest.cast("int")), "")
    out = mixed.filter("taken > 0").withColumn("_copy", F.explode(whole))
    last = (F.col("_copy") == F.ceil(F.col("taken") / F.col("size"))) & (rest > 0)
    return out.withColumn(text, F.when(last, F.regexp_replace(part, r"[\x20\x09-\x0D]+$", "")).otherwise(F.col(text)))
