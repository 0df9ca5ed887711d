"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target in words: a share of the whole by weight, stopped at ``max_epochs`` times the
source's own words, the excess reshared by weight. Inside a source a document of more words is expected more often:
its expected copies rise with the power ``tilt`` of its size (by classes of four to a doubling), stop at ``max_epochs``, and
fill the source's target on the whole. The whole part of the expected copies is certain, and the rest is the
document's inclusion probability in a sample of fixed size in words: documents are ranked by random odds over
inclusion odds (Pareto order sampling, Rosén 1997) and taken in that order. With a tilt of 0 all documents of a source
are alike.

The order is cut without sorting a source in one task: ranks fall into buckets of about ``per_bucket``
documents, the buckets' sums say in which of them the cut lies, and only that one is walked row by row,
each document being taken if it still fits. What is then left of the target goes on to the buckets after
it, of whose documents only those count that still fit, and so on until none does. So documents are taken
just as by a walk over the whole order.

Random numbers come from the MD5 of seed and doc_id, so reruns agree.

Defined cases: a null or empty text has size 0 and takes 0 words; null is a source of its own, last in order; sources
without words have target 0; repeated rows count as documents of their own with the same random number; null doc_ids
share one; ties in the order go by doc_id, then size; very long texts are counted whole, and one that
doesn't fit into what is left of a target is passed over; an empty table gives an empty result; other columns,
whatever their names, are not read (``mixed_documents`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import WORD, Scratch, text_of


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size in words."""
    return docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("bigint").alias("size")
    )


def source_targets(sized: DataFrame, weights: Sequence[float], total: float, max_epochs: float) -> DataFrame:
    """source, source_size, n_docs and target: the closed form of resharing until none is above its cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("_r", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_all", F.sum("source_size").over(whole) * float(total))
    per = per.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # The first source, by cap per weight, that its level doesn't fill sets the level of all that follow.
    per = per.withColumn("_open", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    per = per.withColumn("_level", F.first("_open", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    return per.select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("_level") * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def document_shares(sized: DataFrame, targets: DataFrame, tilt: float, max_epochs: float) -> DataFrame:
    """Per source and class of sizes: _whole, certain copies, and _p, inclusion probability of one more.

    Expected copies are min(max_epochs, level * 2^(class * tilt / 4)) with the level that fills the source's
    target: the closed form for the first class, from the largest down, that its level doesn't stop.
    """
    weight, cap = F.pow(F.lit(2.0), F.col("_class") * (tilt / 4)), F.lit(float(max_epochs))
    per = sized.groupBy("source", "_class").agg(F.sum("size").alias("_s")).withColumnRenamed("source", "_own")
    per = per.join(targets, per["_own"].eqNullSafe(targets["source"])).drop("_own").withColumn("_w", weight)
    order = Window.partitionBy("source").orderBy(F.desc("_class"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("target") - cap * F.coalesce(F.sum("_s").over(before), F.lit(0))) / F.nullif(F.sum(F.col("_s") * F.col("_w")).over(after), F.lit(0.0))
    per = per.withColumn("_level", level)
    per = per.withColumn("_level", F.first(F.when(F.col("_level") * F.col("_w") <= cap, F.col("_level")), ignorenulls=True).over(every))
    copies = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(cap, F.col("_level") * F.col("_w")), cap))
    per = per.withColumn("_whole", F.floor(copies)).withColumn("_p", copies - F.floor(copies))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("_whole") * F.col("_s")).over(every))
    mean = rest / F.nullif(F.sum(F.when(F.col("_p") > 0, F.col("_s"))).over(every), F.lit(0))
    return per.select("source", "_class", "_whole", "_p", rest.alias("_rest"), F.least(mean, F.lit(1 - 1e-9)).alias("_mean"))


def _walk(rows: DataFrame, span: DataFrame) -> DataFrame:
    """_source, _at, _docs, _took, _left: the next bucket of each source that what is left doesn't cover, walked in order."""
    state = span.select("_source", F.col("_at").alias("_from"), F.col("_left").alias("_had"))
    rows = rows.join(F.broadcast(state), rows["source"].eqNullSafe(state["_source"])).where("_bucket > _from")
    per = rows.where("size <= _had").groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_had").alias("_had"))
    upto = Window.partitionBy("_source").orderBy("_bucket")
    per = per.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum"))
    cut = per.where((F.col("_before") <= F.col("_had")) & (F.col("_before") + F.col("_sum") > F.col("_had")))
    cut = cut.select(F.col("_source").alias("_cut_source"), F.col("_bucket").alias("_at"), (F.col("_had") - F.col("_before")).alias("_room"))
    found = rows.join(F.broadcast(cut), rows["_source"].eqNullSafe(cut["_cut_source"]) & (rows["_bucket"] == cut["_at"]))
    found = found.groupBy("_source", "_at", "_room").agg(
        F.array_sort(F.collect_list(F.struct("_q", "doc_id", "size", "source", "source_size", "target", "_whole"))).alias("_docs")
    )
    start = F.struct(F.col("_room").alias("left"), F.array().cast("array<bigint>").alias("took"))

    def step(state, doc):
        fits = doc["size"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - doc["size"]).otherwise(state["left"]).alias("left"), F.concat(state["took"], F.array(F.when(fits, 1).otherwise(0).cast("bigint"))).alias("took")
        )

    found = found.withColumn("_end", F.aggregate("_docs", start, step))
    return found.select("_source", "_at", "_docs", F.col("_end.took").alias("_took"), F.col("_end.left").alias("_left"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    max_epochs: float = 2.0,
    tilt: float = 0.25,
    seed: int = 17,
    per_bucket: int = 256,
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies, taken (size times copies)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = sizes(docs, id_col, text_col, source_col).withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    sized = scratch.save(sized, "sizes")
    targets = scratch.save(source_targets(sized, weights, total, max_epochs).coalesce(1), "targets")
    shares = scratch.save(document_shares(sized, targets, tilt, max_epochs), "shares")
    of = targets.select(F.col("source").alias("_source"), "source_size", "target", F.ceil(F.col("n_docs") / per_bucket).alias("_buckets"))
    per = of.join(shares, of["_source"].eqNullSafe(shares["source"])).drop("source").withColumnRenamed("_class", "_of")
    rows = sized.join(per, sized["source"].eqNullSafe(per["_source"]) & (sized["_class"] == per["_of"])).drop("_source", "_of")
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / float(2**52)
    p, mean = F.col("_p"), F.col("_mean")
    odds = (u / (1 - u)) / F.nullif(p / (1 - p), F.lit(0.0))
    # A place in [0, 1) that rises with the odds, and is uniform if all documents of a source have the same p.
    level = odds * mean / (1 - mean)
    place = F.least(level / (1 + level), F.lit(1 - 1e-12))
    rows = rows.withColumn("_q", F.when(p > 0, odds)).withColumn("_bucket", F.coalesce(F.floor(place * F.col("_buckets")), F.lit(0).cast("bigint")))
    kept = ["doc_id", "size", "source", "source_size", "target", "_whole"]
    rows = scratch.save(rows.select(*kept, "_q", "_bucket"), "rows")
    open_ = rows.where(F.col("_q").isNotNull())
    # _at, _left: what is left of a source's target after its bucket _at; one row for each cut so far.
    spans = [scratch.save(shares.select(F.col("source").alias("_source"), F.lit(-1).cast("bigint").alias("_at"), F.col("_rest").alias("_left")).distinct(), "span0")]
    walks = []
    while True:
        walked = scratch.save(_walk(open_, spans[-1]), f"walk{len(walks)}")
        if walked.isEmpty():
            break
        walks.append(walked)
        spans.append(scratch.save(walked.select("_source", "_at", "_left"), f"span{len(walks)}"))
    cuts = reduce(DataFrame.unionByName, spans).groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("_at", "_left"))).alias("_cuts"))
    rows = rows.join(F.broadcast(cuts), rows["source"].eqNullSafe(cuts["_source"])).drop("_source")
    last = F.element_at(F.filter("_cuts", lambda c: c["_at"] <= F.col("_bucket")), -1)
    rows = rows.withColumn("_last", last)
    at_cut = F.col("_q").isNotNull() & (F.col("_last._at") == F.col("_bucket"))
    fits = F.col("_q").isNotNull() & (F.col("size") <= F.col("_last._left"))
    out = rows.where(~at_cut).select(*kept, F.when(fits, 1).otherwise(0).cast("bigint").alias("_extra"))
    for walked in walks:
        each = walked.select(F.explode(F.arrays_zip("_docs", "_took")).alias("_z")).select("_z._docs.*", F.col("_z._took").alias("_extra"))
        out = out.unionByName(each.select(*kept, "_extra"))
    copies = F.col("_whole") + F.col("_extra")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as often as its copies say, with all its columns.

    Rows that repeat a doc_id share its copies: they get the mean, rounded to nearest.
    """
    plan = mix(docs, id_col=id_col, **options)
    plan = plan.groupBy(F.col("doc_id").alias("__id")).agg(F.round(F.avg("copies")).cast("int").alias("__copies")).where("__copies > 0")
    out = docs.join(plan, docs[id_col].eqNullSafe(plan["__id"]))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
