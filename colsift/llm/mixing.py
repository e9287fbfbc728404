"""Mixing sources to target weights.

Every record gets a hash-random key per epoch; a source's records are taken in key order
until its budget of tokens is used up. The order never needs one task per source: keys are
cut into buckets of equal width, token sums of (source, epoch, bucket) give each bucket's
offset, and the running sum inside a bucket gives each record's place. A source that holds
most of the corpus is therefore spread over as many buckets as it has blocks of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records a bucket holds on average; the number of buckets follows from the source's size.
BUCKET_RECORDS = 20_000
#: Rows of the targets up to which they are sent to all tasks.
MOST_SENT = 100_000


def source_budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source: tokens at hand, target share and budget.

    ``sizes`` (source, n_docs, n_tokens) and ``targets`` (source, target_share, max_repeats)
    are joined on the source. Sources on one side only get the budget 0 and stay in the
    report; the shares of those on both sides are scaled to sum to 1 (``wanted_share``).
    Repeated target rows of a source count once (the smallest share, then fewest repeats).
    Without ``total_tokens`` the total is the largest for which every source can give its
    exact share within its repeats; with it, a source that is too small gives all it may.
    """
    spec = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.min(F.struct("target_share", "max_repeats")).alias("t")
    ).select("source", "t.target_share", "t.max_repeats")
    both = sizes.join(spec, "source", "full_outer")
    usable = F.col("n_tokens").isNotNull() & F.col("target_share").isNotNull() & (F.col("n_tokens") > 0)
    # One row for all: the sum of the shares, and the total that the scarcest source allows for.
    shares, scarcest = both.where(usable).agg(F.sum("target_share"), F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share"))).first()
    shares = F.lit(float(shares or 1))
    both = both.withColumn("wanted_share", F.when(usable, F.col("target_share") / shares))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.lit(float(scarcest or 0)) * shares
    both = both.withColumn("budget", F.floor(F.when(usable, total * F.col("wanted_share")) + F.lit(1e-6)).cast("long"))
    return both.select(
        "source",
        F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        "target_share",
        "wanted_share",
        F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats"),
        F.coalesce(F.least("budget", F.col("n_tokens") * F.col("max_repeats")), F.lit(0)).cast("long").alias("budget"),
    )


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """(doc_id, source, epoch, n_tokens): one row per use of a record in the mix.

    ``docs`` has doc_id, source and n_tokens; other columns are ignored. Epochs count from 0;
    a record occurs at most ``max_repeats`` times, once an epoch, in another order each epoch.
    Whole records are taken while their running sum stays within the budget, so a source
    falls short of it by less than its longest record. Null sources, sources without target
    and records without tokens are not used; repeated rows of a doc_id are one record.
    """
    docs = docs.select("doc_id", "source", "n_tokens").where("source is not null and doc_id is not null and n_tokens > 0").dropDuplicates(["doc_id"])
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    plan = source_budgets(sizes, targets, total_tokens).where("budget > 0").select(
        "source",
        "budget",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_records)).cast("int").alias("n_buckets"),
        F.ceil(F.col("budget") / F.col("n_tokens")).cast("int").alias("n_epochs"),
    )
    # The sources with a positive budget are named in the targets, a configuration table; a long one is left to Spark.
    plan = F.broadcast(plan) if targets.count() <= MOST_SENT else plan
    uses = docs.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n_epochs") - 1)))
    uses = uses.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "doc_id"), 1))
    spread = (F.col("key").cast("double") / float(1 << 63)) * F.col("n_buckets")
    uses = uses.withColumn("bucket", F.least(F.floor(spread).cast("int"), F.col("n_buckets") - 1))
    sums = uses.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "epoch", "bucket", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start_at"))
    placed = uses.join(starts, ["source", "epoch", "bucket"]).where(F.col("start_at") < F.col("budget"))
    # Only the bucket in which a budget ends must be put in order.
    within = F.col("start_at") + F.col("tokens") <= F.col("budget")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(~within).withColumn("run", F.sum("n_tokens").over(inside)).where(F.col("start_at") + F.col("run") <= F.col("budget"))
    return placed.where(within).unionByName(last.drop("run")).select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """Shares reached, one row per source of either side (unused ones with 0 tokens)."""
    mix = mix_sources(docs, targets, total_tokens, seed, bucket_records)
    sizes = docs.where("source is not null and doc_id is not null and n_tokens > 0").dropDuplicates(["doc_id"]).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("uses"), F.max(F.col("epoch") + 1).alias("most_uses"))
    out = source_budgets(sizes, targets, total_tokens).join(used, "source", "left")
    out = out.withColumn("used", F.coalesce("used", F.lit(0)))
    everything = used.agg(F.sum("used")).first()[0] or 0
    return out.select(
        "source", "n_docs", "n_tokens", "target_share", "wanted_share", "max_repeats", "budget",
        F.col("used").alias("used_tokens"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"),
        F.when(F.lit(everything) > 0, F.col("used") / F.lit(float(everything or 1))).alias("actual_share"),
    )
