"""Groups to folds, subsamples and permutations. Everything random is an md5 of explicit keys, so a split depends on the
seed and the group only: not on row order, partitioning or other groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import bucket_of, cuts, ranked


def shuffled(*keys: Column) -> Column:
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))


def _hashed(df: DataFrame, keys: list[str], seed: int, first: Column | None = None) -> DataFrame:
    """df with rank along the seed's hashes of group (after first, a number), within keys."""
    h = shuffled(F.lit(seed), F.col("group"))
    part = F.substring(h, 1, 2)  # 256 even buckets
    bucket = part if first is None else F.struct(first.alias("n"), part.alias("h"))
    return ranked(df, keys, bucket, [*([] if first is None else [first]), h, "group"])


def stratified_folds(groups: DataFrame, folds: int, seed: int) -> DataFrame:
    """groups: group, label (one row a group). Adds fold: each class is dealt over all folds, starting at its own offset."""
    labels = groups.select("label").distinct().withColumn("__offset", F.row_number().over(W.orderBy("label"))).withColumnRenamed("label", "__label")  # classes
    x = _hashed(groups, ["label"], seed).join(F.broadcast(labels), F.equal_null("label", "__label"))
    return x.select(*groups.columns, ((F.col("rank") + F.col("__offset") - 2) % folds).cast("int").alias("fold"))


def plain_folds(groups: DataFrame, folds: int, seed: int) -> DataFrame:
    """Near-equal folds of shuffled groups, the first ones taking the remainder."""
    n = F.broadcast(groups.agg(F.count("*").alias("__n")))  # one row
    x = _hashed(groups, [], seed).join(n).withColumns({"__q": F.floor(F.col("__n") / folds), "__r": F.col("__n") % folds})
    long = F.col("__r") * (F.col("__q") + 1)  # groups in the folds with one more
    k = F.col("rank") - 1
    fold = F.when(k < long, F.floor(k / (F.col("__q") + 1))).otherwise(F.col("__r") + F.floor((k - long) / F.greatest("__q", F.lit(1))))
    return x.select(*groups.columns, fold.cast("int").alias("fold"))


def balanced_folds(sizes: DataFrame, folds: int, seed: int) -> DataFrame:
    """sizes: group, n. Groups in falling size (ties shuffled) are dealt to and fro over the folds."""
    k = F.col("rank") - 1
    turn, at = F.floor(k / folds), k % folds
    return _hashed(sizes, [], seed, -F.col("n")).select(*sizes.columns, F.when(turn % 2 == 0, at).otherwise(folds - 1 - at).cast("int").alias("fold"))


def leave_one_out(metadata: DataFrame, key: str) -> DataFrame:
    """fold, sample_id of the test side: one fold for each value of key, numbered in order."""
    values = metadata.select(key).distinct()
    folds = ranked(values, [], bucket_of(F.col(key), cuts(values, F.col(key))), [key], "__fold").select(F.col(key).alias("__key"), (F.col("__fold") - 1).cast("int").alias("fold"))
    return metadata.join(folds, F.equal_null(key, "__key")).select("fold", "sample_id")


def leave_batch_out(metadata: DataFrame, group: str, batch: str) -> DataFrame:
    """batch (held out), sample_id, role: train rows are those whose group has no row in the held-out batch."""
    held = F.broadcast(metadata.select(batch).distinct().agg(F.array_sort(F.collect_list(batch)).alias("__b")))  # batches: a small dimension
    rows = metadata.join(held).select("sample_id", F.col(group).alias("g"), F.col(batch).alias("own"), F.explode("__b").alias("batch"))
    seen = metadata.select(F.col(group).alias("g"), F.col(batch).alias("batch")).distinct()
    test = rows.where("own = batch").select("batch", "sample_id", F.lit("test").alias("role"))
    train = rows.join(seen, ["g", "batch"], "left_anti").select("batch", "sample_id", F.lit("train").alias("role"))
    return test.unionByName(train)


def group_times(metadata: DataFrame, group: str, time: str) -> DataFrame:
    return metadata.groupBy(F.col(group).alias("group")).agg(F.min(time).alias("first"), F.max(time).alias("last"))


def temporal_folds(times: DataFrame, folds: int, train_fraction: float, gap: float) -> DataFrame:
    """times: group, first, last. fold, group, role: distinct starting times after the first ceil(share) of them form as many
    near-equal windows as folds; tested are groups that start in a window, trained those that end before it less the gap."""
    starts = times.select("first").distinct()
    n = starts.count()
    initial = max(1, -(-int(n * train_fraction * 10**9) // 10**9))
    if n - initial < folds:
        raise ValueError("too few distinct starting times for the folds")
    late = starts.withColumn("k", F.row_number().over(W.orderBy("first"))).where(F.col("k") > initial)
    windows = late.withColumn("fold", (F.ntile(folds).over(W.orderBy("first")) - 1).cast("int")).select("first", "fold")
    test = times.join(windows, "first").select("fold", "group", F.lit("test").alias("role"))
    begin = F.broadcast(windows.groupBy("fold").agg(F.min("first").alias("begin")))  # one row a fold
    train = times.join(begin, F.col("last") < F.col("begin") - gap).select("fold", "group", F.lit("train").alias("role"))
    return test.unionByName(train)


def class_coverage(folds: DataFrame, groups: DataFrame, n_folds: int) -> DataFrame:
    """fold, classes, covers of each fold's training side. folds: group, fold; groups: group, label."""
    all_classes = groups.select(F.count_distinct("label")).first()[0]
    rows = folds.join(groups, "group").select("label", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")).where("own != fold")
    return rows.groupBy("fold").agg(F.count_distinct("label").alias("classes")).withColumn("covers", F.col("classes") == all_classes)


def split_audit(metadata: DataFrame, folds: DataFrame, n_folds: int, group: str) -> DataFrame:
    """fold, role, samples, groups (sorted lists). folds: group, fold."""
    rows = metadata.join(folds.select(F.col("group").alias(group), F.col("fold").alias("own")), group).select("sample_id", group, "own", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    role = F.when(F.col("own") == F.col("fold"), "test").otherwise("train")
    return rows.groupBy("fold", role.alias("role")).agg(F.array_sort(F.collect_set("sample_id")).alias("samples"), F.array_sort(F.collect_set(group)).alias("groups"))


def subsample_size(n_groups: int, fraction: float, inner_folds: int) -> int:
    return min(n_groups - 1, max(inner_folds, -(-int(n_groups * fraction * 10**9) // 10**9)))


def subsample_groups(groups: DataFrame, size: int, inner_folds: int, seed: int, resample: int, tries: int = 200) -> DataFrame:
    """The groups of one stability resample: the ``size`` first by hash, in the first of ``tries`` orders that leaves every class at least
    inner_folds of them; an error if none does. groups: group, label (null for continuous outcomes). Mostly the first order will do; each
    costs an aggregation, whose rows are the classes."""
    classes = groups.select(F.count_distinct("label")).first()[0]
    for turn in range(tries):
        h = shuffled(F.lit(seed), F.lit(resample), F.lit(turn), F.col("group"))
        chosen = ranked(groups.select("group", "label"), [], F.substring(h, 1, 2), [h, "group"], "k").where(F.col("k") <= size).drop("k")
        per = [r["n"] for r in chosen.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()]
        if len(per) == classes and all(n >= inner_folds for n in per):
            return chosen
    raise ValueError("no subsample leaves every class enough groups for the inner folds: raise the fraction, or add groups")


def permute_labels(groups: DataFrame, seed: int, permutation: int) -> DataFrame:
    """groups: group, stratum, label. Labels exchanged among the groups of a stratum: the label of rank i in group order goes
    to the group of rank i in hash order."""
    h = shuffled(F.lit(seed), F.lit(permutation), F.col("group"))
    by_name = bucket_of(F.col("group"), cuts(groups, F.col("group")))
    labels = ranked(groups.select("stratum", "group", "label"), ["stratum"], by_name, ["group"], "k").drop("group")
    places = ranked(groups.select("stratum", "group"), ["stratum"], F.substring(h, 1, 2), [h, "group"], "k")
    return places.join(labels, ["stratum", "k"]).select("group", "stratum", "label")
