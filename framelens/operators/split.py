"""Leak-free train/test splits by group, and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelens.operators.series import CHUNK_ROWS, Series, scan, stage

HASH_BITS = 60
#: Class-count profiles whose odd groups are placed one by one; those of the smallest groups beyond it go round in turn.
PROFILES = 50_000


def with_group_id(windows: DataFrame, parent: str = "file_stem") -> DataFrame:
    """Windows of one recording share a group whatever their label."""
    return windows.withColumn("group_id", F.concat_ws("::", "modality", parent))


def hash_order(value: Column, seed: int) -> Column:
    """Deterministic shuffle position: 60 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _dealt(groups: DataFrame, stratum: str, order: Column, limit: int = CHUNK_ROWS) -> DataFrame:
    """Position of each group in its stratum by ``order`` (60 bits) and the size of the stratum."""
    n = groups.count()
    width = None if n <= limit else 2**HASH_BITS // -(-n // limit)
    return scan(groups.withColumn("_h", order), Series((stratum,), "_h", width), running={"_pos": F.lit(1)},
                totals={"_size": ("sum", F.lit(1))})


def fold_count(dataset: DataFrame, most: int = 5) -> int:
    """Folds that every label can fill: at most ``most``, at most its number of groups."""
    per_label = dataset.select("label", "group_id").distinct().groupBy("label").count()
    return min(most, per_label.agg(F.min("count")).first()[0] or 0)


def place_units(units: list[tuple[dict[str, int], int]], totals: dict[str, int], k: int) -> list[list[int]]:
    """Folds of the odd groups of each profile, in the order given: a group goes to the fold where its classes are
    scarcest, as shares of all rows of a class; on a tie to the fold with fewer rows, then to the first.

    That is the fold for which the class shares of all folds stay closest together: adding g to a count c changes the sum
    of squares by 2cg + g * g, and only 2cg depends on the fold.
    """
    names = sorted(totals)
    held, out = [dict.fromkeys(names, 0) for _ in range(k)], []
    for counts, n in units:
        folds = []
        for _ in range(n):
            scarce = lambda f: sum((held[f][c] * counts.get(c, 0) / (totals[c] * totals[c]) for c in names), 0.0)
            fold = min(range(k), key=lambda f: (scarce(f), sum(held[f].values()), f))
            folds.append(fold)
            for c, g in counts.items():
                held[fold][c] += g
        out.append(folds)
    return out


def stratified_group_folds(dataset: DataFrame, k: int, seed: int = 42, limit: int = CHUNK_ROWS, most: int = PROFILES) -> DataFrame:
    """``group_id, stratum, labels, rows, fold``: folds whose shares of every class are as even as whole groups allow.

    Groups with the same rows per class are interchangeable. Of such a profile every fold gets the same number, in shuffled
    order, and the fewer than ``k`` groups left over are placed one by one, profiles with most rows first. Only profiles
    reach the driver, ``most`` at most; odd groups of further (smaller) ones go round the folds.
    """
    counts = stage(dataset.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n")))
    groups = counts.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("classes"), F.sum("n").alias("rows"))
    groups = stage(groups.withColumn("profile", F.md5(F.to_json("classes"))))
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    profiles = groups.groupBy("profile").agg(F.first("classes").alias("classes"), F.first("rows").alias("rows"),
                                             F.count(F.lit(1)).alias("of"))
    top = profiles.orderBy(F.desc("rows"), "profile").limit(most).collect()
    named = [(r["profile"], {c["label"]: c["n"] for c in r["classes"]}, r["of"] % k) for r in top]
    named.sort(key=lambda p: (-sum(p[1].values()), [-p[1].get(c, 0) for c in sorted(totals)]))
    placed = place_units([p[1:] for p in named], totals, k)
    odd = dataset.sparkSession.createDataFrame([(p[0], f) for p, f in zip(named, placed)], "profile string, odd array<int>")
    dealt = _dealt(groups.drop("classes"), "profile", hash_order(F.col("group_id"), seed), limit)
    at, even = F.col("_pos") - 1, F.floor(F.col("_size") / k) * k
    spare = F.pmod(at + F.crc32("profile"), F.lit(k))
    fold = F.when(at < even, at % k).otherwise(F.coalesce(F.get("odd", (at - even).cast("int")), spare))
    labels = counts.groupBy("group_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return dealt.join(odd, "profile", "left").join(labels, "group_id").select(
        "group_id", F.array_join("labels", "+").alias("stratum"), "labels", "rows", fold.cast("int").alias("fold"))


def both_sides(folds: DataFrame, seed: int = 42) -> DataFrame:
    """``group_id, test``: fold 0 is the test side, and every label of two or more groups is on both sides.

    A label that one side lacks gets its smallest group moved there whose other labels stay on both sides too; a label
    costs one small query and there are few labels.
    """
    sides = stage(folds.withColumn("test", F.col("fold") == 0))
    moved: dict[str, bool] = {}
    while True:
        now = sides.withColumn("test", F.coalesce(_looked_up(moved), F.col("test"))) if moved else sides
        per = now.select(F.explode("labels").alias("label"), "test").groupBy("label").agg(
            F.count_if("test").alias("test"), F.count_if(~F.col("test")).alias("train")).collect()
        lacking = sorted((r["label"], r["test"] == 0) for r in per if r["test"] + r["train"] > 1 and 0 in (r["test"], r["train"]))
        found = None
        for label, to_test in lacking:
            spare = [r["label"] for r in per if r["train" if to_test else "test"] > 1]
            found = now.filter((F.col("test") != F.lit(to_test)) & F.array_contains("labels", label)
                               & (F.size(F.array_except("labels", F.array(*[F.lit(s) for s in spare]))) == 0)
                               ).orderBy("rows", hash_order(F.col("group_id"), seed)).select("group_id").first()
            if found:
                moved[found["group_id"]] = to_test
                break
        if found is None:
            return now.select("group_id", "test")


def _looked_up(moved: dict[str, bool]) -> Column:
    out = F.lit(None).cast("boolean")
    for group, to in moved.items():
        out = F.when(F.col("group_id") == group, F.lit(to)).otherwise(out)
    return out


def fallback_test_groups(dataset: DataFrame, seed: int = 42, share: float = 0.2, limit: int = CHUNK_ROWS) -> DataFrame:
    """Per label with two or more groups, about ``share`` of its groups but never all of them."""
    groups = dataset.select("label", "group_id").distinct()
    dealt = _dealt(groups, "label", hash_order(F.col("group_id"), seed), limit)
    quota = F.least(F.greatest(F.lit(1), F.rint(F.col("_size") * F.lit(share)).cast("long")), F.col("_size") - 1)
    return dealt.filter(F.col("_pos") <= quota).select("group_id").distinct()


def group_split(dataset: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; no group is on both sides."""
    k = fold_count(dataset)
    if k >= 2:
        test_groups = both_sides(stratified_group_folds(dataset, k, seed), seed).filter("test").select("group_id")
    else:
        test_groups = fallback_test_groups(dataset, seed)
    train = dataset.join(test_groups, "group_id", "left_anti")
    test = dataset.join(test_groups, "group_id", "left_semi")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("the group split left one side empty")
    return train, test


def class_counts(dataset: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows per class; one entry per class, so the result is small."""
    return {r[label]: r["count"] for r in dataset.groupBy(label).count().collect()}


def balanced_weight(counts: dict[str, int], label: str = "label") -> Column:
    """``n / (classes * rows of the class)``."""
    n, k = sum(counts.values()), len(counts)
    weight = None
    for name, c in sorted(counts.items()):
        value = F.lit(n / (k * c))
        hit = F.col(label) == name
        weight = F.when(hit, value) if weight is None else weight.when(hit, value)
    return weight


def class_weights(dataset: DataFrame, label: str = "label") -> DataFrame:
    counts = dataset.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    whole = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn("weight", F.lit(float(whole["n"] or 0)) / (F.lit(float(whole["k"])) * F.col("rows")))
