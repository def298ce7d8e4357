"""The score as a classifier: confusion, threshold sweep, ROC AUC, breakdowns, ablation, bootstrap intervals, regression gates.

Inputs are long tables; every operator is a declarative plan. `records`: label (bool: true is positive), score, plus groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-4
COUNTS = ("tp", "fp", "tn", "fn")


def binary(records: DataFrame, label: str = "label", positive: str = "ai", negative: str = "human") -> DataFrame:
    """Records of the two classes, with label as a boolean."""
    return records.filter(F.col(label).isin(positive, negative)).withColumn(label, F.col(label) == positive)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(records: DataFrame, threshold: float, by: tuple = ()) -> DataFrame:
    """tp, fp, tn, fn by group; a score at the threshold counts as flagged."""
    hit = F.col("score") >= threshold
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return records.groupBy(*by).agg(n(hit & F.col("label")).alias("tp"), n(hit & ~F.col("label")).alias("fp"), n(~hit & ~F.col("label")).alias("tn"), n(~hit & F.col("label")).alias("fn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = map(F.col, COUNTS)
    d = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "fpr": _ratio(fp, fp + tn)})
    return d.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def _offsets(rows: DataFrame, by: tuple, order, **sums) -> DataFrame:
    """(by, _b, sums of the buckets before): prefix sums by whole-numbered score bucket, so that no window holds all scores."""
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])


def candidate_thresholds(records: DataFrame, by: tuple = ()) -> DataFrame:
    """Scores, midpoints between neighbours (3 decimals), a little below the least and above the greatest; none negative."""
    s = records.select(*by, "score").distinct().withColumn("_b", F.floor("score"))
    # the neighbour of a bucket's last score is the first of the next bucket
    firsts = s.groupBy(*by, "_b").agg(F.min("score").alias("_first"))
    firsts = firsts.select(*by, "_b", F.lead("_first").over(Window.partitionBy(*by).orderBy("_b")).alias("_after"))
    after = F.coalesce(F.lead("score").over(Window.partitionBy(*by, "_b").orderBy("score")), F.col("_after"))
    mid = s.join(firsts, [*by, "_b"]).select(*by, (F.floor((F.col("score") + after) / 2 * 1000 + 0.5) / 1000).alias("threshold")).filter("threshold is not null")
    ends = s.groupBy(*by).agg((F.min("score") - 0.1).alias("a"), (F.max("score") + 0.1).alias("b")).select(*by, F.explode(F.array("a", "b")).alias("threshold"))
    return s.select(*by, F.col("score").alias("threshold")).unionByName(mid).unionByName(ends).filter("threshold >= 0").distinct()


def sweep(records: DataFrame, by: tuple = ()) -> DataFrame:
    """Counts and metrics at every candidate threshold, by group.

    Records are first summed by score; running sums over the scores, thresholds among them, then give every threshold's counts:
    one sort of the distinct scores in place of thresholds times records, within buckets of scores.
    """
    sums = records.groupBy(*by, "score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    none = F.lit(0).cast("bigint")
    marks = sums.select(*by, F.col("score").alias("at"), "p", "n", F.lit(False).alias("mark")).unionByName(candidate_thresholds(records, by).select(*by, F.col("threshold").alias("at"), none.alias("p"), none.alias("n"), F.lit(True).alias("mark")))
    marks = marks.withColumn("_b", F.floor("at"))
    above = _offsets(marks, by, F.col("_b").desc(), _p="p", _n="n")
    up = Window.partitionBy(*by, "_b").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = sums.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    x = marks.select(*by, "_b", "at", "mark", F.sum("p").over(up).alias("p"), F.sum("n").over(up).alias("n")).filter("mark").join(above, [*by, "_b"])
    x = x.join(whole, list(by)) if by else x.crossJoin(F.broadcast(whole))  # one row
    x = x.select(*by, "at", (F.col("p") + F.col("_p")).alias("tp"), (F.col("n") + F.col("_n")).alias("fp"), "all_p", "all_n")
    return with_metrics(x.select(*by, F.col("at").alias("threshold"), "tp", "fp", (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn")))


def best_threshold(records: DataFrame, by: tuple = ()) -> DataFrame:
    """The row of the sweep with the greatest (F1, -FPR, accuracy, -threshold), by group."""
    d = sweep(records, by)
    best = F.max_by(F.struct(*[c for c in d.columns if c not in by]), F.struct(F.col("f1"), -F.col("fpr"), F.col("accuracy"), -F.col("threshold")))
    return d.groupBy(*by).agg(best.alias("r")).select(*by, "r.*")


def auc(records: DataFrame, by: tuple = ()) -> DataFrame:
    """Mann-Whitney by mid-ranks, from sums by score; ties count half; null where one class is missing."""
    sums = records.groupBy(*by, "score").agg(F.count_if("label").cast("double").alias("p"), F.count_if(~F.col("label")).cast("double").alias("n"))
    sums = sums.withColumn("_b", F.floor("score"))
    below = _offsets(sums, by, F.col("_b"), _n="n")
    before = F.sum("n").over(Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    x = sums.withColumn("_in", before).join(below, [*by, "_b"]).withColumn("u", F.col("p") * (F.col("_in") + F.col("_n") + F.col("n") / 2))
    return x.groupBy(*by).agg(F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum("u") / (F.sum("p") * F.sum("n"))).alias("auc"))


def by_group(records: DataFrame, group: str, threshold: float) -> DataFrame:
    """Metrics, AUC and whether there is but one class, by group."""
    m = with_metrics(confusion(records, threshold, (group,)))
    return m.join(auc(records, (group,)), group).withColumn("single_class", F.col("auc").isNull())


def flagged_rate(records: DataFrame, threshold: float, by: tuple = ()) -> DataFrame:
    """Share of negatives at or above the threshold."""
    return records.filter(~F.col("label")).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("flagged")).withColumn("rate", _ratio(F.col("flagged"), F.col("n")))


def score_mass(points: DataFrame) -> DataFrame:
    """(category, mass, share) of points: rows (category, weight, words), one a hit."""
    x = points.filter("words > 0").groupBy("category").agg(F.sum(F.col("weight") * 1000 / F.col("words")).alias("mass"))
    return x.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy()))


def ablation(records: DataFrame, hits: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, auc, auc_drop, best_f1_acc, acc_drop, share): AUC and accuracy at the best threshold when one category's weight is
    zero, what is lost, and the category's share of the positives' score; what costs most comes first.

    records: doc_id, label, words; hits: doc_id, category, weight; categories: category (few). Weights are summed by document
    first, so that what meets the categories is one row a document with its sums by category.
    """
    sums = hits.groupBy("doc_id", "category").agg(F.sum("weight").alias("w"))
    per_doc = sums.groupBy("doc_id").agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("category", "w"))).alias("by"))
    scored = records.select("doc_id", "label", "words").join(per_doc, "doc_id", "left")
    rate = lambda w: F.when(F.col("words") > 0, w / F.col("words") * 1000).otherwise(0.0)
    whole = F.coalesce("total", F.lit(0.0))
    x = scored.crossJoin(F.broadcast(categories.select(F.col("category")))).select("category", "label", rate(whole - F.coalesce(F.try_element_at("by", F.col("category")), F.lit(0.0))).alias("score"))
    full = scored.select("label", rate(whole).alias("score"))
    base = auc(full).select(F.col("auc").alias("_auc")).crossJoin(F.broadcast(best_threshold(full).select(F.col("accuracy").alias("_acc"))))
    share = score_mass(sums.join(records.filter("label").select("doc_id", "words"), "doc_id").select("category", F.col("w").alias("weight"), "words")).select("category", "share")
    y = auc(x, ("category",)).join(best_threshold(x, ("category",)).select("category", F.col("accuracy").alias("best_f1_acc")), "category").join(share, "category", "left").crossJoin(F.broadcast(base))
    y = y.select("category", "auc", (F.col("_auc") - F.col("auc")).alias("auc_drop"), "best_f1_acc", (F.col("_acc") - F.col("best_f1_acc")).alias("acc_drop"), F.coalesce("share", F.lit(0.0)).alias("share"))
    return y.orderBy(F.coalesce("auc_drop", F.lit(0.0)).desc(), F.desc("acc_drop"), F.desc("share"), "category")


def bootstrap(records: DataFrame, threshold: float, iterations: int = 2000, seed: int = 1729, alpha: float = 0.05) -> DataFrame:
    """(statistic, lo, hi) of auc, recall, fpr and f1: percentile intervals of a stratified bootstrap.

    Only how many records of each class have a score matters, so a resample is a multinomial draw over the scores: their counts
    travel to the tasks instead of the records (scores have one decimal, so they are few). Seeded by iteration, so the result
    doesn't depend on the partitioning. Without records of a class its statistics are 0, and AUC is null.
    """
    sums = records.groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    c = sums.agg(F.sort_array(F.collect_list(F.struct("score", "p", "n"))).alias("c")).select("c.score", "c.p", "c.n")
    names = ("auc", "recall", "fpr", "f1")

    def draw(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for i, score, p, n in b[["id", "score", "p", "n"]].itertuples(index=False):
                rng = np.random.default_rng([seed, int(i)])
                score, p, n = np.asarray(score, float), np.asarray(p, np.int64), np.asarray(n, np.int64)
                P, N = int(p.sum()) if len(p) else 0, int(n.sum()) if len(n) else 0
                x = rng.multinomial(P, p / P) if P else p
                y = rng.multinomial(N, n / N) if N else n
                t, f = int(x[score >= threshold].sum()), int(y[score >= threshold].sum())
                u = float((x * (np.cumsum(y) - y / 2)).sum()) / (P * N) if P and N else None
                out.append((u, t / P if P else 0.0, f / N if N else 0.0, 2 * t / (2 * t + f + P - t) if t else 0.0))
            yield pd.DataFrame(out, columns=names)

    x = c.sparkSession.range(iterations).crossJoin(F.broadcast(c)).mapInPandas(draw, ", ".join(f"{k} double" for k in names))
    x = x.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("statistic", "v"))
    return x.groupBy("statistic").agg(F.percentile("v", F.lit(alpha / 2)).alias("lo"), F.percentile("v", F.lit(1 - alpha / 2)).alias("hi"))


def mid_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the tie-averaged rank of value. For small tables: the order is global."""
    w = Window.orderBy(value)
    return rows.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    return mid_ranks(mid_ranks(rows, a, "_a"), b, "_b").agg(F.corr("_a", "_b").alias("rho"))


def costume(analyzed: DataFrame, threshold: float) -> DataFrame:
    """Of over-corrected documents: how many are flagged, and how many by the categories that mean it."""
    caught = F.exists("hits", lambda h: h["category"].isin("over_correction", "internet_tells"))
    return analyzed.agg(F.count("*").alias("n"), F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)).alias("flagged_rate"), F.avg(F.when(caught, 1.0).otherwise(0.0)).alias("category_rate"))


def differences(a: DataFrame, b: DataFrame, key: str, exact: tuple = (), close: tuple = ()) -> DataFrame:
    """(key, field, a, b) where two result tables differ: rows on one side, exact fields that aren't equal, close ones by more
    than TOLERANCE."""
    x = a.select(key, *[F.col(c).alias(f"a_{c}") for c in (*exact, *close)], F.lit(True).alias("_a")).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in (*exact, *close)], F.lit(True).alias("_b")), key, "full_outer")
    def differs(c):
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        return ~p.eqNullSafe(q) if c in exact else ~(p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= TOLERANCE, F.lit(False)))
    rows = [F.when(F.col("_a").isNull() | F.col("_b").isNull() | differs(c), F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").cast("string").alias("a"), F.col(f"b_{c}").cast("string").alias("b"))) for c in (*exact, *close)]
    return x.select(key, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("d")).select(key, "d.*")


def write_golden(results: DataFrame, path: str) -> None:
    """Writes a table of results that later runs are held against."""
    results.write.mode("overwrite").parquet(path)


def against_golden(results: DataFrame, path: str, key: str, exact: tuple = (), close: tuple = ()) -> DataFrame:
    """differences() from the golden table: no rows where nothing has changed."""
    return differences(results.sparkSession.read.parquet(path), results, key, exact, close)


def unmatched(files: DataFrame, labels: DataFrame, key: str, labels_known: tuple, registers_known: tuple) -> DataFrame:
    """(key, problem): files without label, labels without file, unknown labels and registers."""
    a = files.join(labels, key, "left_anti").select(key, F.lit("no label").alias("problem"))
    b = labels.join(files, key, "left_anti").select(key, F.lit("no file").alias("problem"))
    c = labels.filter(~F.coalesce(F.col("label").isin(*labels_known), F.lit(False))).select(key, F.lit("bad label").alias("problem"))
    d = labels.filter(~F.coalesce(F.col("register").isin(*registers_known), F.lit(False))).select(key, F.lit("unknown register").alias("problem"))
    return a.unionByName(b).unionByName(c).unionByName(d)
