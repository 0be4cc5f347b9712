"""Forecast skill: contingency scores, exact AUC, threshold sweeps, reliability, splits, baselines and lead time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_quantiles


def cells(alarm: Column, y: Column) -> list[Column]:
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [one(alarm & (y == 1)).alias("tp"), one(alarm & (y == 0)).alias("fp"), one(~alarm & (y == 1)).alias("fn"), one(~alarm & (y == 0)).alias("tn")]


def scores(counts: DataFrame) -> DataFrame:
    """pod, far, tss and hss of tp, fp, fn, tn; empty denominators count as 1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    some = lambda x: F.greatest(x, F.lit(1))
    chance = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    return counts.withColumns({"pod": tp / some(tp + fn), "far": fp / some(tp + fp), "tss": tp / some(tp + fn) - fp / some(fp + tn), "hss": F.when(chance == 0, 0.0).otherwise(2.0 * (tp * tn - fp * fn) / chance)})


def contingency(rows: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    return scores(rows.groupBy(*keys).agg(*cells(F.col("prob") >= threshold, F.col("y"))))


def brier_skill(rows: DataFrame) -> DataFrame:
    base = rows.agg(F.avg("y").alias("base"))
    sums = rows.crossJoin(F.broadcast(base)).agg(F.avg(F.pow(F.col("prob") - F.col("y"), 2)).alias("bs"), F.avg(F.pow(F.col("base") - F.col("y"), 2)).alias("bs_ref"))
    return sums.withColumn("bss", F.when(F.col("bs_ref") > 0, 1 - F.col("bs") / F.col("bs_ref")).otherwise(0.0))


def auc(rows: DataFrame, parts: int = 256) -> DataFrame:
    """Exact ROC area from counts by distinct score, ties at half. (n_pos, n_neg, auc)

    Distinct scores are cut into ``parts`` ranges at quantiles of theirs; a range's negatives below come from the
    ranges before it, so no task sees all scores.
    """
    by = rows.groupBy("prob").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    cuts = by.agg(F.percentile_approx("prob", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"))
    placed = by.crossJoin(F.broadcast(cuts)).withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("prob"))), F.lit(0))).drop("cuts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("neg").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    below = Window.partitionBy("part").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(sums), "part").withColumn("under", F.col("base") + F.coalesce(F.sum("neg").over(below), F.lit(0)))
    out = ranked.agg(F.sum(F.col("pos") * (F.col("under") + 0.5 * F.col("neg"))).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tss, hss, bss, pod, far, auc and the counts behind them."""
    return contingency(rows, threshold).crossJoin(brier_skill(rows).select("bss")).crossJoin(auc(rows).select("auc"))


def ladder(rows: DataFrame) -> DataFrame:
    """Thresholds (thr): forty quantiles of prob and the steps of 0.05, rounded to three places, between 0 and 1."""
    return _rungs(rows, "prob", ()).select("thr")


def _rungs(rows: DataFrame, prob: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, thr): the thresholds of ``ladder`` for each group; quantiles are exact, and no task holds all scores."""
    found = exact_quantiles(rows, prob, [0.02 + i * (0.995 - 0.02) / 39 for i in range(40)], keys)
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    own = rows.sparkSession.createDataFrame([(*key, q) for key, q in found.items()] or [([],)] * (not keys), ", ".join([*kinds, "q array<double>"]))
    steps = F.transform(F.sequence(F.lit(1), F.lit(18)), lambda i: i / 20)
    return own.select(*keys, F.explode(F.array_distinct(F.transform(F.concat("q", steps), lambda x: F.bround(x, 3)))).alias("thr")).where("thr > 0 and thr < 1")


OBJECTIVES = {"f0.5": "f0_5", "f1": "f1", "f2": "f2", "tss": "tss"}


def best_thresholds(swept: DataFrame, default: float = 0.5) -> DataFrame:
    """One row: the threshold of the best value of each objective, the lowest of equals; ``default`` without any."""
    best = [F.coalesce(F.min_by("thr", F.struct(-F.col(c), F.col("thr"))), F.lit(default)).alias(n) for n, c in OBJECTIVES.items()]
    return swept.agg(*best)


def sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores at each threshold (thr): counts by distinct probability meet the small threshold table."""
    by = rows.groupBy("prob", "y").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("prob") >= F.col("thr")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    joined = by.crossJoin(F.broadcast(thresholds))
    cells_ = joined.groupBy("thr").agg(count(hit & (F.col("y") == 1))("tp"), count(hit & (F.col("y") == 0))("fp"), count(~hit & (F.col("y") == 1))("fn"), count(~hit & (F.col("y") == 0))("tn"))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    fbeta = lambda b: (1 + b * b) * precision * recall / F.greatest(b * b * precision + recall, F.lit(1e-9))
    return scores(cells_).drop("pod", "far", "hss").withColumns({"precision": precision, "recall": recall, "f0_5": fbeta(0.5), "f1": fbeta(1.0), "f2": fbeta(2.0)})


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins up to 1.001 times the highest probability; support below 5 is thin, below 15 ok, else solid.

    upper is a bin's upper edge; that of the last bin is the highest confidence the scores reach.
    """
    top = rows.agg((F.greatest(F.max("prob"), F.lit(1e-6)) * 1.001).alias("top"))
    placed = rows.crossJoin(F.broadcast(top)).withColumn("bin", F.least(F.floor(F.col("prob") / F.col("top") * bins), F.lit(bins - 1)))
    out = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.avg("y").alias("observed"), F.sum("y").cast("long").alias("positives"), (F.first("top") * (F.first("bin") + 1) / bins).alias("upper"))
    return out.withColumn("support", F.when(F.col("positives") < 5, "thin").when(F.col("positives") < 15, "ok").otherwise("solid"))


def time_split(rows: DataFrame, fraction: float = 0.3) -> DataFrame:
    """rows with ``part``: the last max(1, round(fraction * dates)) dates are test, halves rounded to even.

    Dense rows (column dense, if there is one) stay in training only. Dates, not rows, are ranked together.
    """
    dates = rows.select("date").distinct()
    n = dates.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction, 0).cast("int")).alias("n"))
    ranked = dates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("date")))).crossJoin(F.broadcast(n))
    out = rows.join(ranked.select("date", F.when(F.col("rank") <= F.col("n"), "test").otherwise("train").alias("part")), "date")
    return out.where("part = 'train' or dense = 0") if "dense" in rows.columns else out


def folds(rows: DataFrame, n_folds: int, embargo_s: float) -> DataFrame:
    """Each fold's rows with fold (1: the last date), test_date and part; training rows end before the fold's first test row less the embargo.

    At most one fold fewer than there are dates. Dense rows are no test rows. A fold without training rows, or
    whose training rows (column y) hold no positive, is left out. Each row is repeated for the folds it serves.
    """
    plain = rows.where("dense = 0") if "dense" in rows.columns else rows
    dates = rows.select("date").distinct().withColumns({"fold": F.row_number().over(Window.orderBy(F.desc("date"))), "_dates": F.count(F.lit(1)).over(Window.partitionBy())})
    dates = dates.where((F.col("fold") <= n_folds) & (F.col("fold") < F.col("_dates"))).drop("_dates")
    tests = plain.groupBy("date").agg(F.min("t").alias("fold_start")).join(dates, "date").withColumnRenamed("date", "test_date")
    joined = rows.join(F.broadcast(tests), F.col("date") <= F.col("test_date"))
    same = F.col("date") == F.col("test_date")
    dense = F.col("dense") == 0 if "dense" in rows.columns else F.lit(True)
    joined = joined.where((same & dense) | (~same & (F.col("t") < F.col("fold_start") - embargo_s))).withColumn("part", F.when(same, "test").otherwise("train"))
    usable = joined.where("part = 'train'").groupBy("fold").agg(F.max("y").alias("any")).where("any > 0").select("fold")
    return joined.join(usable, "fold", "left_semi").drop("fold_start")


def walk_forward(rows: DataFrame, n_folds: int, embargo_s: float) -> DataFrame:
    """(fold, test_date, n_train, n_test) of folds()."""
    return folds(rows, n_folds, embargo_s).groupBy("fold", "test_date").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))


def climatology(train: DataFrame) -> DataFrame:
    """One row, base: the share of positives, clipped to [1e-6, 1 - 1e-6]; an empty table counts as none."""
    return train.agg(F.least(F.greatest(F.coalesce(F.avg("y"), F.lit(0.0)), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("base"))


def persistence(flux_end: Column, flaring: float = 1.5) -> Column:
    """The chance of a baseline that takes a flare now for a flare soon."""
    return F.when(flux_end >= flaring, 0.999).otherwise(0.001)


def fold_summary(scored: DataFrame) -> DataFrame:
    """(fold, test_date, model_tss, persistence_tss) from rows (fold, test_date, y, prob, flux_end): each at its own best threshold.

    Folds without a mix of both labels are left out.
    """
    keys = ["fold", "test_date"]
    mixed = scored.groupBy(*keys).agg(F.avg("y").alias("m")).where("m > 0 and m < 1").select("fold")
    rows = scored.join(mixed, "fold", "left_semi").withColumn("simple", persistence(F.col("flux_end")))

    def best(prob: str, name: str) -> DataFrame:
        """Best skill over the ladder of each fold's own scores."""
        own = rows.select(*keys, "y", F.col(prob).alias("prob"))
        thr = _rungs(own, "prob", tuple(keys))
        by = own.groupBy(*keys, "prob", "y").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(thr), keys)
        hit = F.col("prob") >= F.col("thr")
        cells_ = by.groupBy(*keys, "thr").agg(*[F.sum(F.when(c & (F.col("y") == y), F.col("n")).otherwise(0)).alias(m) for m, c, y in (("tp", hit, 1), ("fp", hit, 0), ("fn", ~hit, 1), ("tn", ~hit, 0))])
        return scores(cells_).groupBy(*keys).agg(F.max("tss").alias(name))

    return best("prob", "model_tss").join(best("simple", "persistence_tss"), keys)


def summary(by_fold: DataFrame) -> DataFrame:
    """One row over folds: means and population deviations of both skills, the mean gap, wins and folds."""
    gap = F.col("model_tss") - F.col("persistence_tss")
    return by_fold.agg(F.avg("model_tss").alias("model_mean"), F.stddev_pop("model_tss").alias("model_std"), F.avg("persistence_tss").alias("persistence_mean"), F.stddev_pop("persistence_tss").alias("persistence_std"), F.avg(gap).alias("gap_mean"), F.count_if(gap > 0).alias("wins"), F.count(F.lit(1)).alias("folds"))


def lead_times(rows: DataFrame, threshold: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, flare_start, lead_min) of flares with an alarm in a positive window before them: the earliest counts.

    rows: (keys, t, y, prob, flare_start).
    """
    early = rows.where(F.col("y") == 1).where(F.col("prob") >= threshold).groupBy(*keys, "flare_start").agg(F.min("t").alias("first"))
    return early.select(*keys, "flare_start", ((F.col("flare_start") - F.col("first")) / 60).alias("lead_min")).where("lead_min >= 0")


def referee(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: correct_alarm, correct_quiet, false_alarm, missed."""
    names = {"tp": "correct_alarm", "tn": "correct_quiet", "fp": "false_alarm", "fn": "missed"}
    return rows.agg(*cells(F.col("prob") >= threshold, F.col("y"))).select(*[F.col(a).alias(b) for a, b in names.items()])


def selected(candidates: DataFrame, persistence_tss: float) -> DataFrame:
    """The chosen model of (model, ordinal, tss, auc): the highest tss of those above persistence, else the highest auc; the first of equals."""
    beats = (F.col("tss") > persistence_tss).cast("int")
    rank = F.struct(beats.alias("b"), F.when(beats == 1, F.col("tss")).otherwise(F.coalesce(F.nanvl("auc", F.lit(-1.0)), F.lit(-1.0))).alias("s"), (-F.col("ordinal")).alias("o"))
    return candidates.agg(F.max_by(F.struct("model", "tss", "auc"), rank).alias("x"), F.sum(beats).alias("n_beating")).select("x.*", "n_beating")


def transitions(rows: DataFrame, threshold: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, t, what): where the alarm is raised and where it ends, from rows (keys, t, prob); a day starts quiet."""
    w = Window.partitionBy(*keys).orderBy("t")
    alarm = F.col("prob") >= threshold
    out = rows.withColumns({"_alarm": alarm, "_was": F.coalesce(F.lag(alarm).over(w), F.lit(False))})
    return out.where("_alarm <> _was").select(*keys, "t", F.when(F.col("_alarm"), "raised").otherwise("all-clear").alias("what"))
