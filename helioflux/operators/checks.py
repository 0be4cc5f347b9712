"""Cross-checks of an event's measurements, and its confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalar import none_holds

CHECKS = ("neupert", "accel_timing", "heat_timing", "energy_budget", "qpp_witness", "class_accel", "cross_band", "band_confirm", "class_agree", "temp_fit_agree", "band_vote")


def _said(known: Column, good: Column) -> Column:
    return F.when(~known, "N/A").when(good, "PASS").otherwise("FLAG")


def _have(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def cross_checks(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds check_* (PASS, FLAG or N/A), n_pass, n_flag and checks_run, passed ones of those that could run.

    Reads corr, hard_peak, soft_peak, temp_offset, gamma, temp, qpp_soft, qpp_hard, ratio, bands, confirmed, agree,
    temp_fit, yes and covered; null means not measured.
    """
    c = F.col
    strong = c("ratio") >= config.sig_ratio
    said = {
        "neupert": _said(_have("corr"), c("corr") >= config.neupert_corr),
        "accel_timing": _said(_have("hard_peak", "soft_peak"), c("hard_peak") <= c("soft_peak") + 10),
        "heat_timing": _said(_have("temp_offset"), F.abs("temp_offset") <= config.heat_timing_s),
        "energy_budget": _said(_have("gamma", "temp"), ~((c("gamma") < 5) & (c("temp") <= 8))),
        "qpp_witness": _said(_have("qpp_soft", "qpp_hard"), F.abs(c("qpp_soft") - c("qpp_hard")) <= config.qpp_agree * F.greatest("qpp_soft", "qpp_hard")),
        "class_accel": _said(_have("gamma"), ~(strong & (c("gamma") > 7))),
        "cross_band": F.when(F.coalesce("bands", F.lit(0)) == 0, "N/A").when(c("bands") >= 2, "PASS").when(strong, "FLAG").otherwise("N/A"),
        "band_confirm": _said(_have("confirmed"), c("confirmed")),
        "class_agree": _said(_have("agree"), c("agree")),
        "temp_fit_agree": _said(_have("temp", "temp_fit"), F.greatest("temp", "temp_fit") <= 2 * F.greatest(F.least("temp", "temp_fit"), F.lit(1e-6))),
        "band_vote": F.when(F.coalesce("covered", F.lit(0)) < 2, "N/A").when(c("yes") >= 2, "PASS").when(strong, "FLAG").otherwise("N/A"),
    }
    out = rows.withColumns({f"check_{k}": v for k, v in said.items()})
    count = lambda what: sum(((c(f"check_{k}") == what).cast("int") for k in CHECKS), F.lit(0))
    return out.withColumns({"n_pass": count("PASS"), "n_flag": count("FLAG")}).withColumn("checks_run", F.concat_ws("/", c("n_pass").cast("string"), (c("n_pass") + c("n_flag")).cast("string")))


def confidence(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds confidence_pct and confidence (raw), from n_pass, n_flag, focus_stat, fred, excess, confirmed, match and yes.

    A match counts where confirmed; excess is at least a millionth.
    """
    c = F.col
    margin = c("focus_stat") / config.focus_threshold
    evidence = F.array(F.when(margin > 0, margin / (margin + 1)), F.when(c("fred") > 0, 0.6 * F.least(c("fred") / F.greatest("excess", F.lit(1e-6)), F.lit(1.0))), F.when(c("confirmed"), c("match").cast("double")))
    # Powers in place of repeated factors, as 1 - 0.8 is not 0.2 in binary; the halves' are exact.
    miss = none_holds(evidence, F.pow(F.lit(0.2), c("n_pass"))) * F.pow(F.lit(0.5), F.greatest(F.coalesce("yes", F.lit(0)) - 1, F.lit(0)))
    ran = F.greatest(c("n_pass") + c("n_flag"), F.lit(1))
    out = 100 * (1 - miss) * (1 - 0.5 * c("n_flag") / ran)
    return rows.withColumns({"confidence_pct": F.rint(out * 10) / 10, "confidence": F.bround((c("n_pass") - c("n_flag")) / ran, 3)})


def tally(rows: DataFrame) -> DataFrame:
    """(check, status, n) over all rows."""
    long_ = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"check_{k}").alias("status")) for k in CHECKS])).alias("x")).select("x.*")
    return long_.groupBy("check", "status").agg(F.count(F.lit(1)).alias("n"))
