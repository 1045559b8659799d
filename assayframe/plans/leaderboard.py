"""The study of a leaderboard as one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import study, suites
from ..operators.items import model_totals
from .analysis import Analysis, cohort_sweep, plan


@dataclass(frozen=True)
class Leaderboard:
    """What a study found.  ``pairs`` and ``tied`` are of the cohort, as are the null and the winners.

    ``sweep`` has a row for each cohort size; ``agreement`` one for each trimming;
    ``pairs`` the neighbours in the ranking, and ``n_indistinct`` how many of them
    noise explains; ``null`` a row for each randomisation, and ``null_summary``
    compares it with ``observed``, what a fixed threshold calls backwards.
    """

    cohort: Analysis
    sweep: DataFrame
    agreement: DataFrame
    pairs: DataFrame
    n_indistinct: int
    tied: DataFrame
    observed: int
    null: DataFrame
    null_summary: DataFrame
    winners: DataFrame
    held: tuple[DataFrame, ...]

    def release(self) -> None:
        """Gives the storage back; the tables stay usable and are then computed anew."""
        self.cohort.release()
        for table in self.held:
            table.unpersist()


def leaderboard_study(
    responses: DataFrame,
    cohort: int = study.COHORT,
    sizes: tuple[int, ...] = study.COHORTS,
    randomisations: int = study.RANDOMISATIONS,
    resamples: int = study.RESAMPLES,
    trades: int = study.TRADES,
    seed: int = 0,
    fdr: float = 0.05,
) -> Leaderboard:
    """All studies of one suite's responses; the detailed ones are of its ``cohort`` best models."""
    best = study.top(responses, model_totals(responses), cohort).persist()
    done = plan(best, fdr)
    pairs = suites.adjacent_pairs(done.totals, done.summary)
    kept = {"non-dead": suites.USEFUL, "informative": ("acceptable", "strong")}
    observed = suites.old_rule_backwards(done.moments).first()["old_rule_backwards"]
    null = study.curveball_null(best, randomisations, trades, seed).persist()
    return Leaderboard(
        done,
        cohort_sweep(responses, sizes, fdr),
        study.trimmed_agreement(best, done.totals, done.items, kept),
        pairs,
        pairs.where(~F.col("real")).count(),
        suites.tied_for_first(done.totals, done.summary),
        observed,
        null,
        study.null_summary(null, observed),
        study.bootstrap_winners(best, done.moments.count(), resamples, seed),
        (best, null),
    )
