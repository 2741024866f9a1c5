"""Work that is done once: ledgers of units, gap logs, budgets, rate limits, batch jobs. State is tables that only grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_key(*parts: Column) -> Column:
    """The key of a unit of work: its parts, nulls as empty, with a bar between. A part of a year carries its window as a part."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def open_units(plan: DataFrame, ledger: DataFrame, key: str = "unit") -> DataFrame:
    """Units of the plan, each once, that no writer's ledger has."""
    return plan.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def attempted(units: DataFrame, work: Callable[[str], int], key: str = "unit") -> DataFrame:
    """(unit, n, state, error): the result of work(unit) for each, in the tasks. done; retry after a transient failure (OSError, so
    also timeouts and lost connections), gap after any other. Only done and gap belong in the ledger; gaps also in the gap log."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for u in pdf[key]:
                try:
                    rows.append((u, int(work(u)), "done", None))
                except OSError as e:
                    rows.append((u, None, "retry", f"{type(e).__name__}: {e}"))
                except Exception as e:  # noqa: BLE001  one unit's failure is a gap, not the job's end
                    rows.append((u, None, "gap", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "n", "state", "error"]).astype({"n": "Int64"})

    return units.select(key).mapInPandas(run, f"{key} string, n long, state string, error string")


def ledger_lines(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what the ledger gains, what the gap log gains)."""
    return results.where("state in ('done', 'gap')").select("unit", F.coalesce("n", F.lit(0)).alias("n")), results.where("state = 'gap'").select("unit", "error")


def within_budget(calls: DataFrame, prices: dict[str, float], missing: int, provider: str, budget: float, since: Column | None = None) -> DataFrame:
    """One row: calls counted by provider and priced, the cost of the next stage, and whether both fit the budget.

    calls: a row for each (provider, at). Providers without a price cost nothing."""
    rows = calls if since is None else calls.where(F.col("at") >= since)
    price = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in prices.items() for x in kv)), F.col("provider")), F.lit(0.0))
    spent = rows.groupBy("provider").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * price), F.lit(0.0)).alias("spent"))
    return spent.withColumn("next", F.lit(missing * prices[provider])).withColumn("fits", F.col("spent") + F.col("next") <= budget)


def admitted(requests: DataFrame, at: str, provider: str, per_minute: int, per_day: int) -> DataFrame:
    """requests with start and admitted: at most per_day a day and provider are let in, in order of time; each starts no sooner than
    60 / per_minute seconds after the one before it. A day is one provider's partition, and bounded by the requests of a day."""
    from pyspark.sql import Window as W

    gap = F.lit(60.0 / max(per_minute, 1))
    day = W.partitionBy(provider, F.to_date(at)).orderBy(at)
    ranked = requests.withColumn("rank__", F.row_number().over(day) - 1).withColumn("admitted", F.col("rank__") < per_day)
    # start_k = max over j <= k of (time_j + (k - j) * gap)
    slack = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 - F.col("rank__") * gap
    start = F.max(slack).over(day.rowsBetween(W.unboundedPreceding, 0)) + F.col("rank__") * gap
    return ranked.withColumn("wait", F.when(F.col("admitted"), F.round(start - F.unix_micros(F.col(at).cast("timestamp")) / 1e6, 6))).drop("rank__")


def job_states(log: DataFrame, job: str = "job", at: str = "at") -> DataFrame:
    """The state of each batch job: that of its last line in the log (sent, collected, failed)."""
    return log.groupBy(job).agg(F.max_by("state", at).alias("state"), F.max(at).alias("at"))


def to_send(items: DataFrame, scored: DataFrame, job_items: DataFrame, log: DataFrame, key: str, most_tries: int = 2) -> DataFrame:
    """items without a score that are in no job still under way, and in fewer than most_tries jobs that came back."""
    states = job_states(log)
    tried = job_items.join(states, "job").groupBy(key).agg(F.count_if(F.col("state") == "sent").alias("under_way"), F.count_if(F.col("state") != "sent").alias("tries"))
    left = items.join(scored.select(key).distinct(), key, "left_anti").join(tried, key, "left")
    return left.where((F.coalesce("under_way", F.lit(0)) == 0) & (F.coalesce("tries", F.lit(0)) < most_tries)).drop("under_way", "tries")


def into_jobs(items: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """items dealt to jobs of at most `size`, by number in the order of the key; each job's lines have one destination."""
    from .ranks import with_row_number

    numbered = with_row_number(items, [key], "row__")
    return numbered.withColumn("job", F.concat(F.lit(f"{name}-"), F.floor(F.col("row__") / size).cast("string"))).drop("row__")
