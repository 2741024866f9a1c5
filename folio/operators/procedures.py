"""Whole runs: collection by units, consolidation, corpus, production in stages. Each can be stopped anywhere and run again: what is written
is whole, and only what is missing is done."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.dates import local_time
from ..functions.scores import parsed_answer
from ..sinks.files import append_ledger, append_lines
from ..sources.logs import json_lines, scored
from ..sources.readers import exists
from .corpus import latest_valid, one_of_each, preferred_first, validated
from .index import funnel_by_month
from .joins import replications
from .ranks import with_row_number
from .work import open_units


def collected(spark: SparkSession, plan: DataFrame, fetch: Callable[[str], list[dict]], folder: str, writer: str, schema: str) -> DataFrame:
    """Runs the units of a plan (unit, outlet) that no ledger has: records go to <folder>/lines by outlet and writer, finished units and
    gaps to <folder>/ledger, gaps also to <folder>/gaps. Returns (outlet, found, units) of this run.

    fetch(unit) gives the records of a unit. After an OSError a unit stays open; any other failure is a gap. Records are written before
    the ledger, so a run that stops in between fetches a unit again, and consolidated() drops what is there twice."""
    ledger = f"{folder}/ledger"
    done = spark.read.schema("unit string").json(ledger) if exists(spark, ledger) else spark.createDataFrame([], "unit string")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for unit, outlet in zip(pdf["unit"], pdf["outlet"], strict=True):
                try:
                    rows.append((unit, outlet, "done", None, [json.dumps(r, ensure_ascii=False, default=str) for r in fetch(unit)]))
                except OSError as e:
                    rows.append((unit, outlet, "retry", str(e), []))
                except Exception as e:  # noqa: BLE001  one unit's failure is a gap
                    rows.append((unit, outlet, "gap", f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["unit", "outlet", "state", "error", "records"])

    found = open_units(plan, done).select("unit", "outlet").mapInPandas(run, "unit string, outlet string, state string, error string, records array<string>")
    held = f"{folder}/run-{writer}"
    found.write.mode("overwrite").parquet(held)  # fetched once, read thrice
    found = spark.read.parquet(held)
    records = found.select("outlet", F.explode("records").alias("r")).select("outlet", F.lit(writer).alias("writer"), F.from_json("r", schema).alias("r")).select("outlet", "writer", "r.*")
    append_lines(records, f"{folder}/lines", ["outlet", "writer"])
    finished = found.where("state <> 'retry'").select("unit", "outlet", F.size("records").alias("n"), F.lit(writer).alias("writer"))
    if not found.where("state = 'gap'").isEmpty():
        append_ledger(found.where("state = 'gap'").select("unit", "error"), f"{folder}/gaps")
    append_ledger(finished, ledger)
    return finished.groupBy("outlet").agg(F.sum("n").alias("found"), F.count("*").alias("units"))


def consolidated(raw: DataFrame, need_second: bool = True, days: int = 2) -> DataFrame:
    """One row for each story of raw (outlet, day, url, title, subtitle, p1, p2): real urls, one row a url, local days, stories with title and
    text, replicas marked (n_replicas, is_replica; also of a story's only copy: 1 and false), and the text that a model reads.

    Of equal urls the least by day, outlet and title stays."""
    rows = raw.withColumn("url", ids.unwrapped_url(F.col("url"))).withColumn("url_key__", ids.normal_url(F.col("url")))
    rows = one_of_each(rows, ["url_key__"], [F.col("day"), F.col("outlet"), F.col("title"), F.col("url")])
    rows = rows.withColumn("day", local_time(F.col("day").cast("string"))).where("day is not null and title is not null and p1 is not null")
    rows = rows.where("p2 is not null") if need_second else rows
    rows = replications(rows.withColumn("title_key__", text.title_key(F.col("title"))), "title_key__", "outlet", "day", "url_key__", days)
    body = text.joined_blocks(F.concat(F.lit("TÍTULO: "), "title"), F.concat(F.lit("SUBTÍTULO: "), "subtitle"), F.concat(F.lit("TEXTO: "), "p1"), F.col("p2"), sep="\n\n")
    out = rows.withColumns({"n_replicas": F.col("n_copies") + 1, "is_replica": F.col("is_copy"), "model_text": body})
    return out.drop("url_key__", "title_key__", "group_first", "n_copies", "is_copy")


def for_model(stories: DataFrame, order: list[str]) -> DataFrame:
    """(id, outlet, day, url, text) of the stories that aren't replicas; the id has the story's number among all, so it doesn't move if
    what counts as a replica changes."""
    numbered = with_row_number(stories, order, "row__").where("not is_replica")
    digits = F.col("row__").cast("string")
    name = F.concat(F.substring(text.slug(F.col("outlet")), 1, 4), F.lit("-"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))
    return numbered.select(name.alias("id"), "outlet", F.date_format("day", "yyyy-MM-dd").alias("day"), "url", F.col("model_text").alias("text"))


def built_corpus(raw: DataFrame, kinds: dict[str, str] | None = None, outlets: list[str] | None = None, preserved: DataFrame | None = None, default: str = "press") -> DataFrame:
    """The corpus of consolidated stories: item_id (from the url), day, outlet, kind, title, lead, paragraph, source, wire.

    One row an item, and one for each (outlet, title in its normal form, day): that of a preserved item (item_id) before others, then the
    least id. Only the given outlets, if any; rows without day or title are left out."""
    rows = raw if outlets is None else raw.where(F.col("outlet").isin(outlets))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.trim("outlet")), F.lit(default)) if kinds else F.lit(default)
    day = local_time(F.col("day").cast("string")).cast("date")
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = rows.select(ids.article_id(F.col("url")).alias("item_id"), day.alias("day"), F.trim("outlet").alias("outlet"), kind.alias("kind"), clean("title").alias("title"), clean("subtitle").alias("lead"), clean("p1").alias("paragraph"), ids.unwrapped_url(F.col("url")).alias("source"))
    out = one_of_each(out.where("day is not null and title not in ('', 'nan', 'None')"), ["item_id"], [F.col("day"), F.col("title"), F.col("paragraph")])
    keys = ["outlet", "title_key__", "day"]
    known = preserved if preserved is not None else out.select("item_id").limit(0)
    out = preferred_first(out.withColumn("title_key__", text.text_key(F.col("title"))), known, "item_id", keys, [F.col("item_id")]).drop("title_key__")
    return validated(out.withColumn("wire", text.text_hash(F.col("title"), F.col("lead"))), "item_id", ["title"], {})


def production(spark: SparkSession, items: DataFrame, folder: str, complete, score: str, threshold: float, label_share: float = 0.05, audit: float = 0.10) -> DataFrame:
    """Production in stages over items (item_id, day, message, and the filter's score): a share is labelled by hash, the rest routed by the
    score and audited by hash, what is sent or audited is answered by complete(message), and the index is made by month.

    Items of the hold-out are never touched. Routing of an item, once written, stays (late items are added by the same rule). Answers
    are appended; only items without a valid one are asked for again."""
    held = items.where(~ids.in_holdout(F.col("item_id")))
    routing, answers = f"{folder}/routing", f"{folder}/answers"
    key = F.col("item_id")
    labelled = ids.salted_fraction(key, "label") < label_share
    decision = F.when(labelled, "labelled").when(F.col(score) >= threshold, "sent").when(ids.salted_fraction(key, "audit") < audit, "audited").otherwise("discarded")
    late = held.select("item_id", decision.alias("decision"))
    if exists(spark, routing):
        late = late.join(spark.read.parquet(routing).select("item_id"), "item_id", "left_anti")
    late.write.mode("append").parquet(routing)
    routed = held.join(spark.read.parquet(routing), "item_id")
    fields = f"item_id {items.schema['item_id'].dataType.simpleString()}, answer string, error string, at long"
    asked = routed.where("decision <> 'discarded'").select("item_id", "message")
    valid = parsed_answer(F.col("answer"))["valid"]

    def known() -> DataFrame:
        log = json_lines(spark, answers, fields)[0] if exists(spark, answers) else spark.createDataFrame([], fields)
        return latest_valid(log, "item_id", "at", F.col("error").isNull() & F.col("answer").isNotNull() & valid)

    n = 0 if not exists(spark, answers) else json_lines(spark, answers, fields)[0].agg(F.max("at")).first()[0] or 0
    missing = asked.join(known().select("item_id"), "item_id", "left_anti")
    append_lines(scored(spark, missing, "message", complete).select("item_id", "answer", "error", F.lit(n + 1).cast("long").alias("at")), answers)
    marks = known().select("item_id", parsed_answer(F.col("answer"))["d1"].alias("d1"))
    done = routed.join(marks, "item_id", "left").withColumn("decision", F.when(F.col("decision") == "labelled", "sent").otherwise(F.col("decision")))
    return funnel_by_month(done, 1 / audit)
