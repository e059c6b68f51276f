"""Collection and review as set operations on listings, ledger rows and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kg_file, rejected_file
from ..limits import CRAWL_PAGES, HELD_AT_REJECTIONS, REASON_CHARS
from ..tables import written


def ledger_latest(updates: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last entry of each key: the ledger after all updates."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), F.struct(order)).alias("row"))
    return last.select("row.*")


def ledger_skip(status: Column, force: Column) -> Column:
    """What a collector does with a known source: blocked outweighs force, force outweighs collected, failed is tried again."""
    return F.when(status == "blocked", "skip_blocked").when(force, "collect").when(status == "collected", "skip").otherwise("collect")


def twins(ledger: DataFrame, start: DataFrame) -> DataFrame:
    """Ledger keys joined to ``start(key)`` over equal file, then equal hash, then equal file again."""
    rows = ledger.select("key", "file", "final_hash")
    keys = rows.join(start.select("key"), "key", "left_semi")
    for column in ("file", "final_hash", "file"):
        same = keys.where(F.col(column).isNotNull()).select(column).distinct()
        keys = rows.join(same, column, "left_semi").select("key", "file", "final_hash").unionByName(keys).distinct()
    return keys.select("key")


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"(\.kg)?(\.rej\d+)?\.[A-Za-z]+$", "")


def pending_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stems of ``inputs(stem)`` that no ``outputs(folder, stem)`` in Generated or Reviewed has; Rejected doesn't count."""
    done = outputs.where(F.col("folder").isin("Generated", "Reviewed")).select("stem").distinct()
    return inputs.join(done, "stem", "left_anti")


def register_types(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with unseen (kind, name) appended as automatic ones."""
    new = found.select("kind", "name").distinct().join(registry, ["kind", "name"], "left_anti")
    return registry.select("kind", "name", "origin").unionByName(new.withColumn("origin", F.lit("auto")))


def next_version(version: int, changed: bool) -> int:
    return version + 1 if changed else version


def review_queue(generated: DataFrame, ledger: DataFrame) -> DataFrame:
    """``generated(file, engine, n_nodes, n_rels)`` with rejections and whether it is held."""
    times = ledger.groupBy("file").agg(F.max("reject_count").alias("reject_count"))
    rows = generated.join(times, "file", "left").withColumn("reject_count", F.coalesce("reject_count", F.lit(0)))
    return rows.withColumn("held", F.col("reject_count") >= HELD_AT_REJECTIONS)


def rejection_round(ledger_count: Column, files_count: Column) -> Column:
    return F.greatest(F.coalesce(ledger_count, F.lit(0)), F.coalesce(files_count, F.lit(0))) + 1


def next_page(files: DataFrame, batch: str) -> DataFrame:
    number = F.regexp_extract("file", rf"^{batch}_.*_p(\d+)\.", 1)
    return files.agg((F.coalesce(F.max(F.when(number != "", number.cast("int"))), F.lit(0)) + 1).alias("page"))


def review(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ledger after ``decisions(file, approve, reason)``.

    Approval clears the counter and leaves the last reason. Rejection raises the
    counter and sets the reason, at most ``REASON_CHARS`` of it; an empty one is
    null. Files without a decision stay as they are.
    """
    rows = ledger.join(decisions, "file", "left")
    count = F.when(F.col("approve"), 0).when(~F.col("approve"), F.col("reject_count") + 1).otherwise(F.col("reject_count"))
    reason = F.when(~F.col("approve"), F.nullif(F.left("reason", F.lit(REASON_CHARS)), F.lit(""))).otherwise(F.col("last_reject_reason"))
    return rows.withColumn("reject_count", count).withColumn("last_reject_reason", reason).drop("approve", "reason")


def review_moves(files: DataFrame, ledger: DataFrame, inputs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Where each decided document goes, and what follows from it.

    ``files(folder, stem)``, ``ledger(stem, reject_count)``, ``inputs(stem)``,
    ``decisions(stem, approve, regenerate)``. Approval takes a document from
    Generated to Reviewed. Rejection takes it from Generated, else from Reviewed,
    to Rejected under its next number; one that was Reviewed must leave the graph
    (``rebuild``). ``again`` says whether it is generated anew: run, not_asked,
    held or no_input. Null ``goes_to``: the document isn't where it would have to be.
    """
    has = files.groupBy("stem").agg(*(F.count_if(F.col("folder") == x).alias(x) for x in ("Generated", "Reviewed", "Rejected")))
    counted = ledger.groupBy("stem").agg(F.max("reject_count").alias("reject_count"))
    source = inputs.select("stem").distinct().withColumn("has_input", F.lit(True))
    rows = decisions.join(has, "stem", "left").join(counted, "stem", "left").join(source, "stem", "left")
    came = F.when(F.col("Generated") > 0, "Generated").when(~F.col("approve") & (F.col("Reviewed") > 0), "Reviewed")
    rows = rows.withColumn("came_from", came).withColumn("times", rejection_round(F.col("reject_count"), F.col("Rejected")))
    moved, rejected = F.col("came_from").isNotNull(), F.col("came_from").isNotNull() & ~F.col("approve")
    held = F.col("times") >= HELD_AT_REJECTIONS
    again = F.when(~F.coalesce("regenerate", F.lit(True)), "not_asked").when(held, "held").when(F.col("has_input").isNull(), "no_input").otherwise("run")
    return rows.select(
        "stem", "came_from", F.when(moved, F.when(F.col("approve"), "Reviewed").otherwise("Rejected")).alias("goes_to"),
        F.when(rejected, rejected_file(F.col("stem"), F.col("times"))).when(moved, kg_file(F.col("stem"))).alias("file"),
        F.when(rejected, F.col("times")).when(moved, F.lit(0)).otherwise(F.coalesce("reject_count", F.lit(0))).cast("long").alias("reject_count"),
        (rejected & held).alias("held"), (rejected & (F.col("came_from") == "Reviewed")).alias("rebuild"), F.when(rejected, again).alias("again"),
    )


def remove_sources(ledger: DataFrame, targets: DataFrame, block: bool) -> DataFrame:
    """Ledger without the targets and their twins, or with them blocked."""
    gone = twins(ledger, targets).withColumn("gone", F.lit(True))
    if not block:
        return ledger.join(gone, "key", "left_anti")
    return ledger.join(gone, "key", "left").withColumn("status", F.when(F.col("gone"), "blocked").otherwise(F.col("status"))).drop("gone")


def collection_verdict(collected: Column, failed: Column, robots: Column, passed: Column | None = None) -> Column:
    """success, partial or fail from a run's counters; nothing but robots refusals is a failure.

    ``passed``: sources that were known or came twice; they count as progress, as collected ones do.
    """
    progress = collected + (F.lit(0) if passed is None else passed) > 0
    return F.when(failed > 0, F.when(progress, "partial").otherwise("fail")).when(~progress & (robots > 0), "fail").otherwise("success")


def status_counts(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(measure, n): files by folder, ledger rows by status, held sources."""
    parts = files.groupBy(F.concat(F.lit("folder:"), "folder").alias("measure")).agg(F.count("*").alias("n"))
    parts = parts.unionByName(ledger.groupBy(F.concat(F.lit("status:"), "status").alias("measure")).agg(F.count("*").alias("n")))
    return parts.unionByName(ledger.agg(F.lit("held").alias("measure"), F.count_if(F.col("reject_count") >= HELD_AT_REJECTIONS).alias("n")))


def locate(files: DataFrame) -> DataFrame:
    """One row a stem: the document in Generated, else in Reviewed."""
    rank = F.when(F.col("folder") == "Generated", 0).when(F.col("folder") == "Reviewed", 1)
    return files.where(rank.isNotNull()).groupBy("stem").agg(F.min_by(F.struct("folder", "file"), rank).alias("at")).select("stem", "at.*")


def engine_choice(argument: Column, environment: Column, default: str, known: list[str]) -> Column:
    chosen = F.coalesce(F.nullif(argument, F.lit("")), F.nullif(environment, F.lit("")), F.lit(default))
    return F.when(chosen.isin(known), chosen)


def crawl(start: DataFrame, links: DataFrame, known: DataFrame | None = None, blocked: DataFrame | None = None, pages: int = CRAWL_PAGES, robots: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, domain, level, place): pages a crawl tries, breadth first, inside the start's registered domain.

    ``start(url, domain)``, ``links(src, pos, dst, dst_domain)``; known pages are
    passed over without counting as tries but their links go on; blocked ones
    and those that ``robots`` (a column function of urls) forbids are left out
    and count for nothing. The cap holds per domain, in queue order: what comes
    behind it is not tried, and its links are not followed, so the walk ends
    when all domains are full or out of links, however long the way.
    """
    out = blocked.select("url") if blocked is not None else start.select("url").limit(0)
    skip = (known.select("url").distinct() if known is not None else start.select("url").limit(0)).withColumn("known", F.lit(True))

    def allowed(rows: DataFrame) -> DataFrame:
        rows = rows.join(out, "url", "left_anti")
        return rows.where(~F.coalesce(robots(F.col("url")), F.lit(False))) if robots is not None else rows

    queue = allowed(start.select("url", "domain").distinct()).select("url", "domain", F.lit(0).cast("long").alias("from_place"), F.lit(0).cast("long").alias("pos"))
    before = start.select("domain").distinct().select("domain", F.lit(0).cast("long").alias("queued"), F.lit(0).cast("long").alias("tries"))
    order = Window.partitionBy("domain").orderBy("from_place", "pos", "url")
    seen, level = None, 0
    while True:
        rows = queue.join(skip, "url", "left").join(before, "domain").withColumn("new", F.col("known").isNull().cast("long"))
        rows = rows.withColumn("place", F.col("tries") + F.sum("new").over(order)).withColumn("at", F.col("queued") + F.row_number().over(order))
        # A known page goes on as long as tries are left when its turn comes.
        rows = rows.where((F.col("new") == 1) & (F.col("place") <= pages) | (F.col("new") == 0) & (F.col("place") < pages))
        frontier = written(rows.select("url", "domain", F.lit(level).alias("level"), "new", "place", "at"), "frontier")
        if not frontier.limit(1).count():
            break
        seen, level = frontier if seen is None else written(seen.unionByName(frontier), "crawled"), level + 1
        before = written(seen.groupBy("domain").agg(F.max("at").alias("queued"), F.sum("new").alias("tries")), "counters")
        next_ = links.join(frontier.select(F.col("url").alias("src"), "domain", F.col("at").alias("from_place")), "src").where("dst_domain = domain")
        next_ = next_.groupBy(F.col("dst").alias("url"), "domain").agg(F.min(F.struct("from_place", "pos")).alias("first")).select("url", "domain", "first.from_place", "first.pos")
        queue = allowed(next_.join(seen.select("url"), "url", "left_anti"))
    return (seen if seen is not None else frontier).where("new = 1").select("url", "domain", "level", "place")


def qa_pairs(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user turn with the first later answer before the next user turn, and its occurrence number."""
    by = Window.partitionBy(session).orderBy(order)
    asked = F.when(F.col("role") == "user", F.col(order))
    rows = turns.withColumn("question", F.last(asked, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    answers = rows.where("role = 'assistant' and question is not null").groupBy(session, "question").agg(F.min(order).alias("answer"))
    return answers.withColumn("occurrence", F.row_number().over(Window.partitionBy(session).orderBy("question")).cast("long"))


def population_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, upper median, mean and greatest value of each group, from the counts of its different values (a hot group is summed up before it moves)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    upto, all_ = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(all_))
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col(value)))
    return ranked.groupBy(group).agg(F.sum("c").alias("n"), middle.alias("median"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max(value).alias("most"))


def first_in_session(rows: DataFrame, session: str, order: str) -> DataFrame:
    """First row of each session, after whatever filter came before."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(session).orderBy(order))).where("k = 1").drop("k")
