"""Which texts hold which needles, as equi-joins over grams instead of a substring join of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def runs(text: Column, n: int) -> Column:
    """All distinct runs of n characters; none in a shorter text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def grams(text: Column, most: int = GRAM) -> Column:
    """The distinct runs of 1 to ``most`` characters."""
    return F.flatten(F.array(*(runs(text, n) for n in range(1, most + 1))))


def own_grams(text: Column, most: int = GRAM) -> Column:
    """The grams by which a needle may be looked up: its runs of ``most`` characters, or itself if it is shorter."""
    return F.when(F.length(text) >= most, runs(text, most)).otherwise(F.array(text))


def rarest(needles: DataFrame, counts: DataFrame, *group: str) -> DataFrame:
    """(needle, gram): of each needle the gram of fewest texts by ``counts(gram, n)``; one that no text holds comes first."""
    each = needles.where("needle <> ''").select(*group, "needle", F.explode(own_grams(F.col("needle"))).alias("gram"))
    known = each.join(counts, [*group, "gram"], "left")
    return known.groupBy(*group, "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))


def holders(needles: DataFrame, texts: DataFrame, *group: str) -> DataFrame:
    """(needle, text): the texts of ``texts(text)`` that hold a needle of ``needles(needle)``; empty needles lie in none.

    Texts meet a needle over its rarest gram only; ``group`` columns must agree.
    """
    needles = needles.where("needle <> ''").select(*group, "needle").distinct()
    asked = needles.select(*group, F.explode(own_grams(F.col("needle"))).alias("gram")).distinct()
    # Only grams that some needle has go on.
    found = texts.select(*group, "text").distinct().withColumn("gram", F.explode(grams(F.col("text")))).join(asked, [*group, "gram"], "left_semi")
    counts = found.groupBy(*group, "gram").agg(F.count("*").alias("n"))
    return found.join(rarest(needles, counts, *group), [*group, "gram"]).where(F.contains("text", "needle")).select(*group, "needle", "text")


def inner_runs(needles: DataFrame, longest: int) -> DataFrame:
    """(needle, text): all runs of a needle of up to ``longest`` characters, the length of the longest text to be found in it."""
    length = F.length("needle")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), F.least(length - i + 1, F.lit(longest))), lambda n: F.substring("needle", i, n))))
    return needles.where("needle <> ''").select("needle").distinct().select("needle", F.explode(F.array_distinct(spans)).alias("text"))
