"""Change history: co-changes, risk, ownership, log parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewire.functions import text as T

#: Weights of the parts of a risk score.
RISK_WEIGHTS = {"changes": 0.25, "fixes": 0.30, "regressions": 0.20, "recent": 0.15, "authors": 0.10}


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(hash, author_name, author_email, date, subject, file) from exported log lines (at, line) in order of ``at``.

    A header has 40 hexadecimal digits before its first bar; the subject may
    hold bars itself. File lines belong to the last header before them.
    ``at`` must be ordered within ``source``, one log per source.
    """
    w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^([0-9a-f]{40})\|", 1) != ""
    parts = F.split("line", r"\|", 5)
    struct = F.when(header, F.struct(*[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(("hash", "author_name", "author_email", "date", "subject"))]))
    owned = lines.where("trim(line) <> ''").select("source", "at", "line", header.alias("is_header"), F.last(struct, ignorenulls=True).over(w).alias("c"))
    return owned.where(~F.col("is_header") & F.col("c").isNotNull()).select("source", "c.*", F.trim("line").alias("file"))


def touched(commits: DataFrame, group: str = "repo_id", commit: str = "hash", files: str = "files") -> DataFrame:
    """(group, commit, file): distinct files of each commit, whatever the number of its deliveries."""
    rows = commits.select(F.col(group).alias("g"), F.col(commit).alias("c"), F.explode(files).alias("file"))
    return rows.where("g is not null and c is not null and file is not null and file <> ''").distinct()


def commits_of_files(commits: DataFrame, group: str = "repo_id", commit: str = "hash", files: str = "files", merge: str = "is_merge") -> DataFrame:
    """(g, file, commits): 64-bit hashes of the commits that touch each file, without merges, whatever the number of their deliveries."""
    known = commits.where(F.col(group).isNotNull() & F.col(commit).isNotNull())
    one = known.groupBy(F.col(group).alias("g"), F.col(commit).alias("c")).agg(F.bool_or(F.coalesce(merge, F.lit(False))).alias("merge"), F.array_distinct(F.flatten(F.collect_set(files))).alias("fs"))
    rows = one.where("not merge").select("g", F.xxhash64("c").alias("c"), F.explode("fs").alias("file")).where("file is not null and file <> ''")
    return rows.groupBy("g", "file").agg(F.collect_set("c").alias("commits"))


def co_changes(items: DataFrame, dates: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (g, a, b) of items changed together, with count, Jaccard, first and last date.

    items: g, c, file; dates: g, c, date. All items of a commit give pairs;
    those with fewer than ``least`` changes cannot be in one and are left out
    first. Pairs are made one first item at a time, so that a large commit is
    never held as a whole array of pairs.
    """
    total = items.groupBy("g", "file").agg(F.count("*").alias("t"))
    often = total.where(F.col("t") >= least).select("g", "file")
    sets = items.join(often, ["g", "file"]).groupBy("g", "c").agg(F.array_sort(F.collect_list("file")).alias("fs")).where(F.size("fs") > 1)
    firsts = sets.join(dates, ["g", "c"]).select("g", "date", "fs", F.posexplode("fs").alias("i", "a"))
    pairs = firsts.select("g", "date", "a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("b"))
    counted = pairs.groupBy("g", "a", "b").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).where(F.col("n") >= least)
    side = lambda x: total.select("g", F.col("file").alias(x), F.col("t").alias(f"n_{x}"))
    both = counted.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
    return both.select("g", "a", "b", "n", "n_a", "n_b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"), "first_date", "last_date")


def co_change_edges(pairs: DataFrame, least: float = 0.25) -> DataFrame:
    """Both directions of the pairs with a Jaccard of at least ``least``, to three places."""
    kept = pairs.where(F.col("jaccard") >= least).select("g", F.col("a").alias("src"), F.col("b").alias("dst"), F.round("jaccard", 3).alias("confidence"))
    return kept.unionByName(kept.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))


def risk_scores(changes: DataFrame, as_of: Column) -> DataFrame:
    """(g, file, score and its parts) from one row per (g, file, commit): date, author, is_fix, is_revert.

    Each part is taken against its greatest value in the group; a regression is
    a fix within 30 days of the fix before it, or a revert.
    """
    w = Window.partitionBy("g", "file").orderBy("date", "c")
    fixes = changes.where("is_fix").select("g", "file", "c", "date", F.lag("date").over(w).alias("before"))
    again = fixes.where(F.col("date") <= F.col("before") + F.expr("INTERVAL 30 DAYS")).groupBy("g", "file").agg(F.count("*").alias("again"))
    parts = changes.groupBy("g", "file").agg(
        F.count("*").alias("changes"), F.count_if("is_fix").alias("fixes"), F.count_if("is_revert").alias("reverts"), F.count_if(F.col("date") >= as_of - F.expr("INTERVAL 30 DAYS")).alias("recent"), F.countDistinct("author").alias("authors")
    )
    full = parts.join(again, ["g", "file"], "left").select("g", "file", "changes", "fixes", "recent", "authors", (F.coalesce("again", F.lit(0)) + F.col("reverts")).alias("regressions"))
    most = full.groupBy("g").agg(*[F.max(k).alias(f"m_{k}") for k in RISK_WEIGHTS])
    share = lambda k: F.when(F.col(f"m_{k}") > 0, F.col(k) / F.col(f"m_{k}")).otherwise(0.0)
    score = sum((F.lit(v) * share(k) for k, v in RISK_WEIGHTS.items()), F.lit(0.0))
    return full.join(most, "g").select("g", "file", *RISK_WEIGHTS, F.round(score, 4).alias("score"))


def ownership(changes: DataFrame) -> DataFrame:
    """(g, file, author, share, state): authors' shares of a file's commits in percent; sole from 80 on, else shared; orphaned without authors."""
    per = changes.groupBy("g", "file", "author").agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("author").isNotNull(), F.col("n"))).over(Window.partitionBy("g", "file"))
    share = per.withColumn("share", F.when(F.col("author").isNotNull(), F.round(100.0 * F.col("n") / total, 2)))
    top = F.max("share").over(Window.partitionBy("g", "file"))
    state = F.when(top.isNull(), "orphaned").when(top >= 80, "sole").otherwise("shared")
    return share.select("g", "file", "author", "share", state.alias("state"))


def classify(commits: DataFrame) -> DataFrame:
    """Adds is_fix, is_revert and is_merge_subject by wording of the subject."""
    return commits.withColumns({"is_fix": F.coalesce(F.col("subject").rlike(T.BUG_FIX), F.lit(False)), "is_revert": F.coalesce(F.col("subject").rlike(T.REVERT), F.lit(False)), "is_merge_subject": F.coalesce(F.col("subject").rlike(T.MERGE), F.lit(False))})
