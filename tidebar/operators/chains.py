"""Sequential choices as links: each row names the row that may follow it, and chains are followed level by level.

A trader with one position at a time takes the first trade, then the first one at or after its release, and
so on.  Every trade's follower is known without knowing which trades are taken, so the choice is a walk
along links.  Runs of bars shorten it: inside a run each row learns where its chain leaves the run, and
only rows that a chain can enter from outside form the next, far smaller level.  The top level is walked
from its first row, and each level below replays the one row by which it is entered.  Neither the length
of a link nor the number of rows in between matters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidebar.session import cut_lineage

RUN = 1024  # positions in a run of the lowest level
FACTOR = 64  # runs in a run of the next level


def followers(rows: DataFrame, run: int = RUN) -> DataFrame:
    """symbol, at, next: for every (symbol, at, free) the first ``at`` of its symbol at or after ``free``.

    ``at`` is unique per symbol.  Rows and questions share one order inside runs of positions; the run
    table carries the first row of later runs, so questions may reach any distance.
    """
    none = F.lit(None).cast("long")
    own = rows.select("symbol", F.col("at").alias("_pos"), F.col("at").alias("_to"), none.alias("at"))
    ask = rows.select("symbol", F.greatest("free", F.col("at") + 1).alias("_pos"), none.alias("_to"), "at")
    both = own.unionByName(ask).withColumn("_run", F.floor((F.col("_pos") - 1) / run))
    ends = both.where("_to IS NOT NULL").groupBy("symbol", "_run").agg(F.min("_to").alias("_first"))
    known = both.select("symbol", "_run").distinct().join(ends, ["symbol", "_run"], "left")
    later = known.withColumn("_later", F.min("_first").over(W.partitionBy("symbol").orderBy("_run").rowsBetween(1, W.unboundedFollowing))).drop("_first")
    here = F.min("_to").over(W.partitionBy("symbol", "_run").orderBy("_pos").rangeBetween(0, W.unboundedFollowing))
    found = both.withColumn("_here", here).where(F.col("at").isNotNull()).join(later, ["symbol", "_run"])
    return found.select("symbol", "at", F.coalesce("_here", "_later").alias("next"))


def _follow(at: list, next_: list, start: int) -> list:
    """The positions of a run that a walk from ``start`` visits."""
    step, out = dict(zip(at, next_)), []
    while start in step:
        out.append(start)
        start = step[start]
    return out


def _exits(frames):
    """Where the walk from each position of a run leaves the run."""
    for pdf in frames:
        exits = []
        for at, next_ in zip(pdf["at"], pdf["next"]):
            leave = {}
            for a, n in zip(reversed(list(at)), reversed(list(next_))):
                leave[a] = leave.get(n, n)
            exits.append([leave[a] for a in at])
        yield pdf.assign(leave=exits)


def _walk(frames):
    for pdf in frames:
        walks = [_follow(list(a), list(n), s) for a, n, s in zip(pdf["at"], pdf["next"], pdf["start"])]
        yield pd.DataFrame({"symbol": pdf["symbol"], "at": walks})


END = -1  # no follower


def levels(rows: DataFrame, run: int = RUN, factor: int = FACTOR, most: int = 9) -> int:
    """Levels until every symbol lies in one run, from its first and last ``at``."""
    ends = rows.groupBy("symbol").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    cut = lambda c, k: F.floor((F.col(c) - 1) / (run * factor**k))
    several = ends.agg(*[F.max(cut("a", k) < cut("b", k)) for k in range(most)]).first()
    return 1 + sum(bool(x) for x in several)


def chain(links: DataFrame, depth: int, run: int = RUN, factor: int = FACTOR) -> DataFrame:
    """symbol, at: the rows visited from the first one of each symbol; links are (symbol, at, next), next null at the end.

    ``depth`` comes from ``levels`` over the same rows.
    """
    return _level(links.select("symbol", "at", F.coalesce("next", F.lit(END)).alias("next")), depth, run, factor)


def _level(links: DataFrame, depth: int, run: int, factor: int) -> DataFrame:
    no = F.floor((F.col("at") - 1) / run)
    runs = links.groupBy("symbol", no.alias("_run")).agg(F.array_sort(F.collect_list(F.struct("at", "next"))).alias("t"))
    runs = runs.select("symbol", "_run", F.col("t")["at"].alias("at"), F.col("t")["next"].alias("next"))
    kind = "symbol string, at array<long>"
    flat = lambda walks: walks.select("symbol", F.explode("at").alias("at"))
    if depth == 1:
        return flat(runs.withColumn("start", F.element_at("at", 1)).mapInPandas(_walk, kind))
    solved = cut_lineage(runs.mapInPandas(_exits, "symbol string, _run long, at array<long>, next array<long>, leave array<long>"))
    rows = solved.select("symbol", F.explode(F.arrays_zip("at", "leave")).alias("x")).select("symbol", "x.at", F.col("x.leave").alias("next"))
    entered = rows.where(F.col("next") != END).select("symbol", F.col("next").alias("at")).unionByName(rows.groupBy("symbol").agg(F.min("at").alias("at"))).distinct()
    upper = _level(rows.join(entered, ["symbol", "at"]), depth - 1, run * factor, factor)
    starts = upper.select("symbol", no.alias("_run"), F.col("at").alias("start"))
    return flat(solved.select("symbol", "_run", "at", "next").join(starts, ["symbol", "_run"]).mapInPandas(_walk, kind))
