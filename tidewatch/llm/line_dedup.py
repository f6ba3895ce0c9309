"""Repeated runs of lines by a suffix array over line ids, with DataFrame operations only.

The corpus is the sequence of its documents' lines, documents in the order of their ids; suffixes end with their
document. Prefix doubling ranks them: after round h, suffixes with equal first 2^h lines have one rank, namely the
position of the first of them, so a rank is also where that prefix occurs first. A round joins the ranks of a position
and of the position 2^h further on, and keeps those pairs that occur twice; lines that occur once are out from the start.

The ranks of all rounds are the nested intervals of the suffix array whose common prefixes are at least 2^h lines long.
To find the exact lengths, each interval is cut further, by the ranks of shorter and shorter blocks after what its
suffixes are known to share. A suffix ends up in the deepest interval that holds an earlier one: its length is the
longest run from there that the corpus had before. Runs of enough words are deleted where they are later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import materialise, n_words


def _later(at: str, lines: Column | int) -> Column:
    """The position so many lines further on in the same document."""
    return F.struct(F.col(f"{at}.doc").alias("doc"), F.col(f"{at}.content").alias("content"), (F.col(f"{at}.line") + lines).cast("int").alias("line"))


def _rounds(ranks: DataFrame) -> list[DataFrame]:
    """Ranks (at, rank) of round 0, 1, ...; a round has the positions whose prefix of its length occurs twice."""
    rounds, length = [ranks], 1
    while True:
        follow = rounds[-1].select(_later("at", -length).alias("at"), F.col("rank").alias("follow"))
        pairs = rounds[-1].join(follow, "at")
        first = pairs.groupBy("rank", "follow").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
        ranks = materialise(pairs.join(first, ["rank", "follow"]).select("at", F.col("first").alias("rank")), "ranks")
        if ranks.isEmpty():
            return rounds
        rounds.append(ranks)
        length *= 2


def _cut(found: DataFrame, ranks: DataFrame, length: int) -> DataFrame:
    """Intervals (node, shared) with their suffixes at, cut by the next `length` lines.

    Suffixes that agree there form an interval of their own that shares more; its first one, like those that agree with
    none, also stays in the old interval, where it stands for all that went on.
    """
    next_ = ranks.select(F.col("at").alias("next"), F.col("rank").alias("key"))
    keyed = found.withColumn("next", _later("at", F.col("shared"))).join(next_, "next", "left").drop("next")
    inner = keyed.where("key IS NOT NULL").groupBy("node", "shared", "key").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    both = keyed.join(inner, ["node", "shared", "key"], "left")
    goes = F.when(F.col("first").isNotNull(), F.struct(F.col("first").alias("node"), (F.col("shared") + length).alias("shared")))
    stays = F.when(F.col("first").isNull() | (F.col("first") == F.col("at")), F.struct("node", "shared"))
    into = both.select("at", F.explode(F.array_compact(F.array(goes, stays))).alias("into"))
    return into.select("at", "into.node", "into.shared")


def _longest_earlier(rounds: list[DataFrame]) -> DataFrame:
    """(at, shared): how many lines from a position on occur earlier, for all positions where any do."""
    found = None
    for h in reversed(range(len(rounds))):
        own = rounds[h].select("at", F.col("rank").alias("node"), F.lit(1 << h).alias("shared"))
        if h + 1 < len(rounds):  # of suffixes that agree in the next round, too, the first stands for all
            deeper = rounds[h + 1].where("at <> rank").select("at")
            own = own.join(deeper, "at", "left_anti")
        found = own if found is None else _cut(found, rounds[h], 1 << h).unionByName(own)
        if h:
            found = materialise(found, "intervals")
    return found.where("at <> node").select("at", "shared")


def repeated_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(doc, content, start, end): maximal runs of lines with min_words words or more that the corpus had before.

    `end` is exclusive; `content` is a hash of the document's text, which tells apart texts of one id.
    """
    position = F.struct(F.col(id).alias("doc"), F.xxhash64(text).alias("content"))
    lines = docs.select(position.alias("d"), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    at = F.struct("d.doc", "d.content", F.col("line").cast("int").alias("line"))
    lines = lines.select(at.alias("at"), F.xxhash64("content").alias("hash"), F.octet_length("content").alias("bytes"), n_words(F.col("content")).cast("int").alias("words"))
    lines = materialise(lines, "lines")
    often = lines.groupBy("hash", "bytes").agg(F.count("*").alias("n"), F.min("at").alias("rank")).where("n > 1").drop("n")
    often = materialise(lines.join(often, ["hash", "bytes"]).select("at", "rank", "words").dropDuplicates(["at"]), "repeated-lines")
    lengths = _longest_earlier(_rounds(often.select("at", "rank")))
    upto = Window.partitionBy("at.doc", "at.content").orderBy("at.line").rowsBetween(Window.unboundedPreceding, 0)
    sums = materialise(often.select("at", "words", F.sum("words").over(upto).alias("upto")), "sums")
    last = sums.select(F.col("at").alias("last"), F.col("upto").alias("end_upto"))
    runs = lengths.join(sums, "at").withColumn("last", _later("at", F.col("shared") - 1)).join(last, "last")
    runs = runs.where(F.col("end_upto") - F.col("upto") + F.col("words") >= min_words)
    # runs that start later in a document never end earlier: of those with one end the first holds the others
    return runs.groupBy("at.doc", "at.content", (F.col("at.line") + F.col("shared")).alias("end")).agg(F.min("at.line").alias("start"))


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """docs without later copies of repeated runs of lines; adds n_lines and n_lines_removed.

    A run is maximal, may span any number of lines of one document, and counts from min_words words on; its first
    occurrence, by document id and line, stays. Lines are what \\n separates; a null text has none and stays null, an
    empty one has one empty line. Rows that agree in id and text are one document and share its result; a null id comes
    first. All columns stay, `text` with what is left; columns with the added names are replaced. An empty table gives
    an empty table.
    """
    runs = repeated_runs(docs, id=id, text=text, min_words=min_words)
    runs = runs.groupBy("doc", "content").agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    runs = runs.select(F.struct("doc", "content").alias("_at"), "_runs")
    rows = docs.drop("n_lines", "n_lines_removed").withColumn("_at", F.struct(F.col(id).alias("doc"), F.xxhash64(text).alias("content")))
    rows = rows.join(runs.hint("shuffle_hash"), "_at", "left").withColumn("_lines", F.split(text, "\n"))
    left = F.filter("_lines", lambda _, k: ~F.exists(F.col("_runs"), lambda r: (r["start"] <= k) & (k < r["end"])))
    rows = rows.withColumn("_left", F.when(F.col("_runs").isNotNull(), left).otherwise(F.col("_lines")))
    count = {"n_lines": F.coalesce(F.size("_lines"), F.lit(0)), "n_lines_removed": F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0))}
    kept = F.when(F.col("_runs").isNotNull(), F.array_join("_left", "\n")).otherwise(F.col(text))
    return rows.withColumns({**count, text: kept}).select(*[c for c in docs.columns if c not in count], *count)
