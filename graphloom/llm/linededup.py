"""Operator 5: line deduplication by prefix doubling, with DataFrame functions only.

The corpus is a sequence of line names, one text after another by id.  Prefix doubling ranks
all suffixes by their first line, then by 2, 4, 8 ... lines: the rank of a suffix at 2h lines is
that of the pair (its rank at h, the rank at h of the suffix h lines on).  Equal ranks at a
length are an interval of the suffix array whose common prefix is at least that long, so its
members are copies of one run and the first of them in the corpus stays.

A run is worth deleting if it has ``min_words`` words.  Every line of such a run lies in a
shortest window of so many words that starts or ends inside it, and a window of any length is
named by two overlapping ranks, so doubling ends at the longest shortest window; the windows
that have an earlier copy add up to the maximal repeated runs.  Suffixes whose prefix occurs
once drop out of each doubling, which therefore handles fewer and fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, global_index

MIN_WORDS = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _named(text: Column) -> Column:
    return F.transform(_lines(text), lambda x: F.struct(F.unhex(F.md5(x)).alias("name"), F.regexp_count(x, F.lit(r"\S+")).alias("words")))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _double(level: DataFrame, size: int) -> DataFrame | None:
    """From ranks at ``size`` lines to those at twice as many: ``at, rank, first``; only
    suffixes whose prefix occurs again.  None if there are none."""
    later = level.select((F.col("at") - size).alias("at"), F.col("rank").alias("then"))
    pairs = cut(level.select("at", "rank").join(later, "at"))
    keys = pairs.groupBy("rank", "then").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    if keys.isEmpty():
        return None
    ranked = global_index(keys, ["rank", "then"], "next")
    return cut(pairs.join(ranked, ["rank", "then"]).select("at", F.col("next").alias("rank"), "first"))


def suffix_ranks(lines: DataFrame, longest: int) -> dict[int, DataFrame]:
    """Ranks at 1, 2, 4, ... up to ``longest`` lines of all suffixes of ``lines`` (``at, name``)
    whose prefix of that length occurs more than once: ``at, rank, first`` (its first place)."""
    keys = lines.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    level = cut(lines.join(global_index(keys, ["name"], "rank"), "name").select("at", "rank", "first"))
    levels, size = {1: level}, 1
    while 2 * size <= longest:
        level = _double(level, size)
        if level is None:
            break
        size *= 2
        levels[size] = level
    return levels


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """``at, size``: for each line the shortest window of ``min_words`` words that starts with
    it and the shortest that ends with it.  ``lines``: ``seq, pos, at, words``."""
    text = Window.partitionBy("seq").orderBy("pos")
    sums = lines.withColumn("upto", F.sum("words").over(text)).withColumn("before", F.col("upto") - F.col("words"))
    # one sorted sweep for each side: a line asks for the nearest place that is far enough
    asks, gives = sums.select("seq", "pos", "at", (F.col("before") + min_words).alias("v"), F.lit(1).alias("ask")), sums.select("seq", "pos", "at", F.col("upto").alias("v"), F.lit(0).alias("ask"))
    down = Window.partitionBy("seq").orderBy(F.col("v").desc(), "ask", F.col("pos").desc())
    to = F.last(F.when(F.col("ask") == 0, F.col("pos")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    forward = asks.unionByName(gives).withColumn("to", to).where("ask = 1 and to is not null").select("at", (F.col("to") - F.col("pos") + 1).alias("size"))
    asks, gives = sums.select("seq", "pos", "at", (F.col("upto") - min_words).alias("v"), F.lit(1).alias("ask")), sums.select("seq", "pos", "at", F.col("before").alias("v"), F.lit(0).alias("ask"))
    up = Window.partitionBy("seq").orderBy("v", "ask", "pos")
    since = F.last(F.when(F.col("ask") == 0, F.col("pos")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    backward = asks.unionByName(gives).withColumn("since", since).where("ask = 1 and since is not null")
    backward = backward.select((F.col("at") - F.col("pos") + F.col("since")).alias("at"), (F.col("pos") - F.col("since") + 1).alias("size"))
    return forward.union(backward).where("size > 1")


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_key, owner, gone array<int>``: for each distinct text with at least ``min_words``
    words, the id that owns it (the smallest) and the numbers of its lines that are later
    copies; empty if none is."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    named = docs.select("id", _text_key(F.col("text")).alias("text_key"), _named(F.col("text")).alias("lines"))
    enough = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["words"]) >= min_words
    texts = named.where(enough).groupBy("text_key").agg(F.min("id").alias("owner"), F.first("lines").alias("lines"))
    texts = cut(global_index(texts, ["owner", "text_key"], "seq"))
    stride = 2 * (texts.agg(F.max(F.size("lines"))).first()[0] or 1)  # a doubled prefix never reaches the next text
    lines = texts.select("seq", F.posexplode("lines").alias("pos", "line")).select("seq", "pos", (F.col("seq") * stride + F.col("pos")).alias("at"), "line.*")
    # texts in which every line has enough words have no longer windows
    short = texts.where(F.exists("lines", lambda x: x["words"] < min_words))
    short = short.select("seq", F.posexplode("lines").alias("pos", "line")).select("seq", "pos", (F.col("seq") * stride + F.col("pos")).alias("at"), "line.words")
    windows = cut(_windows(short, min_words).distinct())
    longest = windows.agg(F.max("size")).first()[0] or 1
    levels = suffix_ranks(lines.select("at", "name"), longest)
    alone = lines.where(F.col("words") >= min_words).select("at").join(levels[1].where("first < at").select("at"), "at")
    covered = alone
    for size, level in levels.items():
        if size == 1 and longest == 1:
            continue
        own = windows.where((F.col("size") >= size) & (F.col("size") < 2 * size))
        head, tail = level.select("at", "rank"), level.select(F.col("at").alias("last"), F.col("rank").alias("then"))
        runs = cut(own.join(head, "at").withColumn("last", F.col("at") + F.col("size") - size).join(tail, "last").select("at", "size", "rank", "then"))
        first = runs.groupBy("size", "rank", "then").agg(F.min("at").alias("first"))
        later = runs.join(first, ["size", "rank", "then"]).where("first < at")
        covered = covered.union(later.select(F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")))
    gone = covered.select(F.floor(F.col("at") / stride).alias("seq"), (F.col("at") % stride).cast("int").alias("pos"))
    gone = gone.groupBy("seq").agg(F.collect_set("pos").alias("gone"))
    return texts.select("seq", "text_key", "owner").join(gone, "seq", "left").select(
        "text_key", "owner", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")
    )


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without later copies of repeated line runs, with ``n_lines int`` and ``n_removed
    int`` (of lines; columns of these names are replaced).

    Lines end at ``\\n``; a run is any number of whole lines in a row with at least ``min_words``
    words together; of its copies the first stays, by id and line, and the lines of the others
    go.  Texts of fewer words stay as they are; of equal texts with enough words the smallest id keeps
    its own.  Null text stays null (0 lines) and rows without an id stay as they are.  Repeated
    rows (same id and text) are treated alike.  All rows and other columns are kept."""
    columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    keyed = df.select(*[F.col(f"`{c}`") for c in columns]).withColumn("__key", F.when(F.col(id_col).isNotNull(), _text_key(F.col(text_col).cast("string"))))
    gone = repeated_lines(df, min_words, id_col, text_col).withColumnsRenamed({"text_key": "__key", "owner": "__owner", "gone": "__gone"})
    found = keyed.join(gone, "__key", "left")
    lines, count = _lines(F.col(text_col)), F.size(_lines(F.col(text_col)))
    here = F.col("__owner") == F.col(id_col)
    # the numbers are taken out as a set, so the work is linear in the lines
    left = F.array_except(F.sequence(F.lit(0), count - 1), "__gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    removed = F.when(F.col("__owner").isNull(), 0).when(here, F.size("__gone")).otherwise(count)
    text = F.when(F.col("n_removed") == 0, F.col(text_col)).when(here, kept).otherwise("")
    return (
        found.withColumns({"n_lines": F.coalesce(F.when(F.col(text_col).isNotNull(), count), F.lit(0)), "n_removed": removed})
        .withColumn(text_col, text)
        .select(*[F.col(f"`{c}`") for c in columns], "n_lines", "n_removed")
    )
