"""Line dedup by winnowing, in DataFrame operations only.

A window starts at every line that has a word and reaches until it holds ``least_words`` words; blank
lines don't count. The smallest line hash of a window is its fingerprint, so two texts that share a
run of that many words share a fingerprint inside it. Windows whose fingerprint occurs at one place
only are done with. The others are joined with the first place that holds the same window; windows
that repeat an earlier one and touch are joined to runs, and the runs are deleted.

These windows leave the last lines of a match where fewer than ``least_words`` words remain after the
last window inside it. With ``to_end`` there is also a window that ends at every line and reaches
back until it holds the words. Every line of a match lies in a window of one kind that lies in the
match, so the runs are then the whole matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strongbox.llm.tables import partitions, written

LEAST_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _key(text: Column) -> list[Column]:
    """What names a document beside its id: rows may be repeated, with other texts too."""
    return [F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_bytes")]


DOCUMENT = ["doc_id", "text_hash", "text_bytes"]


def windows_of(docs: DataFrame, least_words: int = LEAST_WORDS, to_end: bool = False) -> DataFrame:
    """A row per complete window: the document, first and last line, fingerprint and its line, and two
    hashes of the window. ``to_end`` adds the windows that end at a line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(text), F.posexplode(F.split(text, "\n")).alias("line", "value"))
    lines = each.select(
        *DOCUMENT, "line", F.xxhash64("value").alias("h"), F.hash("value").alias("h2"), F.regexp_count("value", F.lit(WORD)).alias("words")
    ).where("words > 0")
    # Rows that are equal in id and text are one document.
    lines = lines.repartition(partitions(docs.sparkSession), *DOCUMENT).dropDuplicates([*DOCUMENT, "line"])
    by_line = Window.partitionBy(*DOCUMENT).orderBy("line")
    lines = lines.withColumn("start", F.sum("words").over(by_line) - F.col("words"))
    ahead = Window.partitionBy(*DOCUMENT).orderBy("start").rangeBetween(0, least_words - 1)

    def over(frame: WindowSpec) -> list[Column]:
        return [
            F.min(F.struct("h", "line")).over(frame).alias("least"),
            F.sum("words").over(frame).alias("held"),
            F.collect_list(F.struct("h", "h2")).over(frame).alias("content"),
        ]

    found = lines.select(*DOCUMENT, "line", F.max("line").over(ahead).alias("last"), *over(ahead)).where(F.col("held") >= least_words)
    if to_end:
        back = Window.partitionBy(*DOCUMENT).orderBy("end").rangeBetween(1 - least_words, 0)
        ending = lines.withColumn("end", F.col("start") + F.col("words")).select(
            *DOCUMENT, F.min("line").over(back).alias("line"), F.col("line").alias("last"), *over(back), "words"
        )
        # Those that hold the words with their last line only also start at a line as windows.
        found = found.unionByName(ending.where(F.col("held") - F.col("words") >= least_words).drop("words"))
    return found.select(
        *DOCUMENT, "line", "last", F.col("least.h").alias("fingerprint"), F.col("least.line").alias("fingerprint_line"),
        F.xxhash64("content").alias("gram"), F.hash("content").alias("gram2"),
    )


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, to_end: bool = False) -> DataFrame:
    """Runs of lines that repeat an earlier run of at least ``least_words`` words: the document, first
    and last line. Documents are in the order of doc_id. Within a document the repeat may not overlap
    the run that it repeats."""
    windows = written(windows_of(docs, least_words, to_end), "windows")
    place = F.struct(*DOCUMENT, "fingerprint_line")
    shared = windows.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fingerprint")
    candidates = windows.join(shared, "fingerprint", "left_semi")
    gram = ["gram", "gram2"]
    first = candidates.groupBy(*gram).agg(F.min(F.struct(*DOCUMENT, "line", "last")).alias("first"))
    same = F.lit(True)
    for c in DOCUMENT:
        same = same & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    repeats = candidates.join(first, gram).where(~same | (F.col("line") > F.col("first.last"))).select(*DOCUMENT, "line", "last")
    by_line = Window.partitionBy(*DOCUMENT).orderBy("line")
    reach = F.max("last").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("opens", F.coalesce(F.col("line") > reach + 1, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("opens").over(by_line)).groupBy(*DOCUMENT, "run")
    return runs.agg(F.min("line").alias("first"), F.max("last").alias("last")).drop("run")


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS, to_end: bool = False) -> DataFrame:
    """Deletes later repeats of runs of lines with at least ``least_words`` words: with ``to_end`` whole,
    else as LINE_DEDUP_SQL says, without the last lines that no window from their start on covers.

    Returns the columns of ``docs`` with the remaining lines as text, and n_lines and n_deleted (long;
    columns of these names are replaced). A row in is a row out. Null texts stay null and have one,
    empty, line. A text that repeats wholly becomes empty with ``to_end``. Rows equal in doc_id and text are one
    document and are returned alike; rows without doc_id come before all others.
    """
    runs = repeated_runs(docs, least_words, to_end).groupBy(*(F.col(c).alias(f"__{c}") for c in DOCUMENT)).agg(
        F.collect_list(F.struct("first", "last")).alias("__runs")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col("doc_id").cast("long"), F.xxhash64(text), F.octet_length(text)]
    at = F.lit(True)
    for mine, c in zip(own, DOCUMENT, strict=True):
        at = at & mine.eqNullSafe(F.col(f"__{c}"))
    gone = F.flatten(F.transform("__runs", lambda r: F.sequence(r["first"], r["last"])))

    def remaining(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: lines[i]), "\n")

    # Inside the lambda the lines are a value, not the split that would be done anew for each of them.
    short = F.transform(F.array(F.split("text", "\n")), remaining)[0]
    lines = F.size(F.split(text, "\n")).cast("long")
    joined = docs.drop("n_lines", "n_deleted").join(runs, at, "left")
    return joined.select(
        *(F.when(F.col("__runs").isNull(), F.col("text")).otherwise(short).alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")),
        lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_deleted"),
    )


LINE_DEDUP_SQL = f"""
with lines as (
  select doc_id, text, i - 1 as line, value, len(regexp_extract_all(value, '{WORD}')) as words
  from (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as value,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
starts as (
  select *, sum(words) over (partition by doc_id order by line) - words as start from lines where words > 0),
windows as (
  select doc_id, line, max(line) over ahead as last, sum(words) over ahead as held,
         array_to_string(list(value) over ahead, chr(10)) as content
  from starts window ahead as (partition by doc_id order by start range between current row and {LEAST_WORDS - 1} following)),
firsts as (
  select *, first_value(doc_id) over same as first_doc, first_value(last) over same as first_last
  from windows where held >= {LEAST_WORDS} window same as (partition by content order by doc_id, line)),
repeats as (
  select doc_id, line, last from firsts where doc_id <> first_doc or line > first_last),
gone as (
  select distinct doc_id, unnest(range(line, last + 1)) as line from repeats)
select l.doc_id,
       coalesce(string_agg(l.value, chr(10) order by l.line) filter (g.line is null), '') as text,
       count(*) as n_lines, count(g.line) as n_deleted
from lines l left join gone g on l.doc_id = g.doc_id and l.line = g.line
group by l.doc_id
"""
