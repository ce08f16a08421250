"""Blocks of Markdown and leaves of JSON as plans: lines and members are rows, and their order is that of windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.operators.chunks import greedy_packs
from heronry.session import forgotten, written

#: Levels of headings that are told apart; deeper ones are of the last.
LEVELS = 9
#: Words under which a section joins the one above, and over which it is cut.
SHORT_WORDS, MOST_WORDS = 64, 1024
MOST_DEPTH = 64
EDGES = "^\\s+|\\s+$"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def markdown_lines(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, i, line, mark, kind): kind is blank, comment, heading, paragraph, list or table; the
    lines of fenced code, its marks too, are paragraph."""
    lines = files.where("content is not null").select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    lines = lines.withColumn("mark", _stripped(F.col("line"))).withColumn("tick", F.col("mark").rlike("^(```|~~~)"))
    ticks = F.sum(F.col("tick").cast("int")).over(Window.partitionBy("path").orderBy("i"))
    kind = F.when(F.col("tick") | (F.col("ticks") % 2 == 1), "paragraph").when(F.col("mark") == "", "blank").when(F.col("mark").startswith("<!--"), "comment")
    kind = kind.when(F.col("mark").startswith("#"), "heading").when(F.col("mark").startswith("|"), "table").when(F.col("mark").rlike("^([-*+]|\\d+[.)]\\s)"), "list").otherwise("paragraph")
    return lines.withColumn("ticks", ticks).select("path", "i", "line", "mark", kind.alias("kind"))


def _headed(lines: DataFrame) -> DataFrame:
    """lines with position and parent: the headings that a line stands under, a heading itself included, and those but the
    last. A heading holds until one of its level or above comes."""
    marks = F.length("mark") - F.length(F.regexp_replace("mark", "^#+", ""))
    level = F.when(F.col("kind") == "heading", F.least(marks, F.lit(LEVELS)))
    upto = Window.partitionBy("path").orderBy("i")
    head = F.struct("i", F.concat(F.repeat(F.lit("#"), marks), F.lit(" "), _stripped(F.regexp_replace("mark", "^#+", ""))).alias("title"))
    lines = lines.withColumn("level", level).withColumn("head", head)
    last = [F.last(F.when(F.col("level") == n, F.col("head")), ignorenulls=True).over(upto) for n in range(1, LEVELS + 1)]
    lines = lines.withColumns({f"h{n}": x for n, x in enumerate(last, 1)})
    above, open_ = F.lit(0), []
    for n in range(1, LEVELS + 1):
        h = F.col(f"h{n}")
        open_.append(F.when(h["i"] > above, h["title"]))
        above = F.greatest(above, F.coalesce(h["i"], F.lit(0)))
    titles = F.array_compact(F.array(*open_))
    lines = lines.withColumn("titles", titles).drop(*[f"h{n}" for n in range(1, LEVELS + 1)], "head", "level")
    return lines.withColumn("position", F.array_join("titles", " > ")).withColumn("parent", F.array_join(F.slice("titles", 1, F.greatest(F.size("titles") - 1, F.lit(0))), " > ")).drop("titles")


def markdown_blocks(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, position, parent, kind, start_line, end_line, content): headings, and runs of lines
    of one kind between them and blank lines. Comments' lines are left out and part nothing."""
    lines = _headed(markdown_lines(files)).where("kind <> 'comment'")
    order = Window.partitionBy("path").orderBy("i")
    new = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(order)).where("kind <> 'blank'")
    own = F.when(F.col("kind") == "heading", F.col("mark")).otherwise(F.col("line"))
    found = lines.groupBy("path", "block", "kind").agg(
        F.min_by("position", "i").alias("position"), F.min_by("parent", "i").alias("parent"), F.min("i").alias("start_line"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("i", own.alias("line")))).alias("l"),
    )
    body = _stripped(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return found.select("path", "position", "parent", "kind", F.col("start_line").cast("int"), (F.col("start_line") + F.col("n") - 1).cast("int").alias("end_line"), body.alias("content"))


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))


def markdown_sections(files: DataFrame, least: int = SHORT_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """The same columns, kind section: a heading with what stands under it. A section of under `least` words joins the one
    that it stands under if nothing but such sections is between; those over `most` words are cut at blank lines.

    Sections that could join the same one are a run. A run joins the section before it if that has their heading and
    hasn't joined another itself, so of runs that could join one after the other every second one stays."""
    order = Window.partitionBy("path").orderBy("start_line")
    blocks = markdown_blocks(files).withColumn("s", F.sum((F.col("kind") == "heading").cast("int")).over(order))
    rows = blocks.groupBy("path", "s").agg(
        F.min_by("position", "start_line").alias("position"), F.min_by("parent", "start_line").alias("parent"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
    )
    by = Window.partitionBy("path").orderBy("s")
    rows = rows.withColumn("short", _words(F.col("content")) < least).withColumns({"was": F.lag("position").over(by), "before": F.struct(F.lag("short").over(by).alias("short"), F.lag("parent").over(by).alias("parent"))})
    # What stands before the first heading is the one section whose own place is also the one it stands under.
    same = F.col("short") & F.coalesce(F.col("before.short"), F.lit(False)) & F.col("parent").eqNullSafe(F.col("before.parent")) & (F.col("was") != "")
    rows = rows.withColumn("run", F.sum((~same).cast("int")).over(by))
    able = F.first(F.col("short") & F.col("was").eqNullSafe(F.col("parent"))).over(Window.partitionBy("path", "run").orderBy("s"))
    rows = rows.withColumn("able", able)
    stays = F.max(F.when(~F.col("able"), F.col("run"))).over(by)
    rows = rows.withColumn("joins", F.col("able") & ((F.col("run") - F.coalesce(stays, F.lit(0))) % 2 == 1))
    rows = rows.withColumn("whole", F.sum((~F.col("joins")).cast("int")).over(by))
    out = rows.groupBy("path", "whole").agg(
        F.min_by("position", "s").alias("position"), F.min_by("parent", "s").alias("parent"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
    )
    cut = out.withColumn("__p", F.split("content", "\n\n")).withColumn("__n", F.transform("__p", _words))
    cut = cut.withColumn("content", F.explode(greedy_packs("__p", "__n", F.lit(most), F.lit("\n\n"))))
    return cut.select("path", "position", "parent", F.lit("section").alias("kind"), "start_line", "end_line", "content")


def json_leaves(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, position, parent, kind, content): the whole text, and each scalar by its path; a row
    of kind error for a text that isn't JSON, or is deeper than MOST_DEPTH. One round per level, as long as there is one."""
    spark = files.sparkSession
    rows = files.where("content is not null").select("path", "content", F.try_parse_json("content").alias("v"))
    top = rows.select("path", F.when(F.col("v").isNull(), "").otherwise("path:/").alias("position"), F.lit("").alias("parent"), F.when(F.col("v").isNull(), "error").otherwise("section").alias("kind"), F.when(F.col("v").isNull(), F.lit("no JSON")).otherwise(F.col("content")).alias("content"))
    now, out, held = rows.where("v is not null").select("path", F.lit("").alias("at"), "v"), [top], None
    for depth in range(MOST_DEPTH + 1):
        now = now.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
        text = F.when(F.col("kind") == "STRING", F.col("v").cast("string")).otherwise(F.to_json("v"))
        scalars = now.where("kind not in ('OBJECT', 'ARRAY')").select("path", F.concat(F.lit("path:"), "at").alias("position"), F.lit("path:/").alias("parent"), F.lit("paragraph").alias("kind"), F.coalesce(text, F.lit("null")).alias("content"))
        out.append(written(scalars, "leaves"))
        inner = now.where("kind in ('OBJECT', 'ARRAY')").drop("kind")
        if inner.isEmpty():
            break
        if depth == MOST_DEPTH:
            out.append(inner.select("path", F.lit("").alias("position"), F.lit("").alias("parent"), F.lit("error").alias("kind"), F.lit("too deep").alias("content")).distinct())
            break
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        below = below.select("path", F.concat("at", F.lit("/"), F.coalesce("key", F.col("pos").cast("string"))).alias("at"), F.col("value").alias("v"))
        before, held = held, written(below.select("path", "at", F.to_json("v").alias("v")), "members")
        now = held.select("path", "at", F.parse_json("v").alias("v"))
        if before is not None:
            forgotten(before)
    return reduce(DataFrame.unionByName, out)
