"""Records that are longer than a line, found while files are read in splits.

A file is read in pieces that end at a separator, by as many tasks as it has blocks.  What a piece means depends on what stands
before it: whether a quote is open, how deep the brackets are, where the record began.  Each of these is a
running sum, taken in two steps: the pieces of a block are summed where they lie, the block sums of a file (one row a
block) are added up, and each piece adds what stands before its block to what stands before it in the block.
Where a block's sum depends on the state it is entered in, it is taken for both states.  Only pieces of one record are
brought together; no file is ever a single row.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardgate.workspace import landed

FILE = "_metadata.file_path"
#: Of Spark's two XML parsers, the one that takes each element by itself: the other gives up the rest of a file where tags do not match.
ELEMENTS_APART = {"useLegacyXMLParser": "true"}


def _in_block(last: int | None = None):
    """The pieces of a block in order, up to ``last`` rows from each."""
    w = Window.partitionBy("path", "block").orderBy("at")
    return w if last is None else w.rowsBetween(Window.unboundedPreceding, last)


def _blocks_before():
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, paths: str | list[str], separator: str | None = None, **options: str) -> DataFrame:
    """``path``, ``block`` and ``at`` (the order within a file), ``value``, ``size`` of the file: one row per piece, a line without a separator."""
    reader = spark.read.options(**options)
    return reader.text(paths, lineSep=separator).select(
        F.col(FILE).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        F.col("_metadata.file_size").alias("size"),
    )


def _count(text: Column, characters: str) -> Column:
    """Occurrences of ASCII characters."""
    return reduce(Column.__add__, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(x), F.lit(""))) for x in characters])


def not_blank(text: Column | str, blank: str = " \r\n\t") -> Column:
    return F.btrim(text, F.lit(blank)) != ""


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def with_previous(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` of the piece before, null for the first piece of a file."""
    shown = df.withColumn("_v", F.struct(value.alias("x")))
    ends = shown.groupBy("path", "block").agg(F.max_by("_v", "at").alias("_end")).withColumn(
        "_end", F.last("_end").over(_blocks_before())
    )
    known = shown.join(ends, ["path", "block"])
    return known.withColumn(name, F.coalesce(F.lag("_v").over(_in_block()), "_end")["x"]).drop("_v", "_end")


def with_record(df: DataFrame, begins: Column, name: str = "record") -> DataFrame:
    """``df`` with the place of the last piece, up to and with each, where ``begins`` holds."""
    place = F.struct("block", "at")
    marked = df.withColumn("_b", F.when(begins, place))
    last = df.groupBy("path", "block").agg(F.max(F.when(begins, F.col("at"))).alias("at"))
    last = last.withColumn("_l", F.max(F.when(F.col("at").isNotNull(), place)).over(_blocks_before())).drop("at")
    return marked.join(last, ["path", "block"]).withColumn(name, F.coalesce(F.max("_b").over(_in_block(0)), "_l")).drop("_b", "_l")


def assembled(df: DataFrame, text: Column, between: str, *also: Column, by: str = "record") -> DataFrame:
    """``path``, ``text`` and ``also`` per record: its pieces in order."""
    held = F.sort_array(F.collect_list(F.struct("block", "at", text.alias("t"))))
    return df.groupBy("path", by).agg(held.alias("_p"), *also).withColumn(
        "text", F.array_join(F.transform("_p", lambda p: p["t"]), between)
    ).drop("_p", by)


# --- CSV --------------------------------------------------------------------------------------


def csv_records(lines: DataFrame) -> DataFrame:
    """``path``, ``text``, ``closed`` of each record of lines in which quoted fields may hold line breaks; headers are left out.

    A line begins a record where an even number of quotes stands before it.  A quote that is never closed would
    take in the rest of the file: such lines stand alone and are not ``closed``.  Line breaks in fields become ``\\n``.
    """
    quotes = _count(F.col("value"), '"') % 2
    lines = lines.withColumn("_q", quotes)
    blocks = lines.groupBy("path", "block").agg((F.sum("_q") % 2).alias("_b"))
    blocks = blocks.select("path", "block", _or_zero(F.sum("_b").over(_blocks_before())).alias("_outer"))
    open_ = (_or_zero(F.sum("_q").over(_in_block(-1))) + F.col("_outer")) % 2
    placed = with_record(lines.join(blocks, ["path", "block"]).withColumn("_open", open_).drop("_outer"), F.col("_open") == 0)
    first = lines.groupBy("path").agg(F.min(F.struct("block", "at")).alias("_first"))
    body = placed.join(first, "path").where(F.col("record") != F.col("_first")).drop("_first")
    whole = (F.col("_open") == 0) & (F.col("_q") == 0)
    alone = body.where(whole & (F.trim("value") != "")).select("path", F.col("value").alias("text"), F.lit(True).alias("closed"))
    lines_of = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    longer = body.where(~whole).groupBy("path", "record").agg(lines_of.alias("_l"), (F.sum("_q") % 2 == 0).alias("closed"))
    texts = F.transform("_l", lambda p: p["value"])
    shown = F.when(F.col("closed"), F.array(F.array_join(texts, "\n"))).otherwise(texts)
    return alone.unionByName(longer.select("path", F.explode(shown).alias("text"), "closed"))


# --- JSON -------------------------------------------------------------------------------------

_VALUE = r'(?:"(?:[^"\\]|\\.)*"|[^\s"\[\]{},:]+|\[[^\[\]{}]*\])'
#: The end of a list: values that are no objects, then its bracket.
_TAIL = rf"(?s)^(\s*(?:,?\s*{_VALUE}\s*)*)\]"


def _depths(text: Column) -> Column:
    """Brackets that a text opens, less those that it closes, outside strings; it starts outside one."""
    return _level(F.regexp_replace(text, r'(?s)"[^"]*("|$)', ""))


def _level(text: Column) -> Column:
    """Brackets that a text opens, less those that it closes, in strings and outside."""
    return _count(text, "{[") - _count(text, "]}")


def _unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)


def _with_depth(raw: DataFrame) -> DataFrame:
    """Pieces that end in a brace, with ``inside`` (a string is open before), ``depth`` before and ``after``; landed.

    What a piece changes and what stands before it in its block are found once, for both states the block may be entered in.
    """
    bare = _unescaped(F.col("value"))
    flat = raw.withColumn("_bare", bare)
    # What lies in strings where none is open before lies outside them where one is.
    flat = flat.select("*", (_count(F.col("_bare"), '"') % 2).alias("_q"), _depths(F.col("_bare")).alias("_out"), _level(F.col("_bare")).alias("_all"))
    # The brace after the piece counts where no string is open.
    flat = flat.select(
        "path", "block", "at", "value", "size", "_q",
        (F.col("_out") - (1 - F.col("_q"))).alias("_d0"), (F.col("_all") - F.col("_out") - F.col("_q")).alias("_d1"),
    )
    local = flat.withColumn("_p", _or_zero(F.sum("_q").over(_in_block(-1))) % 2)
    change = lambda inside: F.when(inside == 0, F.col("_d0")).otherwise(F.col("_d1"))
    local = local.select("path", "block", "at", "value", "size", "_q", "_p", change(F.col("_p")).alias("_c0"), change(1 - F.col("_p")).alias("_c1"))
    before = [_or_zero(F.sum(f"_c{i}").over(_in_block(-1))).alias(f"_r{i}") for i in (0, 1)]
    local = landed(local.select("*", *before), "pieces")
    blocks = local.groupBy("path", "block").agg(
        (F.sum("_q") % 2).alias("_b"), F.sum("_c0").alias("_s0"), F.sum("_c1").alias("_s1")
    )
    blocks = blocks.withColumn("_outer", _or_zero(F.sum("_b").over(_blocks_before())) % 2)
    sums = F.when(F.col("_outer") == 0, F.col("_s0")).otherwise(F.col("_s1"))
    blocks = landed(blocks.select("path", "block", "_outer", _or_zero(F.sum(sums).over(_blocks_before())).alias("_down")), "blocks")
    entered = lambda name: F.when(F.col("_outer") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    inside, depth = (F.col("_p") + F.col("_outer")) % 2, F.col("_down") + entered("_r")
    return local.join(blocks, ["path", "block"]).select(
        "path", "block", "at", "value", "size", inside.alias("inside"), depth.alias("depth"), (depth + entered("_c")).alias("after")
    )


def _at_top(prefix: Column) -> Column:
    """Whether what follows ``prefix`` in a piece is a member of the outermost object."""
    return (F.col("inside") == 0) & (F.col("depth") + _depths(_unescaped(prefix)) == 1)


def json_elements(
    spark: SparkSession, paths: str | list[str], keys: Iterable[str], only_if: str | None = None, **options: str
) -> DataFrame:
    """``path``, ``text``, ``listed``: parts of JSON documents, each a few elements or an object of its own.

    The elements of an outermost list, or of the first list among the members ``keys`` of an outermost object, come as
    JSON lists of one object and the values before it; other members of that object are left out.  A document without such a
    list is one part.  ``only_if`` is a member (as a pattern) that an object with a list must have.  What breaks off
    comes as it stands and is no JSON.
    """
    found = _with_depth(pieces(spark, paths, "}", **options))
    place = F.struct("block", "at")
    # Only a bracket that closes brings a piece back to the outermost object.
    near = (F.col("inside") == 0) & ((F.col("depth") <= 1) | F.contains("value", F.lit("]")))
    starts = []
    for key in keys:
        pattern = rf'(?s)^(.*?)"{key}"\s*:\s*\['
        prefix = F.regexp_extract("value", pattern, 1)
        named = near & F.contains("value", F.lit(f'"{key}"')) & F.col("value").rlike(pattern)
        starts.append(named & _at_top(prefix))
    if only_if is not None:
        pattern = rf"(?s)^(.*?){only_if}"
        must = near & F.col("value").rlike(pattern) & _at_top(F.regexp_extract("value", pattern, 1))
    else:
        must = F.lit(True)
    # Numbers alone are taken from the pieces of a block, so that these are not sorted; what a piece says stands in the last bits of its place.
    opens = F.when(F.col("depth") != 0, 0).when(F.col("value").rlike(r"^[\s﻿]*\["), 1).when(F.col("value").rlike(r"^[\s﻿]*\{"), 2).otherwise(0)
    blocks = found.groupBy("path", "block").agg(
        F.min(F.col("at") * 4 + opens).alias("first"),
        F.max(F.col("at") * 2 + (F.col("after") < 0).cast("int")).alias("last"),
        F.sum(F.octet_length("value") + 1).alias("read"),
        F.max("size").alias("size"),
        F.max(must).alias("fits"),
        *[F.min(F.when(begins, F.col("at"))).alias(f"list{rank}") for rank, begins in enumerate(starts)],
    )
    lists = [
        F.when(F.col(f"list{rank}").isNotNull(), F.struct(F.lit(rank).alias("rank"), F.struct("block", F.col(f"list{rank}").alias("at")).alias("at")))
        for rank in range(len(starts))
    ]
    files = blocks.groupBy("path").agg(
        F.min(F.struct("block", "first"))["first"].alias("_first"),
        F.min(F.struct("block", F.shiftright("first", 2).alias("at"))).alias("first"),
        F.max(F.struct("block", "last"))["last"].alias("_last"),
        F.max(F.struct("block", F.shiftright("last", 1).alias("at"))).alias("last"),
        (F.sum("read") > F.max("size")).alias("over"),
        F.min(F.least(*lists) if len(lists) > 1 else lists[0]).alias("list"),
        F.bool_or("fits").alias("fits"),
    )
    code, unended = F.col("_first") % 4, (F.col("_last") % 2 == 1) | F.col("over")
    listed = F.col("list").isNotNull() & F.col("fits") & (code == 2)
    files = landed(files, "documents").select(
        "path",
        F.when(code == 1, 1).when(listed, 2).otherwise(0).alias("base"),
        F.when(listed, F.col("list")["at"]).otherwise(F.col("first")).alias("start"),
        F.when(listed, F.col("list")["rank"]).alias("rank"),
        F.when(unended, F.col("last")).alias("unended"),  # a last piece without a brace after it
    )
    cut = F.col("value")
    for rank, key in enumerate(keys):
        cut = F.when(F.col("rank") == rank, F.regexp_replace("value", rf'(?s)^.*?"{key}"\s*:\s*\[', "")).otherwise(cut)
    cut = F.when(F.col("base") == 1, F.regexp_replace("value", r"^[\s﻿]*\[", "")).otherwise(cut)
    from_start = found.join(files, "path").where(place >= F.col("start")).withColumn("_is", place == F.col("start"))
    from_start = from_start.withColumn("rest", F.when(F.col("_is"), cut).otherwise(F.col("value")))
    level = (F.col("depth") == F.col("base")) | F.col("_is")
    shut = (F.col("base") > 0) & level & (F.col("inside") == 0) & F.contains("rest", F.lit("]")) & F.col("rest").rlike(_TAIL)
    ends = landed(from_start.where(shut).groupBy("path").agg(F.min(place).alias("close")), "ends")
    kept = from_start.join(ends, "path", "left").where(F.col("close").isNull() | (place <= F.col("close")))
    brace = F.when(place == F.col("unended"), "").otherwise("}")
    kept = kept.withColumn(
        "part",
        F.when(place == F.col("close"), F.regexp_extract("rest", _TAIL, 1)).otherwise(F.concat("rest", brace)),
    )
    # The depth before a piece is the one after the piece before it: there a part ended.
    begins = F.col("_is") | ((F.col("inside") == 0) & (F.col("depth") == F.col("base")))
    ordered = with_record(kept.select("path", "block", "at", "part", "base", begins.alias("_new")), F.col("_new"))
    whole = assembled(ordered, F.col("part"), "", F.first("base").alias("base"))
    text = F.regexp_replace("text", r"^\s*,", "")
    return whole.where(not_blank("text", " \r\n\t﻿")).select(
        "path",
        F.when(F.col("base") > 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise(F.col("text")).alias("text"),
        (F.col("base") > 0).alias("listed"),
    )


# --- blocks of text ---------------------------------------------------------------------------


def text_blocks(spark: SparkSession, paths: str | list[str], separator: str, **options: str) -> DataFrame:
    """``path``, ``text`` of the blocks between separators; the pattern may look at the line break before a line, not after it."""
    cut = F.split(F.concat(F.lit("\n"), "value"), separator)
    lines = pieces(spark, paths, **options).select("path", "block", F.posexplode(cut).alias("n", "part"))
    # Parts of one line keep their order, and each but the first begins a block.
    parts = lines.select("path", "block", F.monotonically_increasing_id().alias("at"), "part", "n")
    begun = with_record(parts, F.col("n") > 0)
    return assembled(begun, F.col("part"), "").where(not_blank("text"))


def messages(spark: SparkSession, paths: str | list[str], start: str, **options: str) -> DataFrame:
    """``path``, ``text``, ``is_message``: texts that begin with ``start`` where a line does, and what stands before the first."""
    raw = with_previous(pieces(spark, paths, start, **options), F.col("value").rlike(r"(^\s*|[\r\n])\z"), "_new")
    begins = F.coalesce("_new", F.lit(False))
    first = F.col("_new").isNull()
    part = F.when(first, F.col("value")).otherwise(F.concat(F.lit(start), "value"))
    begun = with_record(raw.withColumn("part", part), begins)
    return assembled(begun, F.col("part"), "", F.bool_or(begins).alias("is_message")).where(F.trim("text") != "")


def known_tags(lines: DataFrame, tags: Iterable[str]) -> DataFrame:
    """``path``, ``tags``, ``root``, ``child`` of XML files: the tags among ``tags`` that open somewhere, and the first two that do."""
    odd = F.contains("value", F.lit("<!")) | F.contains("value", F.lit("<?"))
    bare = F.when(odd, F.regexp_replace("value", r"<!--.*?-->|<\?.*?\?>|<![^>]*>", "")).otherwise(F.col("value"))
    opened = F.regexp_extract_all(bare, F.lit(r"<([A-Za-z_][\w.:-]*)[\s/>]?"), 1)
    seen = lines.where(F.when(odd, F.size(opened) > 0).otherwise(F.col("value").rlike("<[A-Za-z_]")))
    # Tags are looked for only in lines that hold their names after a bracket.
    sets = lines.groupBy("path").agg(
        F.array_compact(F.array(*[
            F.when(F.bool_or((odd | F.contains("value", F.lit(f"<{t}"))) & F.array_contains(opened, t)), F.lit(t)) for t in tags
        ])).alias("tags")
    )
    in_file = Window.partitionBy("path").orderBy("block", "at")
    early = seen.select("path", "block", "at", "value").withColumn("_n", F.row_number().over(in_file)).where("_n <= 2")  # limited before the shuffle
    early = early.select("path", "_n", opened.alias("_t"))
    firsts = early.groupBy("path").agg(F.flatten(F.sort_array(F.collect_list(F.struct("_n", F.slice("_t", 1, 2).alias("t"))))["t"]).alias("_f"))
    return sets.join(firsts, "path").select("path", "tags", F.get("_f", F.lit(0)).alias("root"), F.get("_f", F.lit(1)).alias("child"))


def other_children(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """``path``, ``text`` of the children of the roots that hold none of the ``tags`` that ``files`` (``path``, ``tags``) names.

    A piece is a tag and what follows it.  Files whose tags do not balance have no such children, for their levels mean nothing.
    """
    raw = pieces(spark, paths, "<")
    value = F.col("value")
    event = F.when(value.rlike(r"-->|\]\]>"), False).when(value.rlike(r"^!(--|\[CDATA\[)"), True)  # inside a comment afterwards
    raw = raw.withColumn("_e", event)
    blocks = raw.groupBy("path", "block").agg(F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("at"))).alias("_l"))
    blocks = blocks.select("path", "block", F.last("_l", True).over(_blocks_before()).alias("_l"))
    inside = F.coalesce(F.last("_e", True).over(_in_block(-1)), "_l", F.lit(False))
    tag = F.when(~F.col("_in"), F.nullif(F.regexp_extract("value", r"^([A-Za-z_][\w.:-]*)", 1), F.lit("")))
    shut = value.rlike(r"""^(?:[^>"']|"[^"]*"|'[^']*')*/>""")
    closing = ~F.col("_in") & value.startswith("/")
    step = F.when(closing, -1).when(F.col("_tag").isNotNull() & ~shut, 1).otherwise(0)
    known = raw.join(blocks, ["path", "block"]).withColumn("_in", inside).withColumn("_tag", tag).withColumn("_c", step)
    known = known.select("path", "block", "at", "value", "_tag", "_c", closing.alias("_closing"))
    sums = known.groupBy("path", "block").agg(F.sum("_c").alias("_s"))
    even = sums.groupBy("path").agg(F.sum("_s").alias("_s")).where("_s = 0").select("path")
    down = sums.select("path", "block", _or_zero(F.sum("_s").over(_blocks_before())).alias("_down"))
    depth = F.col("_down") + _or_zero(F.sum("_c").over(_in_block(-1)))
    placed = known.join(even, "path").join(down, ["path", "block"]).withColumn("depth", depth).drop("_down", "_c")
    child = (F.col("depth") == 1) & F.col("_tag").isNotNull()
    begun = with_record(placed.where((F.col("depth") > 1) | child), child).join(files, "path")
    found = F.coalesce(F.array_contains("tags", F.col("_tag")), F.lit(False))
    others = begun.groupBy("path", "record").agg(F.bool_or(found).alias("_known")).where("NOT _known").drop("_known")
    texts = assembled(begun.join(others, ["path", "record"], "left_semi"), F.concat(F.lit("<"), "value"), "")
    return texts.select("path", F.regexp_replace("text", r"\s+\z", "").alias("text"))
