"""Take in a landing folder of mixed formats: canonical records, and what could not be read.

What a file holds decides how it is read: the header of each CSV file, the layout of each JSON file, the record
tags of each XML file.  Files alike in that are read together, under their own field names, which are then mapped.
Every reader gives records and rejects, one verdict per row, element, block or message, so that nothing landed vanishes
and no odd file stops the others.  Large files are split whatever their format: see :mod:`wardgate.sources.split`.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgate.functions import payload as pl
from wardgate.functions import vocab as v
from wardgate.operators import aliases, naming
from wardgate.sources import fhir, landing, messages, reports, split
from wardgate.workspace import landed

CORRUPT = "_corrupt"
PATH = "_metadata.file_path"
REJECT = "path string, text string, reason string"

Landed = tuple[DataFrame, DataFrame]
Naming = Callable[[str], str | None]


def by_canonical(name: str) -> str | None:
    """Fields by their canonical names in any letter case."""
    return name.strip().lower() if name.strip().lower() in v.CANONICAL else None


def by_synonym(name: str) -> str | None:
    """Fields by the header synonyms of the first intake version."""
    return naming.synonym_map().get(name.strip().lower()) or by_canonical(name)


def by_alias(name: str) -> str | None:
    """Fields by the header aliases of the adapter."""
    found = aliases.resolve_name(name)
    return found if found in v.CANONICAL else by_canonical(name)


def known_names() -> list[str]:
    """Every spelling that some naming knows."""
    return [*v.CANONICAL, *v.CANONICAL.values(), *naming.synonym_map(), *(a for a, _, _ in aliases.alias_rows())]


def _any_case(extension: str) -> str:
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def _options(extension: str) -> dict[str, str]:
    return {"pathGlobFilter": _any_case(extension), "recursiveFileLookup": "true"}


def _fields(columns: Iterable[str], name: Naming) -> dict[str, str]:
    """Source column of each field; the last of several claiming one wins."""
    return {name(c): c for c in columns if name(c)}


def _canonical(df: DataFrame, source: dict[str, str]) -> DataFrame:
    """``path`` and the canonical fields as text."""
    picked = [
        (F.col(f"`{source[f]}`").cast("string") if f in source else F.lit(None).cast("string")).alias(f)
        for f in v.CANONICAL
    ]
    return df.select("path", *picked)


def _rejects(df: DataFrame, text: Column, reason: str) -> DataFrame:
    return df.select("path", text.alias("text"), F.lit(reason).alias("reason"))


def _text(columns: list[str]) -> Column:
    """The text of a bad row; Spark wants a field read beside it."""
    return F.coalesce(CORRUPT, *[F.col(f"`{c}`") for c in columns[:1]])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- CSV --------------------------------------------------------------------------------------

UNKNOWN = "no known field"


def read_csv_files(spark: SparkSession, path: str, extension: str, name: Naming) -> Landed:
    """Files grouped by their header; of files with quoted line breaks the records are found in splits.

    A header without any known field makes each of its rows a reject.
    """
    lines = split.pieces(spark, path, **_options(extension))
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    header = F.min_by("value", F.struct("block", "at"))
    found = lines.groupBy("path").agg(header.alias("header"), F.bool_or(odd).alias("broken"))
    groups: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for r in found.collect():  # one row per file, as the listing of the folder has
        groups[(r.header or "").lstrip("﻿"), r.broken].append(r.path)
    records, rejects = [], []
    for (shown, broken), paths in sorted(groups.items()):
        names = next(csv.reader([shown]), [])
        unique = [c if names.index(c) == i and c else f"{c}#{i}" for i, c in enumerate(names)] or ["#0"]
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*unique, CORRUPT])
        source = _fields([c for c in unique if "`" not in c], name)
        if broken or not source:
            texts = split.csv_records(split.pieces(spark, paths))
            rejects.append(_rejects(texts.where("NOT closed"), F.col("text"), "a quote is never closed"))
            texts = texts.where("closed")
        if not source:
            rejects.append(_rejects(texts, F.col("text"), UNKNOWN))
            continue
        if broken:
            how = {"escape": '"', "columnNameOfCorruptRecord": CORRUPT}
            rows = texts.select("path", F.from_csv("text", schema, how).alias("_r")).select("path", "_r.*")
        else:
            # Without pruning, so that a row is held against its whole header whatever columns are asked for.
            rows = spark.read.option("columnPruning", False).csv(
                paths, schema=schema, header=True, escape='"', columnNameOfCorruptRecord=CORRUPT
            ).withColumn("path", F.col(PATH))
        records.append(_canonical(rows.filter(F.col(CORRUPT).isNull()), source))
        bad = rows.filter(F.col(CORRUPT).isNotNull())
        rejects.append(_rejects(bad, _text(unique), "fields do not match the header"))
    nothing = _nothing(spark)
    return _union([nothing[0], *records]), _union([nothing[1], *rejects])


# --- JSON -------------------------------------------------------------------------------------


def _is_list(value: Column | str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>").isNotNull()


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _held(text: Column) -> Column:
    """The text as the list of its JSON values; the parser alone would pass over what follows the first."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _is_one_value(held: Column) -> Column:
    return F.size(held.cast("array<variant>")) == 1


def json_items(docs: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``docs`` by the elements of their lists, with ``text``, ``is_object``, ``value`` (parsed) and ``readable`` in place of ``body``.

    The list is the document, or the first of its members ``keys`` that holds one; any other document is its own element.
    The parsed value says what each element is, the text what it holds.
    """
    body = F.col("body")
    bare = (body.startswith("{") | body.startswith("[")) & (body.endswith("}") | body.endswith("]"))
    text = F.when(bare, body).when(split.not_blank("body"), F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")))
    rest = [c for c in docs.columns if c != "body"]
    # The text is parsed in a step of its own, for the next one asks for its value twice.
    parsed = docs.withColumn("_text", text).where("_text IS NOT NULL").withColumn("_h", _held(F.col("_text")))
    parsed = parsed.withColumn("_v", F.when(_is_one_value(F.col("_h")), F.try_variant_get("_h", "$[0]", "variant"))).drop("_h")
    member = {k: F.try_variant_get("_v", f"$.{k}", "variant") for k in keys}
    chosen = F.coalesce(*[F.when(_is_list("_v", f"$.{k}"), F.lit(k)) for k in member], F.lit(None).cast("string"))
    shown = parsed.withColumn("_key", chosen).withColumn(
        "_list", F.when(F.col("_key").isNotNull(), F.try_element_at(pl.json_object(F.col("_text")), F.col("_key"))).otherwise(F.col("_text"))
    )
    inner = F.coalesce(*[F.when(F.col("_key") == k, x) for k, x in member.items()], F.col("_v"))
    shown = shown.withColumn("_v", inner).withColumn("_is_list", _is_list("_v"))
    texts = F.when(F.col("_is_list"), F.from_json("_list", "array<string>")).otherwise(F.array("_text"))
    values = F.when(F.col("_is_list"), F.expr("CAST(CASE WHEN _is_list THEN _v END AS ARRAY<VARIANT>)")).otherwise(F.array("_v"))
    items = shown.select(
        *rest, F.col("_v").isNotNull().alias("readable"), F.explode(F.arrays_zip(texts.alias("text"), values.alias("value"))).alias("_i")
    )
    return items.select(
        *rest, F.coalesce("_i.text", F.lit("null")).alias("text"), _is_object(F.col("_i.value")).alias("is_object"), F.col("_i.value").alias("value"),
        "readable",
    )


def json_verdicts(docs: DataFrame, name: Naming, known: Iterable[str]) -> DataFrame:
    """JSON documents (``path``, ``body``) by element: the canonical fields under the document's own member names, ``text``, and the
    ``reason`` why an element is no record, null for records.

    ``known`` are the names to look for, since members become columns one by one.
    """
    items = json_items(docs, v.JSON_ENVELOPES)
    by_field: dict[str, list[str]] = defaultdict(list)
    for k in known:
        if name(k):
            by_field[name(k)].append(k)
    entries = F.map_entries(pl.json_object(F.col("text")))
    lower = F.transform(entries, lambda e: F.struct(F.trim(F.lower(e["key"])).alias("k"), e["value"].alias("x")))
    both = F.transform(lower, lambda e: F.struct(e["k"], F.replace(F.replace(e["k"], F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")).alias("joined"), e["x"]))

    def member(field: str) -> Column:
        names = sorted({k.lower() for k in by_field[field]})
        mine = F.filter("_m", lambda e: e["k"].isin(names) | e["joined"].isin(names))
        return F.try_element_at(mine, F.lit(-1))

    rest = [c for c in docs.columns if c != "body"]
    asked = [f for f in v.CANONICAL if by_field[f]]
    filled = items.withColumn("_m", F.when(F.col("is_object"), both)).select(
        *rest, "text", "is_object", "readable", *[member(f).alias(f) for f in asked]
    )
    known_one = reduce(Column.__or__, [F.col(f).isNotNull() for f in asked])
    reason = F.when(known_one, None).when(~F.col("readable"), "no JSON record").when(F.col("is_object"), UNKNOWN).otherwise("element is no object")
    fields = [(F.col(f"{f}.x") if f in asked else F.lit(None).cast("string")).alias(f) for f in v.CANONICAL]
    # A row passes a generator, so that what is asked of its reason is not worked out once more before its fields are.
    return filled.select(F.inline(F.array(F.struct(*rest, *fields, "text", reason.alias("reason")))))


def json_fields(docs: DataFrame, name: Naming, known: Iterable[str]) -> Landed:
    """Records and rejects of JSON documents (``path``, ``body``), one verdict per element: see :func:`json_verdicts`."""
    return by_verdict(json_verdicts(docs, name, known))


def by_verdict(verdicts: DataFrame) -> Landed:
    """Verdicts as records and rejects."""
    records = verdicts.filter("reason IS NULL").drop("text", "reason")
    return records, verdicts.filter("reason IS NOT NULL").select("path", "text", "reason")


def read_json_files(spark: SparkSession, path: str, extension: str, name: Naming) -> Landed:
    """Files of which most lines are documents are read by lines, the others by the elements of their one document."""
    lines = split.pieces(spark, path, **_options(extension))
    text = F.trim("value")
    end = F.right(F.btrim("value", F.lit(" \t\r\n")), F.lit(1))  # most lines of a longer document are not worth parsing
    whole = F.coalesce((text.startswith("{") | text.startswith("[")) & end.isin("}", "]") & _is_one_value(_held(text)), F.lit(False))
    counts = lines.filter(text != "").groupBy("path").agg((2 * F.count_if(whole) >= F.count("*")).alias("by_line"))
    by_line: dict[bool, list[str]] = defaultdict(list)
    for r in counts.collect():  # one row per file
        by_line[r.by_line].append(r.path)
    docs = []
    if by_line[True]:
        docs.append(split.pieces(spark, by_line[True]).select("path", F.col("value").alias("body")))
    if by_line[False]:
        parts = split.json_elements(spark, by_line[False], v.JSON_ENVELOPES)
        docs.append(parts.select("path", F.col("text").alias("body")))
    if not docs:
        return _nothing(spark)
    verdicts = json_verdicts(_union(docs), name, known_names())
    shown = F.when(F.col("reason").isNotNull(), F.col("text")).alias("text")  # of rejects alone
    return by_verdict(landed(verdicts.select("path", *v.CANONICAL, shown, "reason"), "verdicts"))


# --- XML --------------------------------------------------------------------------------------


def read_xml_files(spark: SparkSession, path: str, extension: str, name: Naming) -> Landed:
    """Files grouped by their record tags: all known ones that occur, else the first child of the root.  Other children of the
    root, with no such tag inside, are rejects.

    Of known tags inside one another the one that is known first counts: an element that holds one known before it is no
    record, and a tag that stands inside one known before it is a field there.
    """
    lines = split.pieces(spark, path, **_options(extension))
    found = split.known_tags(lines, v.XML_RECORD_TAGS)
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for r in found.collect():  # one row per file
        tags = tuple(t for t in v.XML_RECORD_TAGS if t in r.tags) or ((r.child,) if r.child else ())
        groups[tags].append(r.path)
    nothing = _nothing(spark)
    records, rejects = [nothing[0]], [nothing[1]]
    marked = found.select("path")
    chosen = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array_compact(F.array("child")))
    of_tags = [p for tags, paths in groups.items() if tags for p in paths]
    if of_tags:
        files = found.withColumn("tags", chosen).where(~F.array_contains("tags", F.col("root"))).select("path", "tags")
        others = split.other_children(spark, files, of_tags)
        rejects.append(_rejects(others, F.col("text"), "no record tag"))
    empty = lines.filter(F.trim("value") != "").join(marked, "path", "left_anti")
    rejects.append(_rejects(empty, F.col("value"), "no XML record"))
    for tags, paths in sorted(groups.items()):
        if not tags:
            rejects.append(_rejects(split.pieces(spark, paths).filter(F.trim("value") != ""), F.col("value"), "no XML record"))
        fields: dict[str, list[str]] = {}
        for tag in tags:
            if any(tag in own for own in fields.values()):
                continue
            reader = spark.read.format("xml").options(rowTag=tag, inferSchema=False, columnNameOfCorruptRecord=CORRUPT, **split.ELEMENTS_APART)
            fields[tag] = own = [f.name for f in reader.load(paths).schema if f.name != CORRUPT]
            flat = ", ".join(f"`{f}` string" for f in [*own, CORRUPT])
            rows = reader.schema(flat).load(paths).withColumn("path", F.col(PATH))
            for inner in set(own) & set(fields) - {tag}:
                rows = rows.filter(F.col(f"`{inner}`").isNull())
            rows = naming.drop_null_tokens(rows, [c for c in own if c != "path"])
            source = _fields(own, name)
            good = rows.filter(F.col(CORRUPT).isNull())
            if source:
                records.append(_canonical(good, source))
            else:
                rejects.append(_rejects(good, F.to_json(F.struct(*[F.col(f"`{f}`") for f in own])), UNKNOWN))
            rejects.append(_rejects(rows.filter(F.col(CORRUPT).isNotNull()), _text(own), "element cannot be parsed"))
    return _union(records), _union(rejects)


# --- documents --------------------------------------------------------------------------------


def read_document_files(spark: SparkSession, path: str, extension: str, reader: str) -> Landed:
    """Labelled text, HL7, FHIR and imaging dumps: each block, message or entry is a record or a reject."""
    how = _options(extension)
    if reader == "report":
        parts = split.text_blocks(spark, path, v.BLOCK_SEPARATOR, **how)
        is_record, parse = F.coalesce(*reports.block_fields("text").values()).isNotNull(), reports.labelled_blocks
    elif reader == "imaging":
        parts = split.text_blocks(spark, path, r"\n---\n?", **how)
        is_record, parse = F.coalesce(*messages.block_tags("text").values()).isNotNull(), messages.imaging_records
    elif reader == "hl7":
        found = split.messages(spark, path, messages.MESSAGE_START, **how)
        batch = F.col("text").rlike(r"\A\s*(?:[FB]HS\|[^\r\n]*\s*)+\z")  # headers of a batch
        parts, is_record, parse = found.filter(F.col("is_message") | ~batch), F.col("is_message"), messages.hl7_records
    else:
        bundle = r'"resourceType"\s*:\s*"Bundle"'
        found = split.json_elements(spark, path, ("entry",), bundle, **how).select("path", F.col("text").alias("body"))
        entry = F.try_variant_get("value", "$.resource.resourceType", "string").isNotNull()
        own = F.try_variant_get("value", "$.resourceType", "string") != "Bundle"
        kind = F.when(F.col("is_object") & entry, "entry").when(F.col("is_object") & own, "own")
        parts = landed(json_items(found, ()).select("path", "text", kind.alias("_kind")), "entries")  # cut and parsed once for both
        listed = F.concat(F.lit('{"resourceType":"Bundle","entry":['), "text", F.lit("]}"))
        is_record, parse = F.col("_kind").isNotNull(), fhir.records
    body = F.when(F.col("_kind") == "entry", listed).otherwise(F.col("text")) if reader == "fhir" else F.col("text")
    records = parse(parts.filter(is_record).select(F.col("path").alias("doc_id"), body.alias("body")))
    kept = _canonical(records.withColumnRenamed("doc_id", "path"), _fields(records.columns, by_canonical))
    return kept, _rejects(parts.filter(~is_record), F.col("text"), "no record in the document")


def _nothing(spark: SparkSession) -> Landed:
    records = ", ".join(f"{f} string" for f in ("path", *v.CANONICAL))
    return spark.createDataFrame([], records), spark.createDataFrame([], REJECT)


def take_in(spark: SparkSession, path: str, name: Naming = by_canonical) -> Landed:
    """(records, rejects) of every file under ``path``.

    Records have the canonical fields, the ``format`` and the ``path``; rejects have ``path``, ``text`` and
    ``reason``.  Files of unknown kind, and kinds that need a decoder first, are rejects without text.  One scan
    per kind finds what its files hold, one reads each group of alike files.
    """
    files = landing.classify(landing.list_files(spark, path))
    unread = files.filter(F.col("reader").isNull() | F.col("reader").isin("xlsx", "pdf_text"))
    reason = F.when(F.col("reader").isNull(), "unknown kind of file").otherwise("needs a decoder first")
    nothing = _nothing(spark)
    records = [nothing[0].withColumn("format", F.lit(None).cast("string"))]
    rejects = [nothing[1], unread.select("path", F.lit(None).cast("string").alias("text"), reason.alias("reason"))]
    kinds = files.filter(F.col("reader").isNotNull()).select("extension", "reader").distinct()
    for extension, reader in sorted(tuple(row) for row in kinds.collect()):
        if reader in ("xlsx", "pdf_text"):
            continue
        if reader in ("csv", "json", "xml"):
            read = {"csv": read_csv_files, "json": read_json_files, "xml": read_xml_files}[reader]
            good, bad = read(spark, path, extension, name)
        else:
            good, bad = read_document_files(spark, path, extension, reader)
        records.append(good.withColumn("format", F.lit(extension[1:].upper())))
        rejects.append(bad)
    return naming.canonical_rename(_union(records)), _union(rejects)


def read_landing(spark: SparkSession, path: str, name: Naming = by_canonical) -> DataFrame:
    """The records of :func:`take_in` alone."""
    return take_in(spark, path, name)[0].select(*v.CANONICAL, "format")
