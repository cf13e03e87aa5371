"""Fuzzy line dedup with DataFrame functions only: MinHash of character shingles, banding, exact Jaccard, union-find."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.linking import link
from fleetlens.llm.workspace import Workspace

SIZE = 8  # characters in a shingle
BANDS, ROWS = 12, 3
GROUP = 3  # bands whose keys are shuffled together
STEP = 8  # shingles of a row, whose minima are taken before the line's
# Fixed random words, one a band. The shingle whose hash is nearest to a word in XOR distance is the
# first of a random order; each row of a band hashes anew, so a band's rows don't depend on each other.
PROBES = [random.Random(20240229 + b).getrandbits(64) - (1 << 63) for b in range(BANDS)]


def _units(text: Column) -> Column:
    """Two bytes for every character (UTF-16 unit), so that a shingle is cut out in constant time."""
    return F.encode(text, "UTF-16BE")


def _count(units: Column) -> Column:
    return F.greatest(F.length(units) / 2 - (SIZE - 1), F.lit(1)).cast("int")


def _shingle(units: Column, byte: Column) -> Column:
    return F.xxhash64(F.substring(units, byte, F.lit(2 * SIZE)))


def _shingles(line: Column) -> Column:
    """The set of a line. The bytes are a variable of the outer function: reading a column would copy them for every shingle."""
    cut = lambda u: F.transform(F.sequence(F.lit(1), 2 * _count(u) - 1, F.lit(2)), lambda byte: _shingle(u, byte))
    return F.array_distinct(F.flatten(F.transform(F.array(_units(line)), cut)))


def _compare(pairs: DataFrame) -> DataFrame:
    sets = pairs.select("a", "b", _shingles(F.col("a_body")).alias("x"), _shingles(F.col("b_body")).alias("y"))
    common, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return sets.select("a", "b", common.cast("long").alias("common"), both.cast("long").alias("both"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h1, h2) of every line that isn't blank, trimmed."""
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "raw")
    out = docs.where("doc_id is not null").select("doc_id", line).select("doc_id", "line_no", F.btrim("raw", F.lit(" \t\r")).alias("line"))
    return out.where("line <> ''").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def _signatures(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2, bands) per line, from the minima of all its shingles.

    Shingles are cut and hashed STEP a row, in generated code; the last row of a line may take its last one again.
    One that a line repeats changes no minimum, so none is looked for.
    """
    line = ("doc_id", "line_no", "h1", "h2")
    units = lines.select(*line, _units(F.col("line")).alias("units"))
    each = units.select(*line, "units", F.explode(F.sequence(F.lit(1), _count(F.col("units")), F.lit(STEP))).alias("i"))
    at = [F.least(F.col("i") + j, _count(F.col("units"))) for j in range(STEP)]
    each = each.select(*line, *(_shingle(F.col("units"), 2 * i - 1).alias(f"g{j}") for j, i in enumerate(at)))
    each = each.select(*line, *(F.xxhash64(f"g{j}", F.lit(k)).alias(f"r{k}_{j}") for k in range(ROWS) for j in range(STEP)))
    least = lambda k, p: F.least(*(F.col(f"r{k}_{j}").bitwiseXOR(F.lit(p)) for j in range(STEP)))
    low = [F.min(least(k, p)).alias(f"m{b}_{k}") for b, p in enumerate(PROBES) for k in range(ROWS)]
    signed = each.groupBy(*line).agg(*low)
    keys = [F.xxhash64(F.lit(b), *(f"m{b}_{k}" for k in range(ROWS))) for b in range(BANDS)]
    return signed.select(*line, F.array(*keys).alias("bands"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, drop) for documents that lose lines; drop holds the line numbers, from 0.

    Lines are split at line feeds and trimmed; two lines are linked if the sets
    of their 8-character shingles have a Jaccard similarity of num/den or more (a
    shorter line is one shingle). Of each component the first line by (doc_id,
    line number) stays. Equal lines are one node. Blank lines are neither
    compared nor dropped. Rows that share an id are one document, so a line dropped from
    one is dropped from all; a null id or text takes no part.

    Candidates share one of 12 bands of 3 minima, which two lines at similarity 0.8 miss
    with a probability of 0.0002 and at 0.9 below 1e-5, or the smallest line of such bands. Minima and
    verification are on the full sets. Lines whose first hash
    meets another text's are left alone (their second hash tells).
    """
    ws = ws or Workspace(docs.sparkSession, "lines")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # dealt out by document first, so that the minima of a line need no exchange of their own
    table = ws.store(_signatures(_lines(docs.repartition("doc_id"))), "lines")
    at = ws.store(table.select("doc_id", "line_no", "h1", "h2"), "at")
    nodes = at.groupBy("h1").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.min("h2").alias("low"), F.max("h2").alias("high"))
    nodes = ws.store(nodes.where("low = high").select("h1", "first.doc_id", "first.line_no"), "nodes")

    def fetch(ids: DataFrame) -> DataFrame:
        ws.drop("lines")  # all buckets are stored by now
        where = nodes.join(ids, nodes["h1"] == ids["id"], "left_semi")
        where = where.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "line_no")).alias("wanted"))
        found = docs.join(where.hint("shuffle_hash"), "doc_id").select("wanted", F.explode(F.array(F.split("text", "\n"))).alias("raw"))
        found = found.select(F.explode(F.transform("wanted", lambda w: F.struct(w["h1"], F.get("raw", w["line_no"]).alias("line")))).alias("w"))
        found = found.select(F.col("w.h1").alias("id"), F.btrim("w.line", F.lit(" \t\r")).alias("body"))
        return found.where(F.xxhash64("body") == F.col("id"))

    # a few bands at a time: their keys are what is shuffled most
    some = [F.slice("bands", b + 1, GROUP) for b in range(0, BANDS, GROUP)]
    buckets = [table.select(F.explode(bands).alias("key"), F.col("h1").alias("id")) for bands in some]
    linked = link(buckets, fetch, _compare, ws, num, den, sets=_shingles)
    at = at.distinct().join(nodes.select("h1"), "h1", "left_semi")
    at = at.join(linked.withColumnRenamed("id", "h1"), "h1", "left").select("doc_id", "line_no", F.coalesce("component", "h1").alias("component"))
    at = ws.store(at, "placed")
    ws.drop("at", "nodes")
    groups = at.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = at.join(groups.select("component", "first"), "component").where(F.struct("doc_id", "line_no") > F.col("first"))
    out = ws.store(late.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("drop")), "drop")
    ws.drop("placed")
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the lines named by ``duplicate_lines`` taken out of the text, and n_lines, n_dropped.

    All columns stay as they are otherwise (columns named n_lines or n_dropped are
    replaced). A null text stays null with 0 lines; a text all of whose lines go becomes empty.
    """
    ws = Workspace(docs.sparkSession, "lines")
    drop = duplicate_lines(docs, id_col, text_col, num, den, ws).select(F.col("doc_id").alias("__id"), F.col("drop").alias("__drop"))
    docs = docs.drop("n_lines", "n_dropped")
    out = docs.join(drop, docs[id_col].cast("long") == drop["__id"], "left")
    # split once: what follows reads the lines by their number
    out, lines = out.withColumn("__lines", F.explode(F.array(F.split(text_col, "\n")))), F.col("__lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")}
    return out.withColumns(counts | {text_col: text}).drop("__id", "__drop", "__lines")
