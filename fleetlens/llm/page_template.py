"""Main text of pages by equivalence-class template deduction over the pages of a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.page_blocks import Block, read
from fleetlens.llm.text_hash import mix
from fleetlens.llm.workspace import Workspace

PAGES = 8  # a class of tokens counts if so many pages hold it
SHARE = 0.2  # of a host's main text at most; where more of it is the same on all pages, these are copies and nothing is taken out
BOX = 0.8  # of a host's text outside the zones lies in the box taken for the main part, where pages mark none
SALT = 2_000  # pages of a host that meet its template in one task
LARGE = 10_000  # hosts of several parts, (name, number), that are broadcast at most
PAGE, TAG, TEXT, MASS = range(4)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: the pages that hold it, its times, its vector's fingerprint, its place and characters.

    A token's occurrence vector is its count on each page. The fingerprint is the sum of the counts, each times a
    random number of the page; two of them, as 31-bit numbers, so that equal sums mean equal vectors.
    """
    task, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        hosts, owner, tokens, kinds, places, sizes, salts = [], [], [], [], [], [], []
        number: dict[str, int] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = read(source)
            if host not in number:
                number[host] = len(hosts)
                hosts.append(host)
            marked = any(b.main for b in page.blocks)
            size = sum(len(b.text) for b in page.blocks if b.main == 2 or not marked)
            rows = [(0, PAGE, 0, size)] + [(t, TAG, p, 0) for t, p in page.opened] + [(b.token, TEXT, b.place, len(b.text)) for b in page.blocks]
            if not marked:
                for b in page.blocks:
                    rows += [(path, MASS, k, len(b.text) - b.links) for k, path in enumerate(b.box)]
            salt = xxhash.xxh64_intdigest(f"{task} {seen}")
            seen += 1
            for token, kind, place, size in rows:
                tokens.append(token)
                kinds.append(kind)
                places.append(place)
                sizes.append(size)
            owner += [number[host]] * len(rows)
            salts += [salt] * len(rows)
        if not tokens:
            continue
        host, token, kind, place, size = (np.array(x, np.int64) for x in (owner, tokens, kinds, places, sizes))
        salt = np.array(salts, np.uint64)
        order = np.lexsort((salt, token, kind, host))
        host, token, kind, place, size, salt = (x[order] for x in (host, token, kind, place, size, salt))
        new = np.concatenate([[True], (host[1:] != host[:-1]) | (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])])
        page_new = new | np.concatenate([[True], salt[1:] != salt[:-1]])
        start = np.flatnonzero(new)
        one, two = (mix(salt) >> np.uint64(33)).astype(np.int64), (mix(salt + np.uint64(1)) >> np.uint64(33)).astype(np.int64)
        sums = [np.add.reduceat(x, start) for x in (page_new.astype(np.int64), np.ones(len(token), np.int64), one, two, place, size)]
        columns = [pa.array([hosts[k] for k in host[start]], pa.string()), *(pa.array(x, pa.int64()) for x in (token[start], kind[start], *sums))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "token", "kind", "pages", "times", "one", "two", "place", "size"])


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and class of a batch: whether its tokens come in order on every page, and the least and greatest gap of the outermost class it lies in."""
    for batch in batches:
        seen: dict[tuple, tuple] = {}
        for host, source, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = read(source)
            places: dict[int, int] = {}
            for token, place in [*page.opened, *((b.token, b.place) for b in page.blocks)]:
                places.setdefault(token, place)
            outer = [places[t] for t in classes[0]["tokens"] if t in places]
            for c in classes:
                at = [places[t] for t in c["tokens"] if t in places]
                if not at:
                    continue
                ordered = len(at) == len(c["tokens"]) and all(x < y for x, y in zip(at, at[1:]))
                low, high = (int(np.searchsorted(outer, x, "right")) for x in (at[0], at[-1]))
                nested = c is classes[0] or low == high
                ok, least, most = seen.get((host, c["class"]), (True, low, low))
                seen[host, c["class"]] = ok and ordered and nested, min(least, low), max(most, low)
        rows = [(h, c, *x) for (h, c), x in seen.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "class", "ordered", "least", "most"])


def _main_blocks(blocks: list[Block], template: set[int], box: int | None) -> list[Block]:
    top = max((b.main for b in blocks), default=0)
    if top:
        blocks = [b for b in blocks if b.main == top]
    elif box is not None:
        inside = [b for b in blocks if box in b.box]
        blocks = [b for b in inside or blocks if 2 * b.links <= len(b.text)]
    return [b for b in blocks if b.token not in template]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        known: dict[str, set] = {}
        for source, host, template, box in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
            if template and host not in known:
                known[host] = set(template)
            out.append("\n".join(b.text for b in _main_blocks(read(source).blocks, known.get(host, set()), box)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _with_host(pages: DataFrame, hosts: DataFrame, tokens: DataFrame, how: str) -> DataFrame:
    """``pages`` with the columns of their host in ``hosts``. The pages of a large host are dealt out in parts, each of which meets a copy of the host's row."""
    parts = tokens.where(F.col("kind") == PAGE).select("host", F.ceil(F.col("pages") / SALT).cast("int").alias("parts"))
    large = parts.where("parts > 1").withColumnRenamed("parts", "m")
    large = F.broadcast(large) if large.limit(LARGE + 1).count() <= LARGE else large
    pages = pages.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("m", F.lit(1))).cast("int")).drop("m")
    copies = hosts.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return pages.join(copies, ["host", "part"], how).drop("part")


def deduce(pages: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(tokens, templates): what ``_tokens`` sums up over all pages, and (host, template, box) of hosts that have either.

    Tokens that have equal occurrence vectors are a class. A class counts if 8 pages hold it, once each, and it has two tokens, a
    tag among them; that with the most tokens on the most pages is the host's outermost. Classes whose tokens change
    their order on any page, or don't lie in one and the same gap of the outermost class on all pages, are not part of the template.
    """
    keys = ["host", "token", "kind"]
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "one", "two", "place", "size")]
    held = pages.select("host", "html").mapInArrow(_tokens, "host string, token long, kind long, pages long, times long, one long, two long, place long, size long")
    held = held.groupBy(*keys).agg(*sums).where(F.col("kind").isin(PAGE, MASS) | (F.col("pages") >= PAGES))
    tokens = ws.store(held, "tokens")
    member = tokens.where(F.col("kind").isin(TAG, TEXT) & (F.col("pages") == F.col("times")))
    vector = F.xxhash64("pages", "one", "two").alias("class")
    member = member.select("host", vector, "pages", "token", "kind", "size", (F.col("place") / F.col("pages")).alias("place"))
    row = F.sort_array(F.collect_list(F.struct("place", "token", "kind")))
    classes = member.groupBy("host", "class", "pages").agg(row.alias("row"), F.count_if(F.col("kind") == TAG).alias("tags"), F.sum(F.when(F.col("kind") == TEXT, F.col("size") / F.col("pages")).otherwise(0)).alias("chars"))
    classes = ws.store(classes.where((F.col("tags") > 0) & (F.size("row") > 1)), "classes")
    # only hosts with text in a class need a second look
    worth = classes.groupBy("host").agg(F.max(F.size("row") > F.col("tags")).alias("texts")).where("texts").select("host")
    listed = classes.join(worth, "host", "left_semi").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct((F.col("pages") * F.size("row")).alias("mass"), F.col("class"), F.col("row.token").alias("tokens"))), asc=False).alias("classes")
    )
    listed = ws.store(listed.select("host", F.expr("transform(classes, c -> struct(c.class as class, c.tokens as tokens))").alias("classes")), "listed")
    ruled = _with_host(pages.select("host", "html"), listed, tokens, "inner").select("host", "html", "classes")
    ruled = ruled.mapInArrow(_order, "host string, class long, ordered boolean, least long, most long")
    ruled = ruled.groupBy("host", "class").agg(F.min("ordered").alias("ordered"), F.min("least").alias("least"), F.max("most").alias("most"))
    valid = ruled.where("ordered and least = most").select("host", "class")
    whole = tokens.where(F.col("kind") == PAGE).select("host", (F.col("size") / F.col("pages")).alias("usual"))
    text = classes.join(valid, ["host", "class"]).select("host", F.explode("row").alias("t")).where(F.col("t.kind") == TEXT).select("host", F.col("t.token").alias("token"))
    text = text.join(tokens.where(F.col("kind") == TEXT).select("host", "token", (F.col("size") / F.col("pages")).alias("chars")), ["host", "token"])
    fixed = text.groupBy("host").agg(F.collect_list("token").alias("template"), F.sum("chars").alias("chars"))
    fixed = fixed.join(whole, "host").where(F.col("chars") <= SHARE * F.col("usual")).select("host", "template")
    mass = tokens.where(F.col("kind") == MASS).select("host", "token", "size", (F.col("place") / F.col("times")).alias("depth"))
    most = mass.groupBy("host").agg(F.max("size").alias("all"))
    box = mass.join(most, "host").where(F.col("size") >= BOX * F.col("all")).groupBy("host").agg(F.max(F.struct("depth", "size", "token")).alias("b")).select("host", F.col("b.token").alias("box"))
    return tokens, ws.store(fixed.join(box, "host", "full"), "templates")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; text is the main text, its blocks joined by line feeds.

    The template of a host is deduced from all its pages (see ``deduce``); what it doesn't fix are slots. The main text
    is what fills the slots of the article (else of the main part, else of the deepest box that holds four fifths of the
    host's unlinked text), without the zones that tags, roles and names mark as something else (menus, headers,
    footers, sidebars, notices, adverts, forms, comments). A block is taken whole or not at all: one whose text is a token of the
    template is fixed on all pages that have its surroundings and is left out.

    A null or empty page has an empty text, and so has a page without main text. A null id or url stays null, and pages
    without a host are taken for one host. Repeated rows keep a row each and count as
    a page each. Other columns are neither read nor returned.
    """
    ws = Workspace(pages.sparkSession, "pages")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    tokens, templates = deduce(rows, ws)
    rows = _with_host(rows, templates, tokens, "left").select("page_id", "url", "html", "host", "template", "box")
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
