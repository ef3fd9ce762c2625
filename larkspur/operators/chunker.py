"""Sections, overlapping chunks and duplicate chunks of documents.

The greedy folds (packing, hard splits, sections) depend on what came before inside one document, so they run as one
Arrow function per document; everything else is columns. A document is one row: no key, however frequent, gathers
rows of several documents in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.session import cut

MAX_CHARS = 1000
OVERLAP = 250
NEAR = 0.85
#: Chunks of one section that are folded in one row.
BLOCK = 256

_BLANK_LINE = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HEADINGS = tuple(re.compile(p.replace(r"\p{L}", "a-zA-Z")) for p in T.HEADINGS)
_COMPLETE = re.compile(r'[.!?]"?$|\)$')


def limits(max_chars: int, overlap: int) -> tuple[int, int]:
    """Checked limits: a piece must hold something, and the overlap must leave room for new text."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    overlap = max(0, overlap)
    return max_chars, overlap if overlap < max_chars else max_chars // 10


def normal(text: str | None) -> str:
    """The same as functions.text.normalize, for use inside a fold."""
    joined = re.sub(r"-\n(\w+)", r"\1", text or "")
    return re.sub(r"[ \t]+", " ", joined.replace("\r", "\n")).strip()


def hard_split(text: str, max_chars: int, overlap: int) -> list[str]:
    """Windows of at most max_chars, cut at the last blank, each starting ``overlap`` before the cut."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + max_chars, n)
        if end < n:
            space = text.rfind(" ", start, end)
            end = space if space > start else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end == n:
            break
        start = max(end - overlap, start + 1)
    return out


def pack(parts: list[str], joint: str, max_chars: int, oversized) -> list[str]:
    """Greedy packing of parts; a part beyond the limit closes the current piece and is split on its own."""
    out, current = [], None
    for part in parts:
        whole = part if current is None else f"{current}{joint}{part}"
        if len(whole) <= max_chars:
            current = whole
            continue
        if current is not None:
            out.append(current)
        current = part if len(part) <= max_chars else None
        if current is None:
            out += oversized(part)
    return out if current is None else [*out, current]


def tail(text: str, overlap: int) -> str:
    if len(text) <= overlap:
        return text
    end = text[-overlap:]
    space = end.find(" ")
    return (end[space + 1 :] if space > 0 else end).strip()


def windowed(text: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a text: paragraphs packed up to the limit, long ones by sentences, long sentences by windows; each chunk
    then begins with the tail of the one before, where that fits."""
    max_chars, overlap = limits(max_chars, overlap)
    if not text:
        return []
    blocks = [p for p in (x.strip() for x in _BLANK_LINE.split(text)) if p] or [text]

    def long_sentence(s: str) -> list[str]:
        return hard_split(s, max_chars, overlap)

    def long_paragraph(p: str) -> list[str]:
        found = [s for s in (x.strip() for x in _SENTENCE.split(p)) if s]
        return pack(found, " ", max_chars, long_sentence) if found else long_sentence(p)

    chunks = [c.strip() for c in pack([p for p in map(normal, blocks) if p], "\n\n", max_chars, long_paragraph)]
    if overlap <= 0:
        return chunks
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:]):
        start = tail(before, overlap)
        joined = f"{start}\n\n{chunk}" if start else chunk
        out.append(joined if len(joined) <= max_chars else chunk)
    return out


def sections(elements: list[dict]) -> list[dict]:
    """Sections of one document's elements (text, element_type, heading_level, page) in order.

    A heading closes the section before; a heading that no body follows is replaced by the next one, while its page
    stays with the section that comes. Lines go on with the paragraph before unless that ends like a sentence.
    """
    out: list[dict] = []
    heading = subheading = None
    body: list[str] = []
    pages: set[int] = set()

    def close() -> bool:
        nonlocal body, pages, subheading
        if not "\n\n".join(body).strip():
            return False
        out.append({"heading": heading, "subheading": subheading, "body": "\n\n".join(body).strip(), "pages": sorted(pages)})
        body, pages, subheading = [], set(), None
        return True

    for e in elements:
        line = normal(e.get("text"))
        if not line:
            continue
        kind, level, page = e.get("element_type") or "paragraph", e.get("heading_level"), e.get("page")
        top = kind == "heading" or level == 1
        sub = not top and (kind == "subheading" or level == 2)
        if top or sub or any(p.search(line) for p in _HEADINGS):
            close()
            if sub:
                subheading = line
            else:
                heading = line
        elif body and not _COMPLETE.search(body[-1].strip()):
            body[-1] += " " + line
        else:
            body.append(line)
        if page is not None:
            pages.add(page)
    close()
    return out


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in the session's number of partitions. The folds behind cost far more than their bytes tell, so the
    number is given: adaptive execution would merge partitions by size and leave few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


SECTION = "heading:string,subheading:string,body:string,pages:array<int>"


def build_sections(elements: DataFrame) -> DataFrame:
    """``elements``: doc_id, ord, text, element_type, heading_level, page. Returns doc_id, section_no and the section."""
    e = F.struct("ord", "text", "element_type", "heading_level", "page")
    docs = _dealt(elements, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(e)).alias("elements"))

    @F.pandas_udf(f"array<struct<{SECTION}>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: sections([dict(r) if isinstance(r, dict) else r.asDict() for r in rows]))

    return docs.select("doc_id", F.posexplode(run("elements")).alias("section_no", "s")).select("doc_id", "section_no", "s.*")


def _windows(max_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [[c for c in windowed(t, max_chars, overlap) if c.strip()] for t in b["text"].to_pylist()]
            at = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b[n].take(at) for n in names), pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string())], [*names, "piece_no", "content"])

    return run


def split_chunks(rows: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of the column ``text`` of every row, with the other columns, piece_no and content."""
    limits(max_chars, overlap)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_windows(max_chars, overlap), f"{kept}, piece_no int, content string")


def create_chunks(parts: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``parts``: doc_id, section_no, heading, subheading, body, pages. Returns chunks with ``ord`` and a stable chunk_id."""
    text = F.concat_ws("\n\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("heading", "subheading", "body")))
    cut = split_chunks(parts.select("doc_id", "section_no", "heading", "subheading", "pages", text.alias("text")), max_chars, overlap)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "piece_no")) - 1
    return cut.withColumn("ord", number).withColumn("char_count", F.length("content")).withColumn("chunk_id", F.sha1(F.concat_ws("|", "doc_id", F.col("ord").cast("string"))))


def exact_first(rows: DataFrame, scope: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal normalised keys in a scope, the first in order. The window keeps one row a group and task."""
    named = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *(T.dedup_key(k).alias(n) for k, n in zip(keys, named)))
    place = F.row_number().over(Window.partitionBy(*scope, *named).orderBy(*order))
    return keyed.withColumn("_place", place).where("_place = 1").drop("_place", *named)


class Known:
    """A kept chunk with what comparisons with it share: how often its characters occur, and where."""

    def __init__(self, text: str):
        self.text, self.often = text, Counter(text)
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def common_length(self, other: str) -> int:
        """Length of the longest common subsequence, bit-parallel: one addition of long integers per character."""
        full = state = (1 << len(self.text)) - 1
        get = self.places.get
        for c in other:
            hit = state & get(c, 0)
            state = (state + hit | state - hit) & full
        return len(self.text) - state.bit_count()


def is_near(new: str, kept: Known, often: Counter | None = None, least: float = NEAR) -> bool:
    """Similarity of two normalised chunks of at least ``least``.

    Upper bounds come first: lengths, equal characters, and the longest common subsequence, of which the blocks that the
    ratio counts are a part.
    """
    both = len(new) + len(kept.text)
    if not new or not kept.text or 2 * min(len(new), len(kept.text)) < least * both:
        return False
    if new == kept.text:
        return True
    needed = least * both / 2 - 1e-9
    if ((often or Counter(new)) & kept.often).total() < needed:
        return False
    return kept.common_length(new) >= needed and SequenceMatcher(None, new, kept.text).ratio() >= least


def _fresh(least: float):
    @F.pandas_udf("array<boolean>")
    def run(groups: pd.Series) -> pd.Series:
        out = []
        for keys in groups:
            kept: list[Known] = []
            flags = []
            for c in keys:
                often = Counter(c)
                flags.append(not any(is_near(c, k, often, least) for k in kept))
                if flags[-1]:
                    kept.append(Known(c))
            out.append(flags)
        return pd.Series(out)

    return run


_GROUP = ["doc_id", "_h", "_s"]


def near_first(rows: DataFrame, order: str = "ord", least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """Greedy removal of near duplicates inside (doc_id, heading, subheading): a chunk goes if a kept one is so similar.

    ``rows``: doc_id, heading, subheading, content, ``order`` and any other columns. A group of up to ``block`` chunks is
    folded in one row, and many groups share an Arrow batch. The chunks of a larger group are compared block by block in
    as many tasks as there are pairs of blocks, and who stays is then settled on the similar pairs alone.
    """
    columns = rows.columns
    keyed = cut(rows.select("doc_id", T.dedup_key("heading").alias("_h"), T.dedup_key("subheading").alias("_s"), F.struct(F.col(order).alias("_o"), T.dedup_key("content").alias("_c"), F.struct(*columns).alias("_row")).alias("_e")))
    large = keyed.groupBy(*_GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    if large.isEmpty():
        return _folded(keyed, least)
    number = F.row_number().over(Window.partitionBy(*_GROUP).orderBy("_e._o"))
    big = cut(keyed.join(large, _GROUP).withColumn("_i", number))
    stay = big.join(_near_duplicates(big, least, block), [*_GROUP, "_i"], "left_anti").select("_e._row.*")
    return _folded(keyed.join(large, _GROUP, "left_anti"), least).union(stay)


def _folded(keyed: DataFrame, least: float) -> DataFrame:
    """The kept rows of groups of a bounded number of chunks."""
    in_order = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)
    groups = _dealt(keyed, *_GROUP).groupBy(*_GROUP).agg(F.array_sort(F.collect_list("_e"), in_order).alias("_g"))
    single = F.size("_g") == 1
    alone = groups.where(single).select(F.element_at("_g", 1)["_row"].alias("_row"))
    several = groups.where(~single).withColumn("_keep", _fresh(least)(F.transform("_g", lambda e: e["_c"])))
    kept = several.select(F.explode(F.arrays_zip("_g", "_keep")).alias("_z")).where("_z._keep").select(F.col("_z._g._row").alias("_row"))
    return alone.union(kept).select("_row.*")


def _similar(least: float, block: int):
    @F.pandas_udf("array<struct<i:int,j:int>>")
    def run(tiles: pd.Series) -> pd.Series:
        out = []
        for tile in tiles:
            chunks = sorted((int(e["i"]), e["c"]) for e in tile)
            of = lambda i: (i - 1) // block
            split = of(chunks[0][0]) != of(chunks[-1][0])  # two blocks: only pairs across are wanted
            known, found = [], []
            for j, c in chunks:
                often = Counter(c)
                found += [{"i": i, "j": j} for i, k in known if not (split and of(i) == of(j)) and is_near(c, k, often, least)]
                known.append((j, Known(c)))
            out.append(found)
        return pd.Series(out)

    return run


def _near_duplicates(big: DataFrame, least: float, block: int) -> DataFrame:
    """The numbers _i of the chunks of large groups (``_GROUP``, _n, _i, _e) that a kept earlier one is so similar to."""
    own, last = F.floor((F.col("_i") - 1) / block).cast("int"), F.floor((F.col("_n") - 1) / block).cast("int")
    meets = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("z")))
    tiles = big.select(*_GROUP, F.struct(F.col("_i").alias("i"), F.col("_e._c").alias("c")).alias("e"), F.explode(meets).alias("m")).repartition(*_GROUP, "m").groupBy(*_GROUP, "m").agg(F.collect_list("e").alias("tile"))
    open_ = cut(tiles.select(*_GROUP, F.explode(_similar(least, block)("tile")).alias("p")).select(*_GROUP, "p.i", "p.j").distinct())
    at = lambda c: open_.select(*_GROUP, F.col(c).alias("_i")).distinct()
    gone = at("j").limit(0)
    while not open_.isEmpty():
        # A chunk without a similar one before it stays, and what is similar to it goes; the rest is settled in later rounds.
        stays = at("i").join(at("j"), [*_GROUP, "_i"], "left_anti")
        goes = cut(open_.join(stays.withColumnRenamed("_i", "i"), [*_GROUP, "i"], "left_semi").select(*_GROUP, F.col("j").alias("_i")).distinct())
        gone = gone.union(goes)
        for c in ("i", "j"):
            open_ = open_.join(goes.withColumnRenamed("_i", c), [*_GROUP, c], "left_anti")
        open_ = cut(open_)
    return gone


def standard_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk messages without layout columns: ids filled in, types cleaned, content stripped and hashed."""
    chunk_id = F.coalesce("chunk_id", F.concat(F.col("doc_id"), F.lit("_c"), F.col("ord").cast("string")))
    kind = F.regexp_replace(F.lower("file_type"), r"\.", "")
    return chunks.select(chunk_id.alias("chunk_id"), "doc_id", "file_name", kind.alias("file_type"), "allowed_role", T.strip("content").alias("content"), T.content_hash("content").alias("content_hash"))


def fixed_windows(rows: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Plain windows of ``size`` characters with a fixed stride: doc_id, piece_no, content. Columns only."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1 - overlap), F.lit(stride))
    cut = rows.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("piece_no", "start"))
    return cut.select("doc_id", "piece_no", F.substr("text", F.col("start") + 1, F.lit(size)).alias("content"))
