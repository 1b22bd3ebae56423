"""Documents, chunks with exact offsets, sections and passage ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headings import section_at, sections
from ..functions.text import missing, strip, tokenize, words
from ..session import cut_lineage

# Chunking and ranking.
CHUNK_CHARS = 4000
CHUNK_OVERLAP = 500
CHUNK_LOOKBACK = 100
TOP_CHUNKS = 50
MIN_SCORE = 0.05
K1, B, IDF_FLOOR_SHARE = 1.5, 0.75, 0.25
# Text choice.
MIN_FULL_TEXT = 5000
MIN_ABSTRACT = 150

CHUNK_TYPE = "array<struct<chunk_index:int,start:int,end:int,chunk:string>>"


def _spans(body: str, size: int, overlap: int, cut) -> Iterator[tuple[int, int]]:
    """Offsets of chunks of at most `size`; `cut` shortens a chunk, given its offsets."""
    start = end = 0
    while end < len(body):
        end = min(start + size, len(body))
        if end < len(body):
            end = cut(body, start, end)
        yield start, end
        start = max(end - overlap, start + 1)


def _after_last_mark(body: str, start: int, end: int) -> int:
    """Just behind the last sentence or line end near the end of a chunk."""
    found = max(body.rfind(c, end - CHUNK_LOOKBACK, end) for c in ".!?\n")
    return found + 1 if found >= 0 else end


#: A paragraph end, or else a sentence end, as far on as possible.
_BREAK = re.compile(r"(?s).*\n(?=\n)|.*(?:[.?!] |\.\n)")


def _in_last_fifth(body: str, start: int, end: int) -> int:
    """Behind the last paragraph end in the last fifth of a chunk, else behind its last sentence end."""
    found = _BREAK.match(body, start + int(0.8 * (end - start)), end)
    return found.end() if found and len(found.group(0)) > 1 else end


#: Bytes of texts that a task holds as Python strings at a time, or one text.
CUT_BYTES = 1_000_000


def _cutter(pieces):
    """Column function for the chunks of a text, from its `pieces` (start, end, chunk).

    An Arrow batch is cut in slices of CUT_BYTES, so the memory of a task does not follow the rows of a batch.
    """
    @F.arrow_udf(CHUNK_TYPE)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(batch):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT_BYTES, "right")))
                rows = [list(pieces(b)) if b else [] for b in batch.slice(at, stop - at).to_pylist()]
                starts, lasts, chunks = zip(*(p for row in rows for p in row), strict=True) if any(rows) else ((), (), ())
                yield pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array([i for row in rows for i in range(len(row))], pa.int32()), pa.array(starts, pa.int32()),
                                                pa.array(lasts, pa.int32()), pa.array(chunks, pa.string())], ["chunk_index", "start", "end", "chunk"]))
                at = stop

    return cut


def chunks_of(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping chunks of a text, as an array, that end at a sentence or line end where one is near.

    Each start depends on the chunk before it, so one text is walked in order;
    texts are independent of each other.
    """
    if size <= overlap + CHUNK_LOOKBACK:
        raise ValueError("chunk size must exceed the overlap by more than the look-back")
    return _cutter(lambda b: ((s, e, b[s:e]) for s, e in _spans(b, size, overlap, _after_last_mark)))(text)


def chunk_offsets(docs: DataFrame, text: str = "text", size: int = CHUNK_CHARS,
                  overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Overlapping chunks of each text, one per row."""
    return (docs.select(*keep, F.length(text).alias("_n"), F.explode(chunks_of(F.col(text), size, overlap)).alias("c"))
            .select(*keep, "c.chunk_index", "c.start", "c.end", "c.chunk",
                    (F.col("c.start") / F.greatest("_n", F.lit(1))).alias("position_ratio")))


def chunk_sequential(docs: DataFrame, text: str = "text", size: int = 12000, overlap: int = 600,
                     max_chunks: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reading chunks without blanks around them; a text of one chunk stays as it is.

    A chunk ends at a paragraph end, else at a sentence end, in its last fifth.
    With `max_chunks` only the first chunks of a text are returned.
    """
    if size < 1000 or not 0 <= overlap < size:
        raise ValueError("chunks need 1000 characters or more, and an overlap below their size")

    def pieces(b):
        if len(b) <= size:
            return [(0, len(b), b)]
        kept = ((s, e, b[s:e].strip()) for s, e in _spans(b, size, overlap, _in_last_fifth))
        return islice((k for k in kept if k[2]), max_chunks)

    return docs.select(*keep, F.explode(_cutter(pieces)(F.col(text))).alias("c")).select(
        *keep, "c.chunk_index", "c.start", "c.end", "c.chunk")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Identity, size and hash of each text."""
    return docs.select("doc_id", F.col("source").alias("name"), F.length("text").alias("char_count"),
                       F.size(words("text")).alias("word_count"), F.md5("text").alias("file_hash"))


def document_listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return scan_documents(docs).join(n, "doc_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")))


def source_text_choice(papers: DataFrame, mode: str, limit: int | None = None) -> DataFrame:
    """Which text of a paper quotations are checked against, if any; its first `limit` characters (None: all).

    `omitted_chars` tells how many were left out.
    """
    full = F.col("full_text_available") & ~missing("full_text_content")
    size = F.length("full_text_content")
    indirect = F.lit(mode == "tangential")
    abstract = F.length("abstract") >= MIN_ABSTRACT
    kind = (F.when(full & (size >= MIN_FULL_TEXT), F.lit("FULL TEXT"))
            .when(full & indirect, F.lit("SHORT FULL TEXT"))
            .when(indirect & abstract, F.lit("ABSTRACT ONLY (tangential mode)")))
    action = F.when(F.col("text_type").isNotNull(), F.lit("extract")).otherwise(
        F.lit("drop" if mode == "main" else "keep_unquoted"))
    return papers.withColumn("text_type", kind).withColumn(
        "text", F.when(F.col("text_type").endswith("FULL TEXT"), _first("full_text_content", limit))
        .when(F.col("text_type").isNotNull(), F.col("abstract"))).withColumn(
        "omitted_chars", F.when(F.col("text_type").endswith("FULL TEXT"), size - F.length("text")).otherwise(F.lit(0))).withColumn(
        "action", action)


def _first(text: str, limit: int | None) -> Column:
    return F.col(text) if limit is None else F.substring(text, 1, limit)


def quick_read_text(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """The abstract, else the first `limit` characters of the full text (None: all)."""
    full = F.col("full_text_available") & ~missing("full_text_content")
    return papers.withColumn("read_text", F.when(~missing("abstract"), F.col("abstract")).when(
        full, _first("full_text_content", limit)))


def with_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("section_map", sections(text))


def section_regions(docs: DataFrame) -> DataFrame:
    """One row per heading with its region. The outer form keeps the optimizer
    from testing the map's size first, which would build the map again."""
    return docs.select("doc_id", F.posexplode_outer("section_map").alias("n", "s")).where("s is not null").select(
        "doc_id", "n", "s.start", "s.end", "s.category", "s.heading",
        (F.col("s.end") - F.col("s.start")).alias("region_chars"))


def section_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Headings per category, size of the leading block, evidence flag."""
    m = F.col("section_map")

    def count(category: str) -> Column:
        return F.size(F.filter(m, lambda s: s["category"] == category)).alias(f"n_{category.lower()}")

    return docs.select(
        "doc_id", *[count(c) for c in ("EVIDENCE", "ABSTRACT", "METHODS", "EXCLUDE", "REFS")],
        F.coalesce(F.get(m, F.lit(0))["start"], F.length(text)).alias("leading_chars"),
        F.exists(m, lambda s: s["category"].isin("EVIDENCE", "ABSTRACT")).alias("has_evidence"))


def position_to_section(positions: DataFrame, docs: DataFrame) -> DataFrame:
    """Section of each (doc_id, position): an equi-join on the document, then a
    look-up in its section map."""
    return positions.join(docs.select("doc_id", "section_map"), "doc_id").withColumn(
        "_s", section_at("section_map", "position")).select(
            *positions.columns, F.col("_s.category").alias("category"), F.col("_s.heading").alias("heading"))


def span_in_chunk(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that hold a span, with the text of the span cut from the chunk."""
    c = chunks.select("doc_id", "chunk_index", F.col("start").alias("c_start"), F.col("end").alias("c_end"), "chunk")
    return spans.join(c, "doc_id").where(
        (F.col("c_start") <= F.col("start")) & (F.col("end") <= F.col("c_end"))).withColumn(
            "span_text", F.substring("chunk", F.col("start") - F.col("c_start") + 1, F.col("end") - F.col("start"))
        ).drop("c_start", "c_end", "chunk")


def _okapi(tf: Column, dl: Column, avgdl: Column, idf: Column, qtf: Column) -> Column:
    return qtf * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _raw_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


#: Tokens that one task counts; the number of tasks follows from it.
TASK_TOKENS = 500_000


def _tokens(chunks: DataFrame) -> DataFrame:
    """Tokens of each chunk with their number, written once: cutting and tokenising cost most and several steps read them."""
    return cut_lineage(chunks.select("doc_id", "chunk_index", tokenize("chunk").alias("t")).withColumn("dl", F.size("t")), "tokens")


def _dealt(sized: DataFrame, *keys: str) -> DataFrame:
    """Chunks by key in as many tasks as their tokens need, so the memory of a task does not grow with the input."""
    total = sized.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    return sized.repartition(max(sized.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_TOKENS)), *keys)


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Frequency of each token in each chunk with the figures ranking needs.

    Each document is its own collection. All figures are windows inside a
    document, so the tokens move once and nothing is computed twice.
    """
    doc = Window.partitionBy("doc_id")
    sized = _dealt(_tokens(chunks), "doc_id").withColumn(
        "n_chunks", F.count(F.lit(1)).over(doc)).withColumn("avgdl", F.avg("dl").over(doc))
    keys = ["doc_id", "chunk_index", "dl", "n_chunks", "avgdl"]
    tf = sized.select(*keys, F.explode("t").alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "token")))
    raw = _raw_idf(F.col("n_chunks"), F.col("df"))
    # Mean weight of the distinct tokens: each row stands for 1/df of its token.
    mean = F.sum(raw / F.col("df")).over(doc) / F.sum(1 / F.col("df")).over(doc)
    # Tokens of more than half of the chunks get a share of the mean weight.
    return tf.withColumn("_raw", raw).withColumn("_floor", mean * IDF_FLOOR_SHARE).withColumn(
        "idf", F.when(F.col("_raw") < 0, F.col("_floor")).otherwise(F.col("_raw"))).drop("_raw", "_floor")


def _top(scored: DataFrame, top: int | None, min_score: float) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id", "chunk_index")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).where(F.col("score") >= min_score)


def _asked(queries: DataFrame, *scope: str) -> DataFrame:
    return queries.select("query_id", *scope, F.explode("terms").alias("token")).groupBy(
        "query_id", *scope, "token").agg(F.count(F.lit(1)).alias("qtf"))


def rank_passages(queries: DataFrame, chunks: DataFrame, top: int | None = TOP_CHUNKS,
                  min_score: float = MIN_SCORE) -> DataFrame:
    """Best chunks of each query within its own document (None: all), by BM25. Chunks
    below the least score are dropped after ranking, not before.

    `queries` has query_id, doc_id and `terms`; a repeated term counts each time.
    """
    wanted = chunks.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    weight = _okapi(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), F.col("qtf"))
    figures = term_statistics(wanted).select("doc_id", "token", "chunk_index", "tf", "dl", "avgdl", "idf")
    scored = _asked(queries, "doc_id").join(figures, ["doc_id", "token"]).groupBy(
        "query_id", "doc_id", "chunk_index").agg(F.sum(weight).alias("score"))
    return _top(scored, top, min_score)


def rank_corpus(queries: DataFrame, chunks: DataFrame, top: int = TOP_CHUNKS,
                min_score: float = MIN_SCORE) -> DataFrame:
    """Best chunks of each query among all documents.

    Document frequencies come from the distinct tokens of each chunk, counted
    before the shuffle; only tokens some query asks for are scored.
    """
    sized = _tokens(chunks)
    n_chunks = sized.agg(F.count(F.lit(1))).scalar()
    avgdl = sized.agg(F.avg("dl")).scalar()
    df = sized.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = df.withColumn("raw", _raw_idf(n_chunks, F.col("df")))
    floor = df.agg(F.avg("raw") * IDF_FLOOR_SHARE).scalar()
    asked = _asked(queries)
    weights = df.join(asked.select("token").distinct(), "token", "left_semi").select(
        "token", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    tf = _dealt(sized, "doc_id", "chunk_index").select("doc_id", "chunk_index", "dl", F.explode("t").alias("token")).join(
        weights, "token").groupBy("doc_id", "chunk_index", "dl", "token", "idf").agg(
            F.count(F.lit(1)).alias("tf"))
    weight = _okapi(F.col("tf"), F.col("dl"), avgdl, F.col("idf"), F.col("qtf"))
    scored = tf.join(asked, "token").groupBy("query_id", "doc_id", "chunk_index").agg(F.sum(weight).alias("score"))
    return _top(scored, top, min_score)


def keyword_topk(queries: DataFrame, chunks: DataFrame, top: int = TOP_CHUNKS) -> DataFrame:
    """Share of the query's distinct tokens that a chunk holds."""
    q = queries.select("query_id", "doc_id", F.array_distinct("terms").alias("q"))
    c = chunks.select("doc_id", "chunk_index", F.array_distinct(tokenize("chunk")).alias("t"))
    hit = q.join(c, "doc_id").withColumn("hits", F.size(F.array_intersect("q", "t"))).where("hits > 0").select(
        "query_id", "doc_id", "chunk_index", (F.col("hits") / F.size("q")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_index")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def first_words(quote: str | Column, n: int = 10) -> Column:
    return F.array_join(F.slice(words(quote), 1, n), " ")


def html_to_text(pages: DataFrame, drop=("script", "style")) -> DataFrame:
    """Visible text of a page, one trimmed non-blank line per text node."""
    from html.parser import HTMLParser

    dropped = frozenset(drop)

    class Visible(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.depth = [], 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag in dropped

        def handle_endtag(self, tag):
            self.depth -= tag in dropped and self.depth > 0

        def handle_data(self, data):
            if not self.depth:
                self.parts.append(data)

    def visible(html: str) -> str:
        parser = Visible()
        parser.feed(html)
        parser.close()
        lines = (line.strip() for line in "\n".join(parser.parts).splitlines())
        return "\n".join(line for line in lines if line)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": batch["html"].map(visible)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, text string")


def classify_payload(payloads: DataFrame) -> DataFrame:
    """Accept or reject a fetched file by its first bytes and extracted text.

    Columns: content (binary), content_type, text (already extracted).
    """
    head = F.lower(F.decode(F.substring("content", 1, 1000), "ISO-8859-1"))
    is_pdf = ((F.decode(F.substring("content", 1, 5), "ISO-8859-1") == "%PDF-")
              | F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("application/pdf")))
    is_html = F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype"))
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    kind = (F.when(F.length("content") < 100, F.lit("too_small")).when(is_pdf, F.lit("pdf"))
            .when(is_html, F.lit("html")).otherwise(F.lit("unknown")))
    return payloads.withColumn("kind", kind).withColumn(
        "accepted", ((F.col("kind") == "pdf") & (size > 200)) | ((F.col("kind") == "html") & (size > 500)))


def read_files(spark, path: str, suffixes=("txt", "md", "html"), max_mb: int = 100) -> DataFrame:
    """Text files of a folder as documents; other suffixes and files over the
    size limit are left out."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
             .where(F.col("length") <= max_mb * 1024 * 1024))
    name = F.element_at(F.split("path", "/"), -1)
    text = F.decode("content", "UTF-8")
    visible = F.when(name.endswith(".html"), F.regexp_replace(
        F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<[^>]+>", "\n")).otherwise(text)
    return files.select(F.substring(F.md5(F.concat_ws("_", "path", "modificationTime")), 1, 12).alias("doc_id"),
                        name.alias("source"), visible.alias("text"))
