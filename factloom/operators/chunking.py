"""Bounded, overlapping chunks of documents, and the rows that an ingested document becomes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CHARS, OVERLAP = 1200, 200


def check_sizes(max_chars: int, overlap: int) -> None:
    if max_chars <= 0 or overlap < 0 or overlap >= max_chars:
        raise ValueError("max_chars must be positive, and overlap at least 0 and below max_chars")


def _pieces(paragraph: str, limit: int) -> Iterator[str]:
    """A long paragraph in parts of whole sentences; a sentence over the limit is cut, its rest begins the next part."""
    part = ""
    for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
        if len(sentence) > limit:
            if part:
                yield part
            whole = len(sentence) - len(sentence) % limit
            yield from (sentence[i : i + limit] for i in range(0, whole, limit))
            part = sentence[whole:]
        elif part and len(part) + 1 + len(sentence) > limit:
            yield part
            part = sentence
        else:
            part = f"{part} {sentence}" if part else sentence
    if part:
        yield part


def chunk_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[str]:
    """Paragraphs packed up to max_chars; each chunk begins with the end of the one before where that fits."""
    check_sizes(max_chars, overlap)
    chunk = ""
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        for piece in _pieces(paragraph, max_chars) if len(paragraph) > max_chars else (paragraph,):
            if not chunk:
                chunk = piece
            elif len(chunk) + 2 + len(piece) <= max_chars:
                chunk = f"{chunk}\n\n{piece}"
            else:
                yield chunk
                tail = chunk[-overlap:] if overlap else ""
                chunk = f"{tail}\n\n{piece}" if tail and len(tail) + 2 + len(piece) <= max_chars else piece
    if chunk:
        yield chunk


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, position, text) of the chunks of (doc_id, text); no shuffle, a document at a time."""
    check_sizes(max_chars, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = [(d, i, c) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True) for i, c in enumerate(chunk_text(t or "", max_chars, overlap))]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], part["doc_id"].type), "position": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, position long, text string")


def sections(items: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, page, text): layout items (doc_id, item_no, is_header, page, text) grouped under their headers."""
    from pyspark.sql import Window

    no = F.sum(F.col("is_header").cast("int")).over(Window.partitionBy("doc_id").orderBy("item_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("item_no", "text")))), lambda x: x["text"]), "\n\n")
    return items.withColumn("section_no", no.cast("long")).groupBy("doc_id", "section_no").agg(F.min_by(F.when(F.col("is_header"), F.col("text")), "item_no").alias("title"), F.min("page").alias("page"), body.alias("text"))


def ingest(section_rows: DataFrame, tables: DataFrame, figures: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunk rows (doc_id, kind, page, section, position, text, figure_id) of parsed documents."""
    keyed = section_rows.select(F.to_json(F.struct("doc_id", "page", F.col("title").alias("section"), F.col("section_no").alias("n"))).alias("doc_id"), "text")
    parts = chunk_documents(keyed, max_chars, overlap)
    kind = section_rows.schema["doc_id"].dataType.simpleString()
    meta = F.from_json("doc_id", f"doc_id {kind}, page int, section string, n long")
    text = parts.select(meta.alias("m"), "position", "text").select("m.doc_id", F.lit("text").alias("kind"), "m.page", "m.section", (F.col("m.n") * 1_000_000 + F.col("position")).alias("position"), "text", F.lit(None).cast("string").alias("figure_id"))
    table = tables.select("doc_id", F.lit("table").alias("kind"), "page", F.lit(None).cast("string").alias("section"), F.col("position").cast("long").alias("position"), T.table_text("caption", "markdown").alias("text"), F.lit(None).cast("string").alias("figure_id")).where("text is not null")
    figure = figures.select("doc_id", F.lit("figure").alias("kind"), "page", F.lit(None).cast("string").alias("section"), F.col("position").cast("long").alias("position"), T.figure_text("caption", "page", "description").alias("text"), "figure_id")
    return text.unionByName(table).unionByName(figure)
