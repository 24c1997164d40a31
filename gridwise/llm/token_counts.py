"""Token counts of the fields or sections of a document, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm.encoder import shared_encoder, token_table

OUT = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segment that each token span [start, end) goes to, among the segments between sorted `edges`, and whether it
    crosses an edge.  Rule: the segment with most of the token; the earlier one where two have as much."""
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, np.maximum(ends - 1, starts), side="right") - 1
    best = first.copy()
    crossing = last > first
    for t in np.flatnonzero(crossing):
        inside = edges[first[t] : last[t] + 2].clip(starts[t], ends[t])
        best[t] = first[t] + int(np.argmax(np.diff(inside)))
    return best, crossing


def byte_offsets(text: str) -> np.ndarray:
    """Where each character of a text, and its end, lies in its UTF-8 bytes."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64))])


def attribute(docs: DataFrame, lines: bool = False) -> DataFrame:
    """`docs`: doc_id, text and spans (array of (start, end) in code points, sorted, not overlapping).

    One row for each span: its place among the spans (`section`), its bounds (cut to the text), the tokens allocated to it, those of
    them that cross an edge, and the tokens of the document.  Tokens between spans are allocated to none of them,
    and gaps compete for a crossing token like spans do.  A span that starts before the last one ended is cut there; an
    empty span has no tokens.  With `lines`, the lines of the text are the spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder()
        width = np.asarray([len(t) for t in token_table()], np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                ids = encoder.encode(text)
                ends = np.cumsum(width[ids])
                # offsets of characters in bytes, which is what token widths are in
                at = None if text.isascii() else byte_offsets(text)
                bounds, before = [], 0
                if lines:
                    line_ends = np.cumsum([len(x) + 1 for x in text.split("\n")]).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip([0, *line_ends], line_ends, strict=False)]
                for span in spans or []:
                    start = min(max(span["start"], before), len(text))
                    before = min(max(span["end"], start), len(text))
                    bounds.append((start, before))
                flat = np.asarray(bounds, np.int64).reshape(-1, 2)
                flat_bytes = flat if at is None else at[flat]
                edges = np.unique(np.concatenate([[0], flat_bytes.ravel(), [ends[-1] if len(ends) else 0]]))
                segment, crossing = allocate(ends - width[ids], ends, edges) if len(ids) else (np.zeros(0, int), np.zeros(0, bool))
                n, crossed = np.bincount(segment, minlength=len(edges)), np.bincount(segment[crossing], minlength=len(edges))
                place = np.searchsorted(edges, flat_bytes[:, 0])
                for i, (start, end) in enumerate(bounds):
                    full = end > start
                    rows.append((doc_id, i, start, end, int(n[place[i]]) if full else 0, int(crossed[place[i]]) if full else 0, len(ids)))
            names, kinds = [f.split()[0] for f in OUT.split(", ")], [pa.int64(), pa.int32()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("spans").cast("array<struct<start:bigint,end:bigint>>")).mapInArrow(run, OUT)


def attribute_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`attribute` for spans in a table of their own (doc_id, start, end), joined to `docs` by doc_id, which must be unique.
    Documents without spans give no rows."""
    own = spans.filter("doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return attribute(docs.select("doc_id", "text").join(own, "doc_id"))


def attribute_lines(docs: DataFrame) -> DataFrame:
    """Tokens of each line of each text, the line feed included, so that lines cover the text.

    Null and empty texts are one empty line.  Null and repeated doc_ids are rows of their own; an empty table gives no rows;
    other columns are not read.
    """
    return attribute(docs.select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")), lines=True)
