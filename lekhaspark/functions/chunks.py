"""Page texts as overlapping chunks that end at paragraph, line, sentence or word breaks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import normalize_space

# Breaks from the strongest to the weakest.
BREAKS = ["\n\n", "\n", "।", ". ", "? ", "! ", "; ", ", ", " "]


def chunk_spans(text: str, target: int = 1400, overlap: int = 220, least: int = 180, reach: int = 250) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a normalised text; a short one is left out unless it is the last."""
    n, at, spans = len(text), 0, []
    while at < n:
        end = ideal = min(n, at + target)
        if ideal < n:
            low, high = min(n, max(at + least, ideal - reach)), min(n, ideal + reach)
            places = ((text.rfind(b, low, high + len(b)), len(b)) for b in BREAKS)
            end = next((p + size for p, size in places if p >= 0), ideal)
        if end == n or len(text[at:end].strip()) >= least:
            spans.append((at, end))
        if end >= n:
            break
        at = max(end - overlap, 0) if end - overlap > at else end
    return spans


def chunks(docs: DataFrame, key: str, text: str, **sizes: int) -> DataFrame:
    """(key, chunk_index, text, chars, sha256) of every document with text; the key keeps its type."""

    def run(batches):
        for b in batches:
            rows = [[(x[s:e].strip()) for s, e in chunk_spans(x, **sizes)] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.string()))], names=["k", "parts"])

    flat = docs.select(F.col(key).alias("k"), normalize_space(F.col(text)).alias("x")).where("x <> ''")
    cut = flat.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, parts array<string>")
    rows = cut.select(F.col("k").alias(key), F.posexplode("parts").alias("chunk_index", "text"))
    return rows.select(key, "chunk_index", "text", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))
