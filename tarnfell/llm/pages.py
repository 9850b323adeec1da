"""Main text of web pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfell.llm.blocks import blocks, features
from tarnfell.llm.crf import Field
from tarnfell.llm.pagemodel import trained


def main_text(page: str | None, field: Field) -> str:
    """The article of one page, a block a line."""
    parts = blocks(page or "")
    labels = field.labels(features(parts))
    return "\n".join(p.text for p, keep in zip(parts, labels, strict=True) if keep)


def page_texts(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Article text of every page without menus, notices, adverts, forms, comments and the like.

    ``pages`` has ``path`` and ``html`` of the project's site (such as its
    support and privacy pages). Method: a linear-chain conditional random field
    labels the leaf blocks of the document tree by their ancestors' tags and
    class words and by what their text looks like; it is trained on labelled
    pages of many layouts (``pagemodel``) and decoded by Viterbi. Character
    references are decoded, white space in a block becomes one space, and kept
    blocks are joined in page order by line feeds.

    Returns one row per input row: ``path``, ``html`` as given, and ``text``
    (empty for null or empty pages and where nothing is article). Repeated rows
    stay repeated; extra columns are carried, except one called ``text``, which
    is replaced; an empty table gives no rows.
    """
    field = field or trained()
    kept = [c for c in pages.columns if c != "text"]
    source = pages.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", text string"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), field) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return source.mapInArrow(extract, schema)
