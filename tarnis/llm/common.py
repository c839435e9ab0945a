"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = r"[\x20\x09-\x0D]+"

#: Texts of a batch are worked on in pieces of about this many characters, to bound temporary arrays.
PIECE = 2_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; a null text becomes empty. Other columns of
    the table are left out, so their names can't clash with results."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def map_batches(
    df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply a function to each Arrow batch."""

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                made = f(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                elif made is not None:
                    yield from made

    return df.mapInArrow(each, schema)


def pieces(texts: Sequence[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together have about so many characters; one text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
