"""SentencePiece encoding through tables of distinct chunks, and decoding.

Spaces become markers, and a text gets one in front. Where no piece of a model has a marker after another character, none
crosses the seam between a character and a marker, so a text is the chunks between such seams: a run of markers and what follows it. Each task keeps a table
of the distinct chunks it has met, in which every chunk is segmented once, and a text's ids are those of its chunks, joined back by position.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import tokenizer_file

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks that a worker's table has, and the length from which a chunk isn't kept in it.
TABLE, LONG = 1_000_000, 100
#: Rows that are encoded together.
ROWS = 500


def chunks(text: str) -> list[str]:
    """A text with its markers, cut before each marker that follows another character; none of an empty text."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return CHUNK.findall(marked) if 2 * MARK in marked else [MARK + c for c in marked[1:].split(MARK)]


class Pieces:
    """A model from its file, with a table of the chunks that it has segmented: their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not lib.is_control(i)]
        probe = "Ａ a  b ﬁ é "
        if any(MARK in n.lstrip(MARK) for n in names) or lib.decode(lib.encode(probe)) != probe or lib.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("the model's pieces cross markers, or it changes texts before it cuts them")
        self.alone, self.end = lib.piece_to_id(MARK), lib.eos_id()
        self.decimal = [str(i) for i in range(lib.get_piece_size())]
        self.table: dict[str, bytes] = {}
        #: How many chunks have been segmented.
        self.segmented = 0

    def segment(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks and their ids. The library puts a marker in front itself, but not before nothing."""
        self.segmented += len(new)
        for chunk, ids in zip(new, self.library.encode([c[1:] for c in new], num_threads=1)):
            yield chunk, np.array(ids or [self.alone], "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text and an end. A full table is emptied but for what the texts at hand need."""
        cut = [chunks(t) for t in texts]
        distinct = set().union(*cut)
        if len(self.table) + len(distinct) > TABLE:
            self.table = {c: self.table[c] for c in distinct if c in self.table}
        self.table.update(self.segment(list(distinct.difference(self.table))))
        end = self.end.to_bytes(4, "little")
        out = [b"".join(map(self.table.__getitem__, c)) + end for c in cut]
        for chunk in distinct:
            if len(chunk) > LONG:
                del self.table[chunk]
        return out

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())

    def decimals(self, ids: bytes) -> str:
        """The ids in decimal, joined by single spaces."""
        return " ".join(map(self.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def load(model: str = MODEL) -> Pieces:
    return Pieces(tokenizer_file(model))


def _mapped(docs: DataFrame, id_col: str, text_col: str, model: str, of: Callable[[Pieces, bytes], tuple], fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``id_col`` and what ``of`` makes of the ids of each row's text."""
    types = [t for _, t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                made = [of(pieces, ids) for ids in pieces.encode([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[i] for m in made], t) for i, t in enumerate(types)]], names=[id_col, *fields])

    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *[f"{n} {t}" for n, (t, _) in fields.items()]])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit, the end's last) and ``decoded`` for every row.

    A null text counts as empty: its only id is the end's. Rows are encoded on their own, repeated ones included; a null id
    stays null. Other columns are left out, whatever their names.
    """
    return _mapped(docs, id_col, text_col, model, lambda p, ids: (ids, p.decode(ids)), {"ids": ("binary", pa.binary()), "decoded": ("string", pa.string())})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """As ``round_trip``, but the count of the ids and the SHA-256 of the ids in decimal and of the decoded text, made where they arise."""

    def of(pieces: Pieces, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(pieces.decimals(ids).encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode("utf-8", "replace")).hexdigest()

    return _mapped(docs, id_col, text_col, model, of, {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())})
