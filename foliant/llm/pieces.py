"""Piece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from foliant.llm.common import id_field, map_texts, texts_of, worker_table
from foliant.llm.token_counts import MARK, cuts_at_marks, processor

#: Chunks a worker keeps; beyond this the table starts anew.
TABLE_ENTRIES = 600_000
#: Longer chunks (code points) are segmented where they stand and not kept.
LONG_CHUNK = 64
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Marked chunk -> (its ids, its decoded text).

    A chunk is a run of marks and the characters up to the next mark.  No piece crosses from a
    character to a mark, so the ids of a text are those of its chunks in order.  The library puts a
    mark in front of what it encodes and drops one when it decodes; both are allowed for here.
    """

    def __init__(self, model_file: str, entries: int = TABLE_ENTRIES) -> None:
        if not cuts_at_marks(model_file):
            raise ValueError("pieces of this model cross marks; encode whole texts instead")
        self.sp, self.entries = processor(model_file), entries
        self.lone = (self.sp.piece_to_id(MARK),)
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunks: list[str]) -> list[tuple[str, str]]:
        """Ids (decimal, joined by commas) and decoded text of each chunk, from one call of the library each way."""
        ids = [list(self.lone) if c == MARK else i for c, i in zip(chunks, self.sp.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        return [(",".join(map(str, i)), " " + t) for i, t in zip(ids, self.sp.decode(ids), strict=True)]

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks of a slice that the table lacks."""
        if len(self.ids) > self.entries:
            self.ids, self.text = {}, {}
        missing = [c for c in chunks if c not in self.ids]
        for start in range(0, len(missing), 50_000):
            part = missing[start:start + 50_000]
            for chunk, (ids, text) in zip(part, self.segment(part), strict=True):
                self.ids[chunk], self.text[chunk] = ids, text

    def forget(self, chunks: set[str]) -> None:
        for chunk in chunks:
            if len(chunk) > LONG_CHUNK:
                del self.ids[chunk], self.text[chunk]


def encode_decode(docs: DataFrame, model_file: str, digests: bool = True) -> DataFrame:
    """Ids of each whole text as the sentencepiece library gives them, and the text they decode to.

    Each distinct chunk of a slice of texts is segmented once per worker and its ids are joined back
    by position; what a worker has learnt serves its later slices and tasks.  With ``digests`` the ids
    and the decoded text are returned as SHA-256; otherwise as array ``ids`` and string ``decoded``.

    A null text is empty and has no ids; repeated rows are encoded one by one; an empty table gives no
    rows; a null id is carried along; columns other than doc_id and text are not read.
    """
    outputs = ([T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else
               [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    schema = T.StructType([id_field(docs), T.StructField("n_tokens", T.LongType()), *outputs])
    name = f"chunks of {model_file}"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = worker_table(name, lambda: ChunkTable(model_file))
        split = [table.chunks(t) for t in texts_of(batch)]
        distinct = set().union(*split)
        table.learn(distinct)
        counts, ids, decoded = [], [], []
        for chunks in split:
            joined = ",".join(map(table.ids.__getitem__, chunks))
            text = "".join(map(table.text.__getitem__, chunks))[1:]
            counts.append(joined.count(",") + 1 if chunks else 0)
            ids.append(_sha(joined) if digests else [int(i) for i in joined.split(",")] if chunks else [])
            decoded.append(_sha(text) if digests else text)
        table.forget(distinct)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())),
                                           pa.array(decoded, pa.string())], schema.names)

    return map_texts(docs.select("doc_id", "text"), work, schema, table=name)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
