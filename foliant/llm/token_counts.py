"""Token counts: batches of equal bytes, long texts cut where no piece can cross, lengths only."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from foliant.llm.common import id_field, map_texts, texts_of

#: What stands for a space inside pieces; a space and this character are one to the model.
MARK = "▁"
#: Code points after which a long text may be cut.
SEGMENT_CHARS = 16_384
#: UTF-8 bytes handed to one call of the library.
BATCH_BYTES = 1 << 20


@functools.cache
def processor(model_file: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


@functools.cache
def cuts_at_marks(model_file: str) -> bool:
    """Whether texts may be cut before a mark: no piece has one behind another character, and a mark is put in front."""
    sp = processor(model_file)
    crossing = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
    return not crossing and "".join(sp.encode("a b", out_type=str)) == f"{MARK}a{MARK}b"


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Cut a long text in front of a run of spaces or marks; a text without one stays whole.

    Each later segment starts with the space it was cut at.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and text[at] in (" ", MARK):  # not inside a run
            at += 1
        found = [x for x in (text.find(" ", at), text.find(MARK, at)) if x >= 0]
        if not found:
            break
        out.append(text[start:min(found)])
        start = min(found)
    out.append(text[start:])
    return out


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, segment_chars: int = SEGMENT_CHARS,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Tokens of each whole text as the sentencepiece library gives them, without begin and end ids.

    Texts longer than ``segment_chars`` are cut before a space that follows another character, which no
    piece crosses; the library puts back the space it is cut at.  Segments of one slice are sorted by
    size and dealt to calls of about ``batch_bytes``; only lengths are kept.

    A null text is empty and has no tokens; repeated rows are counted one by one; an empty table gives
    no rows; a null id is carried along; columns other than doc_id and text are not read.
    """
    schema = T.StructType([id_field(docs), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sp, safe = processor(model_file), cuts_at_marks(model_file)
        texts = texts_of(batch)
        owner, pieces, tokens = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for k, part in enumerate(segments(text, segment_chars) if safe else [text]):
                if k and len(part) == 1:  # a single space: the mark alone
                    tokens[i] += 1
                    continue
                owner.append(i)
                pieces.append(part[1:] if k else part)
        order, at = sorted(range(len(pieces)), key=lambda k: len(pieces[k])), 0
        while at < len(order):
            end, size = at, 0
            while end < len(order) and (end == at or size + len(pieces[order[end]]) <= batch_bytes):
                size += len(pieces[order[end]])
                end += 1
            for k, ids in zip(order[at:end], sp.encode([pieces[k] for k in order[at:end]], num_threads=1), strict=True):
                tokens[owner[k]] += len(ids)
            at = end
        size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                                          schema.names)

    return map_texts(docs.select("doc_id", "text"), work, schema)
