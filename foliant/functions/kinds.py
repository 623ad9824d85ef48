"""File and document kinds from extension and MIME type (constant maps, no joins)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant import vocab
from foliant.functions.text import col


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def route_document_type(extension: Column | str, content_type: Column | str) -> Column:
    ext, mime = F.lower(col(extension)), F.lower(col(content_type))
    return F.coalesce(F.when(ext.isin(vocab.PLAIN_TEXT_EXTENSIONS), F.lit("Code")),
                      _lookup(vocab.DOCUMENT_TYPE_BY_EXTENSION, ext),
                      _lookup(vocab.DOCUMENT_TYPE_BY_MIME, mime), F.lit("Unknown"))


def route_file_type(extension: Column | str, content_type: Column | str) -> Column:
    ext, mime = F.lower(col(extension)), F.lower(col(content_type))
    by_prefix = [F.when(F.startswith(mime, F.lit(p)), F.lit(t))
                 for p, t in vocab.FILE_TYPE_BY_MIME_PREFIX.items()]
    return F.coalesce(F.when(ext.isin(vocab.PLAIN_TEXT_EXTENSIONS), F.lit("Document")),
                      _lookup(vocab.FILE_TYPE_BY_EXTENSION, ext), *by_prefix,
                      F.when(mime.isin(vocab.DOCUMENT_MIME_TYPES), F.lit("Document")), F.lit("Other"))


def is_extractable(document_type: Column | str, extension: Column | str) -> Column:
    return (F.coalesce(F.lower(col(document_type)).isin(vocab.EXTRACTABLE_TYPES), F.lit(False))
            | F.coalesce(F.lower(col(extension)).isin(
                vocab.EXTRACTABLE_EXTENSIONS + vocab.PLAIN_TEXT_EXTENSIONS), F.lit(False)))


def is_table_type(document_type: Column | str) -> Column:
    return F.coalesce(col(document_type).isin(vocab.TABLE_DOCUMENT_TYPES), F.lit(False))
