"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from loomline.functions.mime import HEADERS

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW = _struct(file=_S, message=_S)
HEADER_STRUCT = T.StructType([T.StructField(h, _S) for h in HEADERS])
PARSED = _struct(
    id=_S, headers=HEADER_STRUCT, all_headers=T.MapType(_S, _S), body_text=_S, body_html=_S, parsing_success=T.BooleanType(), error=_S, source_filename=_S
)
THREAD = _struct(
    thread_id=_S, root_message_id=_S, message_count=T.LongType(), message_ids=T.ArrayType(_S), thread_depth=T.LongType(), participants=T.ArrayType(_S),
    date_range=_struct(start=_S, end=_S), subject_variants=T.ArrayType(_S), normalized_subject=_S,
)
QUALITY_ROW = _struct(email_index=T.LongType(), missing_field=T.IntegerType(), has_encoding_issues=T.BooleanType(), is_duplicate=T.BooleanType())
