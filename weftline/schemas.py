"""Fixed schemas of the records the engine reads and writes."""

from pyspark.sql import types as T

_s, _i = T.StringType(), T.IntegerType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MANIFEST = _of(status=_s, saved_path=_s, type=_s, url=_s, depth=_i, category=_s, fetched_at=_s)
METADATA = _of(url=_s, title=_s, depth=_i, source_type=_s, category=_s, fetched_at=_s)
CHUNK = T.StructType([*METADATA.fields, *_of(text=_s, chunk_index=_i, chunk_len=_i).fields])
EXTRACTED = _of(url=_s, title=_s, source_type=_s, category=_s, text=_s)
PAYLOAD = _of(text=_s, url=_s, title=_s, depth=_i, source_type=_s, category=_s, fetched_at=_s, chunk_index=_i, chunk_len=_i)
POINT = _of(id=_s, dense=T.ArrayType(T.FloatType()), payload=PAYLOAD)
SOURCE = _of(index=_i, url=_s, title=_s, source_type=_s)
TURN = _of(role=_s, content=_s)
PDF_PAGE = _of(path=_s, page_no=_i, text=_s)

#: Constants of the pipeline.
MAX_HTML_CHUNK, OVERLAP_HTML = 800, 100
CHARS_PER_TOKEN, MAX_PDF_TOKENS, OVERLAP_TOKENS = 4, 512, 128
MAX_PDF_CHARS, OVERLAP_PDF = CHARS_PER_TOKEN * MAX_PDF_TOKENS, CHARS_PER_TOKEN * OVERLAP_TOKENS
MIN_PDF_TEXT = 100
DENSE_DIM, BATCH_SIZE = 1024, 32
DENSE_TOP_K, RERANK_TOP_N = 50, 5
MAX_CTX_CHARS = 3000
TEMPERATURE, NUM_CTX = 0.1, 4096
