import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, langs=None, sources=None, first=0):
    """Documents with ids from ``first``; a text may be None."""
    n = len(texts)
    rows = [(first + i, t, (langs or ["en"] * n)[i], (sources or ["src0"] * n)[i], None if t is None else len(t))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
