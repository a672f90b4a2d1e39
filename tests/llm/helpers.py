"""Small tables with the awkward rows that every operator must take."""
from pyspark.sql import Row

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=True):
    """Rows (id, text, lang); with `extra` a null id, a null text, an empty text, a repeated row and clashing columns."""
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    if extra:
        n = len(rows)
        rows += [(None, "no id here.", "en", None, None), (n, None, None, "s", None), (n + 1, "", "en", "s", 0), (n + 2, " \n\t ", "en", "s", 4), rows[0]]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("fingerprint", "score", "blob", "spans", "hits", "word", "__x", "component_id", "label", "shard", "id"):
            df = df.withColumn(name, F.lit("other"))
    return df


def empty(df):
    return df.limit(0)


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def counted(rows, key="doc_id"):
    out = {}
    for r in rows:
        r = r.asDict() if isinstance(r, Row) else r
        out.setdefault(r[key], []).append(r)
    return out
