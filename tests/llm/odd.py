"""Small tables with every odd case, for all operators."""

import zlib

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns with the names of results and of what operators use inside
    *(T.StructField(c, T.StringType()) for c in (
        "score", "lang_pred", "held_out", "predicted", "fingerprint", "size", "shard", "slot", "taken", "ids",
        "n_tokens", "chunk", "part", "key", "node", "label", "toxic", "hash", "copies", "limit", "place", "tokens"))])

TEXTS = [
    None, "", "   \t\n", "!!! 123 ...", "a", "The the THE the", "the cat sat on the mat and the dog ran",
    "the cat sat on the mat and the dog ran", "the cat sat on the mat and the dog ran off", "el perro y el gato de la casa",
    "der Hund und die Katze im Haus üß", "word " * 30_000, "x" * 50_000, "naïve café\x00 \x1f\x85 ½ Ⅷ 中文 🙂 <|endoftext|> 's",
    "you stupid idiot", None, "", "the cat sat on the mat and the dog ran"]


def documents(spark, texts=TEXTS, extra=()):
    rows = []
    for i, t in enumerate(texts):
        key = None if i == 15 else i
        lang = [None, "en", "es", "de"][i % 4]
        source = [None, "a", "b", "é", "z"][i % 5]
        rows.append((key, t, lang, source, None, *[f"old {i}"] * 22))
    rows += [rows[i] for i in (6, 6, 11) if i < len(rows)]  # repeated rows
    return spark.createDataFrame(rows + list(extra), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def fold(key, folds):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
