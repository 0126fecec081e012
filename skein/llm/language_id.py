"""Language identification by compression (operator 2).

Each language has a zstandard raw-content dictionary made of its own text. A text
is encoded with every dictionary, and the smallest result names its language.
Where the two smallest differ by less than `least_margin` bytes the answer is
marked as rejected (equal sizes go to the language seen most often). Texts are
normalised first, whole: lower case, letters only, single spaces.

Dictionaries are a bounded sample of labelled rows: about `sample_docs` texts a
language, twice that at most over all, none above `sample_bytes` bytes, cut to
the length of the shortest language's sample, 4096 bytes at least and
`dict_bytes` at most, as the sizes of encodings are compared directly.

Defined results: a null text or one without a letter is `und` with score 0, and
so is any text when nothing could be learned; a very long text is encoded whole; rows without a language are not
learned from; equal rows get equal answers; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 100, 20_000, 64 << 10
LEVEL, MIN_MATCH = 6, 3
LEAST_MARGIN = 2
_WORD = re.compile(r"[^\W\d_]+")


def normalised(text: str) -> bytes:
    return " ".join(_WORD.findall(text.lower())).encode()


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) of the rows (text, lang), the most frequent language first."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    small = rows.filter(F.octet_length("text") <= sample_bytes)
    counts = {r.lang: r.c for r in small.groupBy("lang").agg(F.count("*").alias("c")).collect()}  # a row a language
    if not counts:
        return []
    rates = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, sample_docs / c))])
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    sample = small.withColumn("place", place).filter(F.col("place") < rates[F.col("lang")])
    sample = sample.orderBy("place", "lang", "text").limit(2 * sample_docs * len(counts)).collect()  # about sample_docs a language; copies of a text come together, hence the limit
    texts: dict[str, list[bytes]] = {}
    for row in sorted(sample, key=lambda r: (r.lang, r.place, r.text)):
        texts.setdefault(row.lang, []).append(normalised(row.text))
    joined = {lang: b" ".join(x) for lang, x in texts.items()}
    joined = {lang: x for lang, x in joined.items() if x}
    if not joined:
        return []
    size = min(dict_bytes, max(4096, min(map(len, joined.values()))))
    return [(lang, joined[lang][:size]) for lang in sorted(joined, key=lambda x: (-counts[x], x))]


class Coder:
    """Compressors with the dictionaries of all languages."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int, min_match: int) -> None:
        import zstandard

        self.names, self.codecs = [], []
        for lang, data in dictionaries:
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(data), source_size=4000, min_match=min_match, write_content_size=0, write_dict_id=0, write_checksum=0)
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            self.names.append(lang)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))

    def classify(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, margin in bytes)"""
        raw = normalised(text) if text else b""
        if not raw or not self.names or not has_letter(raw):
            return "und", 0.0, 0
        sizes = [len(c.compress(raw)) for c in self.codecs]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sorted(sizes)
        total = sum(2.0 ** -min((s - sizes[best]) / 2, 60) for s in sizes)
        return self.names[best], 1 / total, others[1] - others[0] if len(others) > 1 else len(raw)


PREDICTED = "doc_id long, lang_pred string, score double, margin long, rejected boolean"


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], level: int = LEVEL, min_match: int = MIN_MATCH, least_margin: int = LEAST_MARGIN) -> DataFrame:
    """PREDICTED rows of every row of `docs` (doc_id, text)."""

    def kernel(batches):
        coder = Coder(dictionaries, level, min_match)
        for batch in batches:
            found = [coder.classify(t) for t in batch.column(1).to_pylist()]
            names, scores, margins = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64()), pa.array([m < least_margin for m in margins], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, PREDICTED)


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.filter(~held_out(3, 1)))
    return identify(docs, dictionaries).withColumn("held_out", held_out(3, 1)).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
