"""Language identification by compression with per-language zstandard dictionaries.

A language's raw-content dictionary is text of its labelled documents. A text is lower-cased and
compressed with each, a long one segment by segment, so that the dictionary counts as much at its end
as at its start; the language of the least total size wins. The margin to the second sets the score,
and a narrow one is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, piece, sized, slices

#: The labelled sample: for each language the rows with the least hash of doc_id, so many characters of
#: each (a piece of longer texts), and so many bytes of them all. With more than SAMPLE_TOTAL / SAMPLE_ROWS
#: languages each brings fewer rows, one at least, so that SAMPLE_TOTAL bounds the rows of them all.
SAMPLE_ROWS = 400
SAMPLE_TOTAL = 102_400
PIECE_CHARS = 2_000
DICTIONARY_BYTES = 98_304
LEVEL = 6
SEGMENT_BYTES = 2048
#: A margin under this share of the least size (and at least two bytes) is narrow.
NARROW = 0.01


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of the rows that may be learned from; a bounded sample reaches the driver."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    counts = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    each = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // max(languages, 1)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    some = rows.join(sized(counts, languages), "lang").where(place < 2 * each / F.col("n") * (1 << 30))  # about twice the sample meets in the ranking, whatever the number of tasks
    some = some.select("doc_id", "lang", "n", piece(F.col("text"), F.col("doc_id"), PIECE_CHARS).alias("text"))
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).orderBy("k", "lang").limit(SAMPLE_TOTAL)
    texts: dict[str, list[str]] = {}
    for r in sorted(some.select("lang", "n", "k", "text").collect(), key=lambda r: (-r.n, r.lang, r.k)):
        texts.setdefault(r.lang, []).append(r.text)
    return {lang: b" " * 8 + "\n".join(dict.fromkeys(own)).lower().encode()[-DICTIONARY_BYTES:] for lang, own in texts.items()}


class Classifier:
    """Compressors for each language, the most frequent first; built where they are used."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.dictionaries = state

    def build(self) -> Classifier:
        self.names, self.packers = list(self.dictionaries), []
        for data in self.dictionaries.values():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False))
        return self

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); ``und`` for null, for texts without a letter, and if nothing was learned."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = text.lower().encode()
        cut = [raw[at : at + SEGMENT_BYTES] for at in range(0, len(raw), SEGMENT_BYTES)]
        sizes = np.array([sum(len(p.compress(x)) for x in cut) for p in self.packers], float)
        best = int(sizes.argmin())
        score = 1.0 / np.exp((sizes[best] - sizes) / 3.0).sum()
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        margin = np.partition(sizes, 1)[1] - sizes[best]
        return self.names[best], float(score), bool(margin < max(2.0, NARROW * sizes[best]))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row of ``docs(doc_id, text, lang)``.

    ``lang_pred`` is the language of the least size even where ``rejected`` marks its margin as narrow;
    ties go to the language with more labelled rows, then the first in the alphabet. Null texts and
    texts without a letter (Unicode category L) are ``und``, and so is everything if there is nothing to learn from. A very
    long text is compressed whole, SEGMENT_BYTES at a time; repeated rows are judged each by itself. A null doc_id isn't held out, nor learned from.
    An empty table gives no rows; other columns are ignored.
    """
    model = Classifier(learn(docs))

    def run(it):
        ready = model.build()
        for batch in slices(it):
            got = [ready.predict(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*got, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
