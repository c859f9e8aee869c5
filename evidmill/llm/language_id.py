"""Language identification by compression: the language whose dictionary makes the text smallest.

Each language has a raw-content zstandard dictionary, cut from a bounded sample of labelled texts. What is compressed is
the text's distinct lower-case words in order of first use: repetition inside a long text would otherwise let the text
itself serve as dictionary and hide the language.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from evidmill.llm.common import prepare

# The bound of the fit: at most this many labelled rows of a language, and this many bytes of one text in its dictionary,
# so that many texts take part. Prediction has no such bound.
SAMPLE_DOCS = 200
TEXT_BYTES = 2_000
DICTIONARY_BYTES = 96_000
LEVEL = 6

RESULT = "lang_pred string, score double, margin long, rejected boolean"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Language to dictionary bytes, languages in order."""

    dictionaries: dict[str, bytes]


def letters(text: str | None) -> bytes:
    """The distinct lower-case words of ``text``."""
    return " ".join(dict.fromkeys(_WORD.findall((text or "").lower()))).encode("utf-8", "replace")


def fit(docs: DataFrame) -> Model:
    """Dictionaries from ``text, lang`` rows: ``SAMPLE_DOCS`` texts of each language, taken in order of a hash.

    Rows without language or text are no examples. The result is bounded by the number of languages.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("_order"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    # A language with more rows is thinned by the hash before its rows meet, so that no window holds a language whole.
    keep = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 3 * SAMPLE_DOCS / n))])
    part = F.pmod("_order", F.lit(1_000_003)) / 1_000_003.0
    first = Window.partitionBy("lang").orderBy("_order", "text")
    sample = rows.where(part <= keep[F.col("lang")]).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= SAMPLE_DOCS)
    built: dict[str, list[bytes]] = {}
    # A word may be cut at the end of a piece; dictionaries hold plain content, so that does no harm.
    for lang, piece in sample.select("lang", F.substring("text", 1, 4 * TEXT_BYTES)).orderBy("lang", "_rank").toLocalIterator():
        built.setdefault(lang, []).append(letters(piece)[:TEXT_BYTES])
    # zstandard finds the end of a dictionary nearest: the first texts of the sample stand last.
    return Model({lang: b" ".join(reversed(parts))[-DICTIONARY_BYTES:] for lang, parts in sorted(built.items())})


class Classifier:
    """The compressors of a model, made once per task."""

    def __init__(self, model: Model):
        import zstandard

        self.compressors, self.words = {}, {lang: None for lang in model.dictionaries}
        self.model = model
        for lang, content in model.dictionaries.items():
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if len(content) < 8:  # zstandard takes no shorter dictionary
                self.compressors[lang] = zstandard.ZstdCompressor(level=LEVEL, **options)
                continue
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors[lang] = zstandard.ZstdCompressor(dict_data=dictionary, **options)

    def known(self, lang: str, words: list[bytes]) -> int:
        if self.words[lang] is None:
            self.words[lang] = Counter(self.model.dictionaries[lang].split())
        return sum(self.words[lang][w] for w in words)

    def classify(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score, margin in bytes, and whether the two best can't be told apart.

        Equal sizes, as of very short texts, are decided by how often the dictionary holds the words.
        """
        data = letters(text)
        # Number signs such as superscripts count as word characters, but are no letters.
        if not data or not self.compressors or not any(map(str.isalpha, text)):
            return "und", 0.0, 0, True
        sizes = {lang: len(c.compress(data)) for lang, c in self.compressors.items()}
        best = min(sizes.values())
        tied = [lang for lang, size in sizes.items() if size == best]
        close = False
        if len(tied) > 1:
            hits = {lang: self.known(lang, data.split()) for lang in tied}
            tied.sort(key=lambda lang: -hits[lang])
            close = hits[tied[0]] == hits[tied[1]]
        rest = sorted(sizes.values())
        margin = rest[1] - best if len(rest) > 1 else best
        score = 1.0 / sum(2.0 ** -min(size - best, 1000) for size in sizes.values())
        return tied[0], score, margin, close


def classifier(spark: SparkSession, model: Model):
    """A column function ``text -> struct(lang_pred, score, margin, rejected)``."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # at most DICTIONARY_BYTES a language

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        ready = _ready(sent.value)
        return pd.DataFrame([ready.classify(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return predict


_READY: list = []


def _ready(model: Model) -> Classifier:
    if not _READY or _READY[0].model is not model:
        _READY[:] = [Classifier(model)]
    return _READY[0]


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column: ``und``, score 0 and rejected for null texts, texts without letters, or no model.

    All columns and rows of ``docs`` stay; one of the name ``into`` is replaced.
    """
    return docs.withColumn(into, classifier(docs.sparkSession, model)(F.col(text)))
