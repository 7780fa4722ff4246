"""Language identification by words first, then shorter and shorter character n-grams.

``learn`` counts, per language, the words of labelled texts and the
character n-grams (n = ``MAX_N`` .. 1) of those words between word marks.
A word that any language knows scores by its log frequency in each
language.  An unseen word backs off: of its n-grams of the longest n with
a known one, the mean log frequency counts.  A text's total per language,
divided by the square root of its number of words, goes through a softmax:
the best language and its share are the prediction and its score.

The model is fitted on at most about ``docs_per_lang`` labelled texts of
each language (all, if there are fewer), chosen by a hash of the id; that
bound also bounds the model, which is sent to the executors.  Prediction
reads every whole text and nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score
0, as is every text if there was nothing to learn from; rows with a null
label or text teach nothing; equal scores go to the language that sorts
first; each row is judged on its own, so repeated rows get repeated
results; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batches, model_at_hand, saved

MAX_N = 4
DOCS_PER_LANG = 2000
MAX_LANGS = 1000
CACHE = 300_000
SMOOTH = 0.5
UNDETERMINED = "und"

_words = re.compile(r"[^\W\d_]+").findall


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """``lang`` and ``text`` of about ``docs_per_lang`` labelled rows of each language."""
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                      F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = own.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rates = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_lang / r["count"])))) \
        if sizes else F.create_map().cast("map<string,double>")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    return own.where(share < rates[F.col("lang")]).select("lang", "text")


def learn(rows: DataFrame, min_count: int = 2) -> dict:
    """The model: languages, and for words (n = 0) and n-grams their log frequency in each language."""
    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 2048):
            found: dict[tuple[str, int], Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[lang, 0].update(_words(text.lower()))
            for lang, _ in list(found):
                for w, c in found[lang, 0].items():
                    marked = f" {w} "
                    for n in range(1, MAX_N + 1):
                        for i in range(len(marked) - n + 1):
                            found[lang, n][marked[i:i + n]] += c
            for (lang, n), counts in found.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counts), "n": [n] * len(counts),
                                                  "gram": list(counts), "count": list(counts.values())},
                                                 schema=pa.schema([("lang", pa.string()), ("n", pa.int32()),
                                                                   ("gram", pa.string()), ("count", pa.int64())]))

    parts = rows.select("lang", "text").mapInArrow(count, "lang string, n int, gram string, count long")
    counts = parts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    # a gram must occur min_count times over all languages
    kept = saved(counts.groupBy("n", "gram").agg(F.sum("count").alias("all"), F.collect_list(
        F.struct("lang", "count")).alias("by")).where(F.col("all") >= min_count), "langid")
    rows = kept.select("n", "gram", F.explode("by").alias("x")).select("n", "gram", "x.lang", "x.count").toArrow()
    langs = sorted(rows.column("lang").unique().to_pylist())
    tables = {}
    for n in range(MAX_N + 1):
        own = rows.filter(pc.equal(rows.column("n"), n)).combine_chunks()
        grams = pa.array(own.column("gram").combine_chunks(), pa.string()).dictionary_encode()  # the driver holds no strings of Python
        of = pc.index_in(own.column("lang"), pa.array(langs, pa.string())).to_numpy()
        table = np.zeros((len(grams.dictionary), len(langs)))
        np.add.at(table, (grams.indices.to_numpy(), of), own.column("count").to_numpy())
        table = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * max(1, len(table)))).astype(np.float32)
        tables[n] = (grams.dictionary, table)
    return {"key": uuid.uuid4().hex, "langs": langs, "tables": tables}


class Scorer:
    """A model ready for use in one Python process."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.index = [{g: i for i, g in enumerate(model["tables"][n][0].to_pylist())} for n in range(MAX_N + 1)]
        self.tables = [model["tables"][n][1] for n in range(MAX_N + 1)]
        self.known = len(self.index[0])
        self.extra: dict[str, int] = {}
        self.matrix = np.zeros((self.known + CACHE + 1, len(self.langs)), np.float32)
        self.matrix[:self.known] = self.tables[0]

    def unseen(self, word: str) -> np.ndarray:
        marked = f" {word} "
        for n in range(MAX_N, 0, -1):
            get = self.index[n].get
            if at := [i for k in range(len(marked) - n + 1) if (i := get(marked[k:k + n])) is not None]:
                return self.tables[n][at].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Total score of some words in each language."""
        get, extra = self.index[0].get, self.extra
        out = np.zeros(len(self.langs))
        for a in range(0, len(words), CACHE // 2):
            part = words[a:a + CACHE // 2]
            if len(extra) > CACHE // 2:
                extra.clear()
            at = []
            for w in part:
                i = get(w)
                if i is None:
                    i = extra.get(w)
                    if i is None:
                        i = extra[w] = self.known + len(extra)
                        self.matrix[i] = self.unseen(w)
                at.append(i)
            out += self.matrix[at].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _words(text.lower()) if text else []
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        score = self.rows(words) / np.sqrt(len(words))
        share = np.exp(score - score.max())
        share /= share.sum()
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def _ready(model: dict) -> Scorer:
    return model_at_hand(("langid", model["key"]), lambda: Scorer(model))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([source.schema["doc_id"], StructField("lang_pred", StringType(), False),
                         StructField("score", DoubleType(), False)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ready(shared.value)
        for b in batches(stream):
            found = [own.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: dict, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a determined language of at least ``min_score``, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ready(shared.value)
        for b in batches(stream):
            found = [own.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
