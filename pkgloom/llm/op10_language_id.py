"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Every learned language has one raw-content zstandard dictionary, made of pieces of training texts. A text is compressed
whole with each; the smallest result names the language, and a narrow margin sets rejected. Before encoding, letters are
lower-cased and everything else becomes single spaces, in dictionaries and texts alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The bounds of the training sample: rows of a language, about (drawn by a hash of doc_id), characters of a row's text
#: (a longer text gives a piece that begins at a place drawn by the same hash), and the bytes at which a dictionary is full.
TRAIN_TEXTS, PIECE, DICT_BYTES = 400, 4_000, 110_000
LEVEL = 7
#: Share of the best size by which the second must be larger.
MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def held_out(id="doc_id"):
    """Rows without an id are held out too."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(True))


def train(rows: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language of rows (doc_id, text, lang), however long its texts are.

    Only the sample comes to the driver: of each language about TRAIN_TEXTS rows, of each row at most PIECE characters.
    Pieces go in whole, in the order of the hash, until DICT_BYTES are reached. Rows with a null are not learned from;
    no rows give no dictionary.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    common = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not common:
        return {}
    h = F.xxhash64("doc_id")
    draw = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*(F.lit(x) for lang, n in common.items() for x in (lang, TRAIN_TEXTS / n)))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int")
    sample = rows.where(draw < share[F.col("lang")]).select("lang", F.substring("text", place + 1, F.lit(PIECE)).alias("piece"), h.alias("h"), "doc_id")
    texts: dict[str, list[bytes]] = {}
    for lang, piece, _, _ in sorted(sample.collect(), key=lambda r: (r[2], r[3], r[1])):
        have = texts.setdefault(lang, [])
        if sum(map(len, have)) < DICT_BYTES:
            have.append(letters(piece).encode())
    return {lang: b"\n".join(texts[lang]) for lang in sorted(texts, key=lambda x: (-common[x], x))}


def letters(text: str) -> str:
    """The letters of text in lower case, runs of anything else as one space."""
    out = _OTHER.sub(" ", text.lower()).strip()
    # word characters that are no letters: number signs such as ½, ² and Ⅷ
    return out if out.replace(" ", "").isalpha() else " ".join("".join(c if c.isalpha() else " " for c in out).split())


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Language of every row (doc_id, text): doc_id, held_out, lang_pred, score, margin, rejected.

    Null texts and texts without a letter are `und` with score 0. Equal sizes go to the language with more training rows, then by name. Without
    any dictionary every text is `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(dictionaries)
        tools = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        for batch in batches:
            out = {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": [], "score": [], "margin": [], "rejected": []}
            for value in batch.column(1):
                text = letters(value.as_py() or "")
                pred, score, margin = UNKNOWN, 0.0, 0.0
                if langs and text:
                    raw = text.encode()
                    sizes = np.array([len(tool.compress(raw)) for tool in tools], float)
                    order = np.argsort(sizes, kind="stable")
                    pred, best = langs[order[0]], sizes[order[0]]
                    margin = (sizes[order[1]] - best) / best if len(langs) > 1 else 1.0
                    # code lengths in bits as log2 probabilities, tempered by the text's length
                    p = np.exp2(-(sizes - best) / max(1.0, best / 64))
                    score = float(1 / p.sum())
                out["lang_pred"].append(pred)
                out["score"].append(score)
                out["margin"].append(float(margin))
                out["rejected"].append(bool(margin < MARGIN))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]))

    return docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")).mapInArrow(run, _SCHEMA)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), train(docs.where(~held_out()).select("doc_id", "text", "lang")))
