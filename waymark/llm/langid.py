"""Language identification by compression: the per-language zstandard dictionary that makes a text smallest wins.

Fit: whole training texts are cut to pieces of PIECE_CHARS characters; of each language's distinct pieces the PIECES with
the least seeded hashes are dealt to DICTS raw-content dictionaries. That sample is bounded by language, and what it is drawn
from is every piece of every row. All languages are learned; the model, some 130 KB a language, goes to every task.

Predict: the whole text, lower-cased and with everything but letters made one space, is cut into segments of SEGMENT
characters; each is a frame of its own against each dictionary, and a language's sizes add up, so long texts don't become their own dictionary. The score is a logistic function
of the relative margin between the two smallest sizes; `rejected` marks margins under MIN_MARGIN.

Defined results: null text or text without a letter is `und` with score 0; ties go to the language that sorts first;
without training rows all is `und`; rows that repeat are predicted each,
and learned once; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import add_columns

PIECES, PIECE_CHARS, DICTS = 400, 300, 2
SEGMENT, LEVEL, MIN_MATCH, MIN_MARGIN, STEEPNESS = 1500, 6, 3, 0.01, 60.0
_LETTER, _REST = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    return _REST.sub(" ", text.lower()).strip()


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 5) -> dict[str, list[bytes]]:
    """Language -> dictionaries, from rows that may be learned from; null languages and texts are passed over."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    # Pieces end at their length or the text's; the expression is linear in the text.
    each = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))).alias("piece")).withColumn("h", F.xxhash64(F.lit(seed), "piece"))
    sizes = {r["lang"]: r["n"] for r in each.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a language
    if not sizes:
        return {}
    # A little more than the wanted share by hash; the exact number is cut from these few.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * PIECES / n))])
    u = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = each.where(u < F.element_at(share, F.col("lang"))).distinct()
    least = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("k") <= PIECES)
    found: dict[str, list[str]] = {}
    for r in least.orderBy("lang", "k").collect():
        found.setdefault(r["lang"], []).append(letters(r["piece"]))
    return {lang: ["\n".join(t[k::DICTS]).encode() for k in range(DICTS)] for lang, t in found.items()}


class Classifier:
    def __init__(self, model: dict[str, list[bytes]]):
        import zstandard

        self.langs = sorted(model)
        self.made = []
        for lang in self.langs:
            own = []
            for raw in filter(None, model[lang]):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=SEGMENT, dict_size=len(raw), min_match=MIN_MATCH, write_content_size=0, write_dict_id=0)
                own.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
            self.made.append(own)

    def sizes(self, text: str) -> list[float]:
        """Mean size over a language's dictionaries (a lone text makes one only)."""
        text = letters(text)
        parts = [text[i : i + SEGMENT].encode() for i in range(0, len(text), SEGMENT)]
        return [sum(len(c.compress(p)) for p in parts for c in own) / len(own) if own else math.inf for own in self.made]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.langs[k]))
        rest = min((s for k, s in enumerate(sizes) if k != best and s < math.inf), default=sizes[best])
        margin = (rest - sizes[best]) / max(rest, 1)
        return self.langs[best], 1 / (1 + math.exp(-STEEPNESS * margin)), margin < MIN_MARGIN


def identify(docs: DataFrame, model: dict[str, list[bytes]], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, rejected (names get _ if taken)."""

    def make():
        c = Classifier(model)
        return lambda texts: [list(x) for x in zip(*map(c.predict, texts))] if texts else [[], [], []]

    return add_columns(docs, text_col, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())], make)
