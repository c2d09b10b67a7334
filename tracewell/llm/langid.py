"""Operator 3, language identification by language-bitmask n-gram filters.

Learning. Texts become lower-case letters with single spaces; an n-gram is four UTF-16 units, packed exactly into 64
bits. N-grams are counted for each language over all learning rows, first within each task. A language contains an
n-gram that makes up at least ``least_share`` of its n-grams and at least ``least_ratio`` of the n-gram's largest share
in any language. That is the model's definition of what a language contains, by shares over all learning rows, so it
means the same at any size; it holds at most 1 / least_share n-grams a language. These sets go into one Bloom filter whose
cells are bit masks over the languages: a language's slice of bits is its own Bloom filter, and one probe answers for
all languages. The cells are as many as the contained n-grams, once counted, need for ``FALSE_POSITIVES``: with the
defaults at most 2**21 of 64 languages (16 MB each), which is all that is broadcast.

Prediction. For each n-gram of a text the cells of its three probes are ANDed into the mask of languages that contain
it; counts per language are corrected for that slice's false-positive rate, fill**3: (hits - n * fp) / (1 - fp). The
language with the largest corrected share wins; the score is that share.

Edge cases. Null text or no letter: ``und``, score 0. No n-gram known: the language with most learning text, score 0.
Ties: the language that sorts first. Null languages aren't learned from. With nothing to learn from, all are ``und``.
Repeated rows are counted and answered each. Bytes that aren't UTF-8 are read as U+FFFD. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import mix, text_bytes

PROBES, CHUNK = 3, 1_000_000
#: A language's slice answers wrongly for at most this share of n-grams that it doesn't contain.
FALSE_POSITIVES = 2e-3
LEAST_SHARE, LEAST_RATIO = 2e-5, 0.1
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else True for c in range(65536)])


@dataclass
class LanguageFilter:
    languages: list[str]
    cells: np.ndarray  # (words of 64 languages, cells) of bit masks
    fill: np.ndarray  # share of cells set, for each language
    most: int  # the language with most learning text
    bits: int  # log2 of the cells


def letters(text: str) -> np.ndarray:
    """UTF-16 units of a text: lower-case letters, other runs as one space, spaces at both ends."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-16-le", "surrogatepass"), np.uint16)
    a = np.where(_LETTER[a], a, np.uint16(32))
    blank = a == 32
    a = a[~(blank & np.concatenate([[False], blank[:-1]]))]
    return a if len(a) > 3 else np.pad(a, (0, 4 - len(a)), constant_values=32)


def grams(units: np.ndarray) -> np.ndarray:
    """The 4-grams of units; those over a zero unit, which parts texts, are kept for the caller to drop."""
    u = units.astype(np.uint64)
    return u[:-3] | u[1:-2] << np.uint64(16) | u[2:-1] << np.uint64(32) | u[3:] << np.uint64(48)


def _probe(g: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix(g + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - bits)


def cell_bits(n: int, false_positives: float = FALSE_POSITIVES) -> int:
    """log2 of the fewest cells at which ``n`` n-grams of one language keep its slice's false positives within the target."""
    cells = PROBES * n / -math.log1p(-(false_positives ** (1 / PROBES)))
    return max(12, math.ceil(math.log2(max(1.0, cells))))


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([h[1] for h in held])).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) of all rows."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list] = {}

        def count(lang: str, parts: list[np.ndarray]) -> None:
            held = counts.setdefault(lang, [])
            held.append(np.unique(np.concatenate(parts), return_counts=True))
            if len(held) > 8:
                held[:] = [_merge(held)]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in counts.items():
                g, n = _merge(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], schema=schema)
            counts.clear()

        for b in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                g = grams(letters(text.decode("utf-8", "replace")))
                waiting.setdefault(lang, []).append(g)
                size[lang] = size.get(lang, 0) + len(g)
                if size[lang] > CHUNK:
                    count(lang, waiting.pop(lang))
                    size[lang] = 0
            for lang, parts in waiting.items():
                count(lang, parts)
            if sum(len(h[0]) for held in counts.values() for h in held) > 3_000_000:
                yield from flush()
        yield from flush()

    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return some.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE, least_ratio: float = LEAST_RATIO) -> LanguageFilter:
    """The filter of the rows of ``docs``. What reaches the driver is bounded by the filter's size and the languages."""
    from tracewell.llm.shared import Scratch

    scratch = Scratch(docs.sparkSession, "langid")
    counts = scratch.table(gram_counts(docs, text_col, lang_col))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << 12), np.uint64), np.zeros(0), 0, 12)
    all_n = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counts.join(F.broadcast(all_n), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("share"))
    held = shares.where(F.col("share") >= least_share).withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= least_ratio * F.col("most"))
    held = scratch.table(held.select("lang", "gram"))
    bits = cell_bits(held.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    place = {lang: i for i, lang in enumerate(languages)}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([place[x] for x in b.column(0).to_pylist()], np.uint64)
            g = b.column(1).to_numpy().view(np.uint64)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            for k in range(PROBES):
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(_probe(g, k, bits).astype(np.int32)), pa.array(bit)], names=["word", "cell", "bits"])

    set_cells = held.select("lang", "gram").mapInArrow(cells, "word int, cell int, bits long").groupBy("word", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = np.zeros((len(languages) + 63 >> 6, 1 << bits), np.uint64)
    masks[set_cells.column("word").to_numpy(), set_cells.column("cell").to_numpy()] = set_cells.column("bits").to_numpy().view(np.uint64)
    scratch.drop(counts, held)
    fill = np.array([float(((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return LanguageFilter(languages, masks, fill, max(range(len(languages)), key=lambda i: (totals[languages[i]], -i)), bits)


def shares_of(units: list[np.ndarray], model: LanguageFilter) -> np.ndarray:
    """(texts, languages): the corrected share of each text's n-grams that a language contains."""
    g, n = np.concatenate([grams(u) for u in units]), np.array([len(u) - 3 for u in units])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    hits = np.empty((len(units), len(model.languages)))
    probes = [_probe(g, k, model.bits) for k in range(PROBES)]
    for word, masks in enumerate(model.cells):
        mask = masks[probes[0]]
        for p in probes[1:]:
            mask &= masks[p]
        for i in range(64 * word, min(64 * word + 64, len(model.languages))):
            hits[:, i] = np.add.reduceat(((mask >> np.uint64(i & 63)) & np.uint64(1)).astype(np.int64), starts)
    fp = model.fill**PROBES
    return np.clip((hits / n[:, None] - fp) / np.maximum(1 - fp, 1e-9), 0, 1)


def predict(docs: DataFrame, model: LanguageFilter, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score; the text is all that the prediction sees."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            preds, scores = [], []

            def decide(units: list[np.ndarray | None]) -> None:
                known = [u for u in units if u is not None]
                share = iter(shares_of(known, model)) if known else iter(())
                for u in units:
                    s = None if u is None else next(share)
                    best = 0.0 if s is None else float(s.max())
                    preds.append(UNKNOWN if s is None else model.languages[int(s.argmax()) if best > 0 else model.most])
                    scores.append(best)

            units, size = [], 0
            for text in text_bytes(b.column(b.num_columns - 1)):
                text = text.decode("utf-8", "replace")
                fit = bool(model.languages) and any(map(str.isalpha, text))
                units.append(letters(text) if fit else None)
                size += len(units[-1]) if fit else 1
                if size > CHUNK:
                    decide(units)
                    units, size = [], 0
            decide(units)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    some = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[:-1])
    return some.mapInArrow(run, f"{fields}, lang_pred string, score double")


def with_holdout(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with held_out: whether crc32 of the id as text leaves 2 modulo 4."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False)))
