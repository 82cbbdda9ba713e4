"""Language identification by mixture inference over word n-gram likelihoods.

Training counts byte trigrams of words for every language over all training
rows.  For a document, each word has a likelihood under each language; EM
estimates the proportions of the languages; sets of the largest one, two, ...
languages are refitted for as long as the penalised likelihood (half the
logarithm of the word count for each language beyond the first) rises, and the
best is kept.  The predicted language has the largest proportion, which is the
score.  A model may hold an unknown language as well, under which all trigrams
are equally likely; text that is mostly in it is in none of those learned.

Defined results: null text, or text without a letter, is ``und`` with score 0;
so is every text if nothing was learned; ties go to the language that sorts
first; rows are judged one by one, so repeated rows get equal answers; a text of
any length is judged whole, in pieces of bounded memory; other columns pass
through, except those named like an output, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import textkit as tk
from quire.llm.scratch import bound_batches, set_aside

GRAM_LOG = 16
SMOOTH = 0.1
ROUNDS = 8
REFIT_ROUNDS = 4
CELLS = 1 << 21  # words times languages held at once
MAX_LANGUAGES = 256
UNKNOWN = "und"
MAX_UNKNOWN = 0.75  # share of the unknown language beyond which a document is rejected

#: Bytes of words: letters a-z (A-Z as a-z) and all of 0x80 and up; others are gaps.
_CODE = np.zeros(256, dtype=np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[0x80:] = np.arange(27, 155)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram around each byte, whether the byte is of a word); gaps part rows."""
    code = _CODE[data]
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    before[offsets[:-1][offsets[:-1] < len(code)]] = 0
    after[offsets[1:][offsets[1:] > 0] - 1] = 0
    mixed = (before * np.uint32(155) + code) * np.uint32(155) + after
    return (mixed * np.uint32(2654435761)) >> np.uint32(32 - GRAM_LOG), code > 0


def _word_starts(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    return np.flatnonzero(inside & ~before)


def _count(max_languages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                if lang not in totals and len(totals) == max_languages:
                    raise ValueError(f"more than {max_languages} languages to learn")
                texts = batch.column(0).filter(pa.array(langs == lang))
                counts = totals.setdefault(lang, np.zeros(1 << GRAM_LOG, dtype=np.int64))
                for _, _, data, offsets in tk.row_blocks(texts):
                    grams, inside = _grams(data, offsets)
                    counts += np.bincount(grams[inside], minlength=len(counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([zlib.compress(c.tobytes(), 1) for c in totals.values()], pa.binary())], ["lang", "counts"]
        )

    return run


def _total(pdf):
    counts = np.zeros(1 << GRAM_LOG, dtype=np.int64)
    for blob in pdf["counts"]:
        counts += np.frombuffer(zlib.decompress(blob), np.int64)
    return pdf.iloc[:1][["lang"]].assign(counts=[counts.tobytes()])


class LanguageModel:
    """Log-likelihood of each hashed trigram under each language, names sorted."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        rows = [np.log((counts[n] + SMOOTH) / (counts[n].sum() + SMOOTH * len(counts[n]))) for n in self.names]
        self.logp = np.array(rows, dtype=np.float32).reshape(len(rows), 1 << GRAM_LOG)

    def with_unknown(self) -> LanguageModel:
        """The model and, after its languages, one under which all trigrams are equally likely."""
        more, name = LanguageModel({}), UNKNOWN
        while name in self.names:
            name += "?"
        more.names = [*self.names, name]
        more.logp = np.vstack([self.logp, np.full((1, 1 << GRAM_LOG), -GRAM_LOG * np.log(2), dtype=np.float32)])
        return more


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Count over all rows with text and language; the model's size follows the languages only."""
    seen = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    bound_batches(rows.sparkSession)
    parts = seen.mapInArrow(tk.tidy(_count(max_languages)), "lang string, counts binary")
    found = parts.groupBy("lang").applyInPandas(_total, "lang string, counts binary").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    return LanguageModel({r["lang"]: np.frombuffer(r["counts"], np.int64) for r in found})


class _Words:
    """Likelihoods of the words of some texts, a piece at a time.

    Texts that fit are one piece, which is kept; a longer text is cut into
    pieces of ``CELLS`` that are made anew for each pass.
    """

    def __init__(self, grams: np.ndarray, inside: np.ndarray, starts: np.ndarray, firsts: np.ndarray, counts: np.ndarray, model: LanguageModel):
        self.grams, self.inside, self.starts, self.firsts, self.counts, self.model = grams, inside, starts, firsts, counts, model
        step = max(1, CELLS // len(model.names))
        self.cuts = [0, len(starts)] if len(starts) <= step or len(counts) > 1 else [*range(0, len(starts), step), len(starts)]
        self.kept = self._piece(0, len(starts)) if len(self.cuts) == 2 else None

    def _piece(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        names = len(self.model.names)
        begin, end = self.starts[lo], self.starts[hi] if hi < len(self.starts) else len(self.grams)
        grams, outside, starts = self.grams[begin:end], ~self.inside[begin:end], self.starts[lo:hi] - begin
        logs = np.empty((hi - lo, names), dtype=np.float32)
        for j in range(names):
            one = self.model.logp[j][grams]
            one[outside] = 0
            logs[:, j] = np.add.reduceat(one, starts)
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(logs - top, -60))
        if len(self.cuts) == 2:
            return like, self.firsts, np.repeat(np.arange(len(self.counts)), self.counts), top[:, 0]
        return like, np.zeros(1, np.int64), np.zeros(hi - lo, np.int64), top[:, 0]

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        if self.kept is not None:
            yield self.kept
        else:
            for lo, hi in zip(self.cuts, self.cuts[1:]):
                yield self._piece(lo, hi)

    def step(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round of EM: (new shares, log-likelihood under the old ones up to each word's own constant)."""
        sums, fit = np.zeros(share.shape), np.zeros(len(share))
        for like, firsts, row_of, _ in self.pieces():
            weighted = like * share[row_of]
            total = np.maximum(weighted.sum(axis=1), 1e-30)
            weighted /= total[:, None]
            sums += np.add.reduceat(weighted, firsts, axis=0)
            fit += np.add.reduceat(np.log(total), firsts)
        return (sums / self.counts[:, None]).astype(np.float32), fit

    def chosen(self) -> np.ndarray:
        """The shares of the best set of languages for each text."""
        names = len(self.model.names)
        share = np.full((len(self.counts), names), 1 / names, dtype=np.float32)
        for _ in range(ROUNDS):
            share, _ = self.step(share)
        order = np.argsort(-share, axis=1, kind="stable")
        best, best_score = None, None
        for size in range(1, names + 1):
            fitted = np.zeros_like(share)
            np.put_along_axis(fitted, order[:, :size], np.maximum(np.take_along_axis(share, order[:, :size], axis=1), 1e-6), axis=1)
            fitted /= fitted.sum(axis=1, keepdims=True)
            if size == 1:
                fit = self.step(fitted)[1]
            else:
                for _ in range(REFIT_ROUNDS):
                    fitted, fit = self.step(fitted)
            score = fit - 0.5 * np.log(np.maximum(self.counts, 2)) * (size - 1)
            if best is None:
                best, best_score, rising = fitted, score, np.ones(len(score), dtype=bool)
                continue
            rising &= score > best_score
            if not rising.any():
                break
            best[rising], best_score[rising] = fitted[rising], score[rising]
        return best


def infer(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Proportions of the languages for each row; zeros for rows without words."""
    out = np.zeros((len(offsets) - 1, len(model.names)))
    grams, inside = _grams(data, offsets)
    starts = _word_starts(inside, offsets)
    if not len(starts) or not model.names:
        return out
    ranges = np.searchsorted(starts, offsets)
    words = np.diff(ranges)
    used = np.flatnonzero(words)
    out[used] = _Words(grams, inside, starts, ranges[:-1][used], words[used], model).chosen()
    return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_shares`` (language to proportion)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType())),
    ]
    columns = [c for c in docs.columns if c not in {f.name for f in new} and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in columns] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            text = batch.column(batch.schema.names.index("_q_text"))
            names, scores, shares = [], [], []
            for lo, _, data, offsets in tk.row_blocks(text, min(tk.BLOCK // 2, 4 * CELLS // max(1, len(known.names)))):
                found = infer(data, offsets, known)
                top = found.argmax(axis=1) if len(known.names) else np.zeros(len(found), int)
                ascii_letter = np.add.reduceat(np.r_[(_CODE[data] > 0) & (_CODE[data] < 27), False].astype(np.int64), offsets[:-1]) if len(data) else None
                for i in range(len(found)):
                    p = float(found[i, top[i]]) if len(known.names) else 0.0
                    lettered = p > 0 and (
                        (offsets[i + 1] > offsets[i] and ascii_letter[i] > 0) or any(c.isalpha() for c in text[lo + i].as_py() or "")
                    )
                    names.append(known.names[top[i]] if lettered else UNKNOWN)
                    scores.append(min(1.0, p) if lettered else 0.0)
                    shares.append([(known.names[j], float(found[i, j])) for j in np.flatnonzero(found[i])] if lettered else [])
            arrays = [batch.column(batch.schema.names.index(c)) for c in columns]
            arrays += [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *(f.name for f in new)])

    return docs.select(*columns, F.col(text_col).alias("_q_text")).mapInArrow(tk.tidy(run), schema)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4: never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", unknown: float = MAX_UNKNOWN
) -> DataFrame:
    """``docs`` without those in no learned language; a null language becomes the predicted one.

    A document goes if it has no letter, or if the unknown language's share of
    its words is more than ``unknown``.  Where no language can be learned, only
    documents without a letter go.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    if not model.names:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    model = model.with_unknown()
    aside, back = set_aside(docs, ("lang_pred", "score", "lang_shares"))
    entries, none = F.map_entries("lang_shares"), F.lit(model.names[-1])
    found = identify(aside, model, text_col).where(F.size(entries) > 0)
    kept = found.where(F.coalesce(F.try_element_at("lang_shares", none), F.lit(0.0)) <= unknown)
    known = F.transform(F.filter(entries, lambda e: e["key"] != none), lambda e: F.struct((-e["value"]).alias("share"), e["key"].alias("lang")))
    filled = F.coalesce(F.col(lang_col), F.array_min(known)["lang"].cast(docs.schema[lang_col].dataType))
    return kept.withColumn(lang_col, filled).select(*aside.columns).withColumnsRenamed(back)
