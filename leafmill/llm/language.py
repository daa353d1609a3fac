"""Language identification by mixture inference over n-gram likelihoods.

Each language is a distribution over hashed byte trigrams, learned from labelled
documents.  A document is a mixture: expectation-maximisation estimates the
proportions of the languages in it.  The set of languages grows greedily from the
best single one, and a language is added only if the log-likelihood gains more
than the penalty (half the logarithm of the number of trigrams, per trigram
overlap).  The language with the largest proportion is the prediction.  Its score is
that proportion times its posterior against the other languages taken alone, so a few
letters give a low one.

Defined results: null text, or text without a letter, is `und` with score 0; a
text with letters but no whole trigram gets the commonest learned language; with
nothing to learn from every text is `und`.  Repeated rows get equal results, an
empty table gives an empty table.  Training may read a bounded sample:
`max_docs_per_lang` rows of each language, chosen by a hash of the id.  More than `MAX_LANGS`
distinct labels are an error, as a label costs BUCKETS numbers in every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches
from leafmill.llm.textkit import NOT_LETTER, buffers, give_back, pieces

BUCKETS = 4096
MAX_DOCS_PER_LANG = 20_000
MAX_LANGS = 1000
#: Trigrams overlap, so one letter counts three times.
OVERLAP = 3.0
_EM_STEPS, _BLOCK = 12, 256

_rng = np.random.default_rng(5)
_code = np.arange(256)
_code[65:91] += 32
_code[NOT_LETTER] = 32
_TABLES = [_rng.integers(0, 1 << 30, 256)[_code].astype(np.uint32) for _ in range(3)]
_BLANK = NOT_LETTER


def trigram_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """documents x BUCKETS counts of trigrams; runs of blanks alone don't count."""
    n = len(offs) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(data) < 3:
        return out
    a, b, c = (t[data[i : len(data) - 2 + i]] for i, t in enumerate(_TABLES))
    h = ((a + b * np.uint32(31) + c * np.uint32(1021)) >> np.uint32(7)) & np.uint32(BUCKETS - 1)
    blank = _BLANK[data]
    use = ~(blank[:-2] & blank[1:-1])
    for at in offs[1:-1]:
        use[max(at - 2, 0) : at] = False
    where = np.flatnonzero(use)
    doc = np.searchsorted(offs, where, "right") - 1 if n > 1 else np.zeros(len(where), np.int64)
    flat = np.bincount(doc * BUCKETS + h[where], minlength=n * BUCKETS)
    out[:] = flat.reshape(n, BUCKETS)
    return out


class LanguageMixture:
    """Languages as trigram distributions (rows of p), with their shares of the training rows."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray):
        self.names = names
        p = counts + 0.5
        p /= p.sum(axis=1, keepdims=True)
        self.p = (0.999 * p + 0.001 / BUCKETS).astype(np.float32)
        self.log_p = np.log(self.p)
        self.prior = docs / max(docs.sum(), 1)

    def _fit(self, c: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after EM from pi (zeros stay), and the log-likelihoods."""
        n = np.maximum(c.sum(axis=1, keepdims=True), 1)
        for _ in range(_EM_STEPS):
            pi = pi * ((c / np.maximum(pi @ self.p, 1e-30)) @ self.p.T) / n
        return pi, (c * np.log(np.maximum(pi @ self.p, 1e-30))).sum(axis=1)

    def infer(self, c: np.ndarray) -> np.ndarray:
        """documents x languages proportions under the selected sets."""
        rows, k = np.arange(len(c)), len(self.names)
        n = c.sum(axis=1)
        single = c @ self.log_p.T
        best = single.argmax(axis=1)
        ll = single[rows, best]
        pi = np.zeros((len(c), k), np.float32)
        pi[rows, best] = 1
        if k == 1:
            return pi
        penalty = OVERLAP * 0.5 * np.log(np.maximum(n, 2))
        free, _ = self._fit(c, np.full((len(c), k), 1 / k, np.float32))
        active = rows
        while len(active):
            wanted = np.where(pi[active] > 0, -1, free[active])
            new = wanted.argmax(axis=1)
            open_ = wanted[np.arange(len(active)), new] > 1e-3
            active, new = active[open_], new[open_]
            if not len(active):
                break
            start = (pi[active] > 0).astype(np.float32)
            start[np.arange(len(active)), new] = 1
            fitted, better = self._fit(c[active], start / start.sum(axis=1, keepdims=True))
            gained = better - ll[active] > penalty[active]
            active = active[gained]
            pi[active], ll[active] = fitted[gained], better[gained]
        return pi

    def posterior(self, c: np.ndarray) -> np.ndarray:
        """documents x languages probabilities, if each document were in one language."""
        fit = c @ self.log_p.T / OVERLAP + np.log(np.maximum(self.prior, 1e-9))
        fit = np.exp(fit - fit.max(axis=1, keepdims=True))
        return fit / fit.sum(axis=1, keepdims=True)

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(offs) - 1)
        for lo in range(0, len(offs) - 1, _BLOCK):
            o = offs[lo : lo + _BLOCK + 1]
            part = data[o[0] : o[-1]]
            c = trigram_counts(part, o - o[0])
            pi = self.infer(c)
            empty = c.sum(axis=1) == 0
            pi[empty] = self.prior
            total = np.maximum(pi.sum(axis=1), 1e-9)
            top = pi.argmax(axis=1)
            rows = np.arange(len(top))
            scores[lo : lo + len(top)] = np.clip(pi[rows, top] / total * self.posterior(c)[rows, top], 0, 1)
            names += [self.names[k] for k in top]
        for i in np.flatnonzero(~has_letter(data, offs)):
            names[i], scores[i] = "und", 0.0
        return names, scores


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_letter = ~NOT_LETTER[data] & (data < 128)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> LanguageMixture:
    """The model of the labelled rows; the driver receives BUCKETS sums per language."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    share = {r["lang"]: min(1.0, max_docs_per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(share) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} distinct labels in {lang_col}")
    if not share:
        return LanguageMixture([], np.zeros((0, BUCKETS)), np.zeros(0))
    unit = (F.xxhash64("id", F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).cast("double")
    wanted = F.lit(False)
    for lang, part in share.items():
        wanted = wanted | ((F.col("lang") == lang) & (unit < part))
    sample = rows.where(wanted).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                langs = part.column(0).to_pylist()
                data, offs = buffers(part.column(1))
                for lo in range(0, len(langs), _BLOCK):
                    o = offs[lo : lo + _BLOCK + 1]
                    c = trigram_counts(data[o[0] : o[-1]], o - o[0])
                    here = np.array(langs[lo : lo + _BLOCK])
                    for lang in set(here.tolist()):
                        sums[lang] = sums.get(lang, 0) + c[here == lang].sum(axis=0, dtype=np.float64)
                        docs[lang] = docs.get(lang, 0) + int((here == lang).sum())
        for lang, c in sums.items():
            k = np.flatnonzero(c)
            n = [docs[lang], *c[k].astype(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([-1, *k.tolist()], pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in sums})
    at = {x: i for i, x in enumerate(names)}
    counts, docs = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    for r in sums:
        if r["bucket"] < 0:
            docs[at[r["lang"]]] = r["n"]
        else:
            counts[at[r["lang"]], r["bucket"]] = r["n"]
    return LanguageMixture(names, counts, docs)


def predict(docs: DataFrame, model: LanguageMixture, text_col: str = "text", *extra: Column, keep_text: bool = False) -> DataFrame:
    """The `extra` columns, then lang_pred, score and, if asked for, the text of each row; a map without shuffle.

    Columns are told apart by their places, so any names may be given, repeated ones too.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(text_col), *extra)
    source = given.toDF(*(f"c{i}" for i in range(len(given.columns))))
    names = source.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "c0"):
                data, offs = buffers(part.column(0))
                if model.names:
                    langs, scores = model.predict(data, offs)
                else:
                    langs, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                text = [part.column(0)] if keep_text else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *text], [*names, "lang_pred", "score", *["text"][: len(text)]])
        give_back()

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    found = source.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", *(["text string"] if keep_text else [])]))
    return found.toDF(*given.columns[1:], *found.columns[len(names) :])
