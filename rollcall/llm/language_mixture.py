"""Language identification by multilingual mixture inference.

Each language has a model of character n-grams, learned from labelled documents.  A text is
a mixture: every word was written in one of the languages, with unknown proportions.
Expectation-maximisation finds the proportions that make the words' likelihoods best, and
the set of languages is the one with the best penalised likelihood: languages are dropped
one by one as long as a lost language costs less than its penalty.  The language with the
largest proportion is the prediction, its proportion the score.

N-grams are counted in a table of fixed size by their hash, so the models given to every
task are bounded by the number of languages alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.text import mixed
from rollcall.session import materialize

SLOTS = 1 << 15
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 512
ROUNDS, PENALTY = 30, 6.0
UNKNOWN = "und"


def lowered_words(text: str) -> list[str]:
    """Runs of letters in lower case, everything else apart."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split() if not text.isascii() else _ascii(text)


_LETTERS = str.maketrans({chr(c): (chr(c).lower() if chr(c).isalpha() else " ") for c in range(128)})


def _ascii(text: str) -> list[str]:
    return text.translate(_LETTERS).split()


def word_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each n-gram, position of its word) over all words, each with a space before
    and after."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    word = np.cumsum(space) - 1
    slots, owners = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, np.int64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + m]
            inner += space[k : k + m]
        # A gram may begin or end with the space beside its word, but not reach into the next.
        ok = inner == 0
        if n > 1:
            ok |= (inner == 1) & (space[:m] | space[n - 1 :])
        own = word[:m] + 0
        if n > 1:
            ends = space[n - 1 :] & ok & ~space[:m]
            own = np.where(ends, word[n - 1 :] - 1, own)
        slots.append((mixed(h[ok]) % np.uint64(SLOTS)).astype(np.int64))
        owners.append(own[ok])
    return np.concatenate(slots), np.concatenate(owners)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of every slot in each) from all rows of ``labelled``
    (lang, text); no languages without rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lowered_words(text) if text else []
                if words:
                    table = tables.setdefault(lang, np.zeros(SLOTS, np.int64))
                    np.add(table, np.bincount(word_slots(words)[0], minlength=SLOTS), out=table)
        for lang, table in tables.items():
            slot = np.flatnonzero(table)
            yield pa.record_batch(
                [pa.array([lang] * len(slot)), pa.array(slot), pa.array(table[slot])], ["lang", "slot", "c"]
            )

    counted = labelled.mapInArrow(count, "lang string, slot bigint, c bigint")
    counts = materialize(counted.groupBy("lang", "slot").agg(F.sum("c").alias("c")), "lang-counts")
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: group them before training")
    # At most one row per language and slot.
    rows = counts.toPandas()
    table = np.zeros((len(names), SLOTS))
    table[np.searchsorted(names, rows["lang"].to_numpy(str)), rows["slot"].to_numpy()] = rows["c"].to_numpy()
    table += 0.5
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def proportions(likelihood: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns by expectation-maximisation, and the log-likelihood.

    ``likelihood`` has a row per distinct word, scaled so that each row's best is 1.
    """
    p = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        joint = likelihood * p
        whole = joint.sum(axis=1)
        new = (weight / whole) @ joint / total
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return p, float(weight @ np.log(np.maximum(likelihood @ p, 1e-300)))


def infer(log_p: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of all languages: 0 for those the penalised likelihood leaves out."""
    likelihood = np.exp(log_p - log_p.max(axis=1, keepdims=True)) + 1e-12
    kept = list(range(log_p.shape[1]))
    p, best = proportions(likelihood, weight)
    cost = penalty * np.log1p(weight.sum())
    while len(kept) > 1:
        weakest = int(np.argmin(p))
        fewer = kept[:weakest] + kept[weakest + 1 :]
        q, fit = proportions(likelihood[:, fewer], weight)
        if best - fit > cost:
            break
        kept, p, best = fewer, q, fit
    out = np.zeros(log_p.shape[1])
    out[kept] = p
    return out


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, penalty: float):
        self.languages, self.table, self.penalty = languages, table, penalty

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of a text with their proportions, largest first; none without a letter."""
        words = lowered_words(text) if text else []
        if not words or not self.languages:
            return []
        distinct: dict[str, int] = {}
        for w in words:
            distinct[w] = distinct.get(w, 0) + 1
        slots, owner = word_slots(list(distinct))
        log_p = np.zeros((len(distinct), len(self.languages)))
        values = self.table[:, slots]
        for k in range(len(self.languages)):
            log_p[:, k] = np.bincount(owner, values[k], len(distinct))
        p = infer(log_p, np.fromiter(distinct.values(), np.float64, len(distinct)), self.penalty)
        order = np.argsort(-p, kind="stable")
        return [(self.languages[i], float(p[i])) for i in order if p[i] > 0]


def identify(
    docs: DataFrame,
    learn: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    penalty: float = PENALTY,
) -> DataFrame:
    """doc_id, lang_pred, score and languages (all of the mixture with their proportions).

    ``learn`` (text, lang) is what the models are learned from; nothing but the text of
    ``docs`` decides a prediction.  A text that is null or without a letter is ``und`` with
    score 0, and so is every text if nothing could be learned.  Rows of ``learn`` with a null
    language teach nothing.  Repeated rows get a row each; other columns are ignored.
    """
    rows = learn.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    names, table = train(rows)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value, penalty)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [model.mixture(x) for x in batch.column(1).to_pylist()]
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array([m[0][0] if m else UNKNOWN for m in found], pa.string()),
                        pa.array([min(1.0, m[0][1]) if m else 0.0 for m in found], pa.float64()),
                        pa.array([[{"lang": a, "share": b} for a, b in m] for m in found], LANGUAGES),
                    ],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    schema = "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
