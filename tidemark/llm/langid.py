"""Language identification by interpolated Kneser-Ney character models.

A text's words (runs of letters, small) are scored character by character with each
language's model of order four; words do not see each other, so a word is scored once
a worker and its score reused. All languages share sorted arrays of 64-bit n-gram
hashes, one an order, with a row of log probabilities (one a language) at each place;
contexts have such arrays for their back-off weights. The language of the lowest
cross-entropy a character wins.

Calibration, on sampled texts that no model has seen, sets the temperature of the
confidence and, for each language, the cross-entropy above which a text is unlike
anything learned: it keeps its best guess, is marked ``rejected`` and its score sinks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import discard, remainder, streamed, written

ORDER = 4
START, END = 2, 3
UNKNOWN = "und"
#: The bound of what is learned from: rows of each language.
ROWS = 600
#: One in so many sampled rows calibrates and is not learned from.
CALIBRATE = 3
REJECTED = 0.995
#: Scored words remembered by a worker.
REMEMBERED = 400_000
LETTERS = regex.compile(r"\p{L}+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words as one line of code points, each after ORDER - 1 starts and before an end; and the places predicted."""
    line = "".join(chr(START) * (ORDER - 1) + w + chr(END) for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.nonzero(codes != START)[0]


def _grams(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order`` symbols that end at each place (not counting back from an end of order 0)."""
    h = np.full(len(at), order, np.uint64)
    for k in range(order - 1, -1, -1):
        h = (h ^ codes[at - k]) * MIX
        h ^= h >> np.uint64(29)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """languages; for each order the sorted n-gram hashes with log probabilities, and context hashes with log back-off weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    heat: float = 1.0
    limits: np.ndarray | None = None

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and the symbols it has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes, at = _symbols(words)
        total = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            keys, values = self.grams[order - 1]
            where, there = _find(keys, _grams(codes, at[left], order))
            total[left[there]] += values[where[there]]
            left = left[~there]
            if not len(left):
                break
            if order > 1:
                keys, weights = self.contexts[order - 1]
                where, there = _find(keys, _grams(codes, at[left] - 1, order - 1))
                total[left[there]] += weights[where[there]]
            else:
                # A symbol that no language has: what the empty context leaves, evenly.
                total[left] += self.floor + self.contexts[0][1][0]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        return np.add.reduceat(total.astype(np.float64), starts) if len(words) else total.astype(float), lengths


def _counted(words: list[str], counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each order: the n-grams with their counts (below the top order: of different symbols before them), and by context totals and kinds."""
    codes, at = _symbols(words)
    times = np.repeat(counts, np.fromiter(map(len, words), np.int64, len(words)) + 1)
    found = []
    for order in range(1, ORDER + 1):
        own = _grams(codes, at, order)
        if order == ORDER:
            keys, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            c = np.bincount(inverse, times).astype(float)
        else:
            _, kinds = np.unique(_grams(codes, at, order + 1), return_index=True)
            keys, inverse = np.unique(own[kinds], return_inverse=True)
            c = np.bincount(inverse).astype(float)
            first = kinds[np.unique(inverse, return_index=True)[1]]
        context = _grams(codes, at[first] - 1, order - 1) if order > 1 else np.zeros(len(keys), np.uint64)
        shorter = _grams(codes, at[first], order - 1) if order > 1 else context
        names, inverse = np.unique(context, return_inverse=True)
        one, two = (c == 1).sum(), (c == 2).sum()
        discount = one / (one + 2 * two) if one and two else 0.75
        whole, kinds = np.bincount(inverse, c), np.bincount(inverse)
        found.append({
            "keys": keys, "context": context, "shorter": shorter, "names": names,
            "own": np.maximum(c - discount, 0) / whole[inverse], "weight": discount * kinds / whole,
        })
    return found


def train(counts: dict[str, tuple[list[str], np.ndarray]]) -> Model:
    """Models of the languages from their words and how often each occurs."""
    languages = sorted(counts)
    tables = [_counted(*counts[x]) for x in languages]
    symbols = len(np.unique(np.concatenate([t[0]["keys"] for t in tables]))) if tables else 0
    floor = -float(np.log(symbols + 1))
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([t[order - 1]["keys"] for t in tables]), return_index=True)
        of = lambda what: np.concatenate([t[order - 1][what] for t in tables])[first]  # noqa: B023, E731
        context, shorter = of("context"), of("shorter")
        names = np.unique(context)
        weights = np.ones((len(names), len(languages)))
        values = np.zeros((len(keys), len(languages)))
        for k, t in enumerate(tables):
            own = t[order - 1]
            weights[_find(names, own["names"])[0], k] = own["weight"]
            values[_find(keys, own["keys"])[0], k] = own["own"]
        if order == 1:
            below = np.full((len(keys), len(languages)), np.exp(floor))
        else:
            where, there = _find(grams[-1][0], shorter)
            assert there.all()
            below = np.exp(grams[-1][1][where])
        values += weights[_find(names, context)[0]] * below
        grams.append((keys, np.log(values)))
        contexts.append((names, np.log(weights)))
    narrow = lambda pairs: [(k, v.astype(np.float32)) for k, v in pairs]
    return Model(languages, narrow(grams), narrow(contexts), floor)


class Memory(dict):
    """Words to their places in ``rows``; new words wait in ``new`` until they are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.rows = np.zeros((1 << 14, len(model.languages) + 1))  # log probabilities, then symbols

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def settle(self) -> None:
        """Scores the new words."""
        if not self.new:
            return
        if len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self), self.rows.shape[1]))])
        at = slice(len(self) - len(self.new), len(self))
        self.rows[at, :-1], self.rows[at, -1] = self.model.score(self.new)
        self.new = []

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its symbols (0: no letter)."""
        if len(self) > REMEMBERED:
            self.__init__(self.model)
            self.clear()
        sums = np.zeros((len(texts), len(self.model.languages) + 1))
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def add() -> None:
            self.settle()
            for k, places in waiting:
                sums[k] += self.rows[places].sum(0)
            waiting.clear()

        for k, text in enumerate(texts):
            for part in _parts(text):
                places = np.array([*map(self.__getitem__, LETTERS.findall(part))], np.int64)
                if len(places):
                    waiting.append((k, places))
                    held += len(places)
                if held > 1 << 19:
                    add()
                    held = 0
        add()
        return sums[:, :-1], sums[:, -1].astype(np.int64)


def _parts(text: str | None, size: int = 1 << 20) -> Iterator[str]:
    """A text in small letters; a very long one in parts, cut where no word is."""
    text = (text or "").lower()
    while len(text) > size:
        cut = next((i for i in range(size, len(text)) if not text[i].isalpha()), len(text))
        yield text[:cut]
        text = text[cut:]
    yield text


def confidence(model: Model, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: best language, score, cross-entropy, rejected."""
    rows = np.arange(len(n))
    entropy = -total / np.maximum(n, 1)[:, None]
    best = entropy.argmin(1)
    apart = model.heat * (total - total.max(1, keepdims=True))
    share = 1 / np.exp(apart).sum(1)
    excess = np.maximum(entropy[rows, best] - model.limits[best], 0)
    return best, share * np.exp(-excess), entropy[rows, best], excess > 0


def sample(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Up to ``rows`` keys of each language, by hash: doc_id, text, lang, calibrates; of rows that share a key the least text.

    A language's keys are counted first; those whose hash cannot be among its first leave
    before the rest are ranked, so a task ranks about twice ``rows`` of a language, however many it has.
    """
    order = F.xxhash64("doc_id")
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = named.select("doc_id", "lang")
    # Hashes are spread evenly: this share of them holds 2 * rows + 100 of a language's keys, give or take a few hundredths.
    share = F.least(F.lit(1.0), F.lit(2.0 * rows + 100) / F.approx_count_distinct("doc_id", 0.02))
    # A row a language, as the model has a column for each; so the rest leave where they are read.
    shares = {r["lang"]: r["share"] for r in ids.groupBy("lang").agg(share.alias("share")).collect()}
    if not shares:
        return named.select("doc_id", "lang", "text", F.lit(False).alias("calibrates"))
    of = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("lang"))
    ids = ids.where((order / F.lit(2.0**64) + 0.5) <= of).distinct()
    line = Window.partitionBy("lang").orderBy(order, "doc_id")
    ids = ids.withColumn("n", F.row_number().over(line)).where(F.col("n") <= rows)
    # rows x languages keys: a proven bound.
    ids = F.broadcast(ids.select("doc_id", "lang", (F.col("n") % CALIBRATE == 0).alias("calibrates")))
    taken = named.select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"], "inner")
    return taken.groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.min("calibrates").alias("calibrates"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, words = [], []
        for text, lang in zip(batch.column(0), batch.column(1)):
            found = LETTERS.findall(text.as_py().lower())
            words += found
            langs += [lang.as_py()] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])


def fit(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """A calibrated model from the (doc_id, text, lang) of ``docs``; None if no row has a language and a letter."""
    taken = written(sample(docs, rows), "language-sample")
    counts = streamed(taken.where("NOT calibrates").select("text", "lang")).mapInArrow(_words, "lang string, word string")
    # Every word of the sampled rows counts: the rare ones set the discounts.
    learned = counts.groupBy("lang", "word").count().orderBy("lang", "word").toPandas()
    if learned.empty:
        discard(taken)
        return None
    model = train({x: ([*g["word"]], g["count"].to_numpy()) for x, g in learned.groupby("lang")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(model)
        for batch in batches:
            total, n = memory.texts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array([*total])], ["lang", "n", "total"])

    seen = streamed(taken.where("calibrates").select("text", "lang")).mapInArrow(run, "lang string, n long, total array<double>")
    seen = seen.where("n > 0").toPandas()
    discard(taken)
    seen = seen[seen["lang"].isin(model.languages)]
    model.limits = np.full(len(model.languages), np.inf)
    if len(seen):
        total, n = np.stack(seen["total"]), seen["n"].to_numpy()
        true = seen["lang"].map(model.languages.index).to_numpy()
        own = -total[np.arange(len(n)), true] / n
        for k in set(true):
            model.limits[k] = np.quantile(own[true == k], REJECTED)

        def loss(heat: float) -> float:
            apart = heat * (total - total.max(1, keepdims=True))
            chance = np.exp(apart[np.arange(len(n)), true]) / np.exp(apart).sum(1)
            return float(-np.log(np.maximum(chance, 1e-9)).mean())

        model.heat = min(np.geomspace(0.005, 1, 25), key=loss)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected for each row; the text alone decides.

    Null texts and texts without a letter are ``und`` with score 0. So is everything
    where no language was learned. Of languages with equal cross-entropies the first by
    name is taken. Repeated rows stay repeated; a null key stays; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ROWS
    frame = docs.select("doc_id", "text")
    schema = frame.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        memory = Memory(own) if own else None
        for batch in batches:
            if own:
                total, n = memory.texts(batch.column(1).to_pylist())
                best, score, entropy, rejected = confidence(own, total, n)
                names = np.where(n > 0, np.array(own.languages, object)[best], UNKNOWN)
                score, rejected = np.where(n > 0, score, 0.0), rejected | (n == 0)
            else:
                size = batch.num_rows
                names, score, entropy, rejected = [UNKNOWN] * size, np.zeros(size), np.zeros(size), np.ones(size, bool)
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return streamed(frame).mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learns from rows whose remainder by 4 is not 2, predicts every row; see ``identify`` for odd rows."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
