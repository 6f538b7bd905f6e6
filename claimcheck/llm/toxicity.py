"""Toxicity of texts whose words may be disguised: restore the words, then score them.

A disguised word is what a writer's intended word became in a noisy channel: letters turned
into look-alike digits and signs, letters set apart, letters repeated.  The lattice of the
letters each character may stand for is decoded by Viterbi under a character language model
of the corpus.  A linear model over pieces of the restored words gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import crc_mod, steps, stored, table, words_of

FOLDS, HELD_FOLD = 5, 0
#: Labelled rows that the classifier is fitted on, at most so many of each class, in order of
#: a hash of their ids.  Scores cover all rows, counts of the language model the whole corpus.
SAMPLE_ROWS = 4000
#: Pieces of words in the model; documents of the toxic sample that must hold one.
PIECES, LEAST_DOCS = 400, 5
PIECE_SIZES = (4, 5)
THRESHOLD = 0.5

# The letters that a digit or sign stands for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "li", "€": "e", "¡": "i", "£": "l", "¢": "c",
}
#: Characters that are counted at once, and words that a channel remembers.
SPAN_CHARS, KNOWN_WORDS = 1 << 18, 50_000
#: Log probability that the channel writes a letter as a look-alike, and that it repeats one.
DISGUISED, REPEATED = math.log(0.05), math.log(0.02)

# The alphabet of the language model: the edge of a word, a to z, any other letter.
_SIZE = 28
_EDGE, _OTHER = 0, 27
_SEPARATORS = ".-_*·"
_APART = re.compile(rf"[^\W\d_](?:[{re.escape(_SEPARATORS)}]+[^\W_]){{2,}}[{re.escape(_SEPARATORS)}]*", re.I)
_SIGNS = "".join(LOOK_ALIKES)
_LETTER, _SIGN = re.compile(r"[^\W\d_]"), re.compile(f"[{re.escape(_SIGNS)}]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_BREAK = re.compile("\n")


def _symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return _OTHER if char.isalpha() else _EDGE


_SYMBOLS = np.array([_symbol(chr(c).lower()) if len(chr(c).lower()) == 1 else _OTHER for c in range(0x300)], dtype=np.int64)


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SIZE**3, dtype=np.int64)
    for batch in steps(batches, "text"):
        text = " ".join(x or "" for x in batch.column("text").to_pylist())
        text = f" {text} "
        # In spans, each after the last two symbols before it, as several numbers stand for a character.
        last = np.zeros(0, dtype=np.int64)
        for at in range(0, len(text), SPAN_CHARS):
            code = np.frombuffer(text[at : at + SPAN_CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            symbol = np.where(code < len(_SYMBOLS), _SYMBOLS[np.minimum(code, len(_SYMBOLS) - 1)], _OTHER)
            symbol = np.concatenate([last, symbol])
            # Edges in a row are one edge.
            symbol = symbol[np.concatenate([[True], (symbol[1:] != _EDGE) | (symbol[:-1] != _EDGE)])]
            if len(symbol) > 2:
                gram = (symbol[:-2] * _SIZE + symbol[1:-1]) * _SIZE + symbol[2:]
                counts += np.bincount(gram, minlength=_SIZE**3)
            last = symbol[-2:]
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])


def char_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a character after two others, from all texts of ``docs``.

    The table has 28 x 28 x 28 cells whatever the corpus, so it may come to the driver.
    """
    rows = docs.select("text").mapInArrow(_char_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE**3)
    for gram, n in rows.collect():
        counts[gram] = n
    counts = counts.reshape(_SIZE, _SIZE, _SIZE)
    two = counts.sum(axis=0) + 0.1
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + 5.0 * two[None, :, :]
    return np.log(three / three.sum(axis=2, keepdims=True))


class Channel:
    """Decodes single words under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        # Words seen; no cache that holds the channel too, which would outlive its task.
        self.known: dict[str, str] = {}

    def _lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each place of the word, the letters that may have been meant (or nothing), with costs."""
        out: list[list[tuple[str, float]]] = []
        k = 0
        while k < len(word):
            char, end = word[k], k + 1
            while end < len(word) and word[end] == char:
                end += 1
            run = end - k
            if char in _SEPARATORS:
                out.append([("", 0.0)])
            elif char in LOOK_ALIKES:
                out += [[(x, DISGUISED) for x in LOOK_ALIKES[char]]] * min(run, 2)
            elif run > 2 and char.isalpha():
                out.append([(char, REPEATED), (char * 2, REPEATED)])
            else:
                out += [[(char, 0.0)]] * run
            k = end
        return out

    def decode(self, word: str) -> str:
        """The likeliest intended letters of a word (Viterbi; a state is the last two symbols)."""
        model = self.model
        states: dict[tuple[int, int], tuple[float, tuple]] = {(_EDGE, _EDGE): (0.0, ())}
        for options in self._lattice(word):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, channel in options:
                    x, y, total = a, b, cost + channel
                    for letter in letters:
                        z = _symbol(letter)
                        total += model[x][y][z]
                        x, y = y, z
                    # The path is a chain of pairs, so a long word costs no copies.
                    if (x, y) not in new or new[x, y][0] < total:
                        new[x, y] = (total, (path, letters))
            states = new
        closing = {s: (c + model[s[0]][s[1]][_EDGE], p) for s, (c, p) in states.items()}
        path = max(closing.values(), key=lambda x: x[0])[1]
        letters = []
        while path:
            path, last = path
            letters.append(last)
        return "".join(reversed(letters))

    def word(self, word: str) -> str:
        """``_word``, remembered."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = self._word(word)
        return found

    def _word(self, word: str) -> str:
        """A word in lower case, without signs around it, and decoded if it looks disguised."""
        low = word.lower()
        core = low.strip("".join(c for c in set(low) if not (c.isalnum() or c in "@$€£¢¡+|!")))
        core = core.rstrip("".join(c for c in set(core) if not c.isalnum())) or core
        core = re.sub(r"^([^\w])\1+", "", core)
        if _APART.fullmatch(core) or _RUN.search(core) or (len(core) > 2 and _LETTER.search(core) and _SIGN.search(core) and not core[:2].isdigit()):
            return self.decode(core)
        return core

    def words(self, words: list[str]) -> list[str]:
        """Many words; those of letters alone, or before stops, are only lower-cased."""
        low = "\n".join(words).lower()
        out = [w.rstrip(".,;:!?") for w in low.split("\n")] if words else []
        if len(out) != len(words):
            return [self.word(w) for w in words]
        again = {k for k, w in enumerate(out) if not w.isalpha()}
        places = [m.start() for m in _RUN.finditer(low)]
        if places:
            breaks = np.array([m.start() for m in _BREAK.finditer(low)], dtype=np.int64)
            again.update(np.searchsorted(breaks, places).tolist())
        for k in again:
            out[k] = self.word(words[k])
        return out

    def text(self, text: str) -> str:
        """A whole text with its words restored; letters set apart by spaces become one word."""
        out: list[str] = []
        apart: list[str] = []
        for raw in text.split():
            word = self.word(raw)
            if len(word) == 1 and word.isalnum():
                apart.append(word)
                continue
            out += self._joined(apart)
            apart = []
            out.append(word)
        return " ".join(out + self._joined(apart))

    def _joined(self, apart: list[str]) -> list[str]:
        """Single letters in a row: from the fourth on they are one word set apart."""
        return [self.joined(apart)] if len(apart) > 3 and len(set(apart)) > 1 else apart

    def joined(self, letters: list[str]) -> str:
        return self.decode("".join(letters))


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, restored``: every whole text with its words restored (null: empty)."""

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(model)
        for batch in batches:
            texts = [channel.text(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(restore, "doc_id long, restored string")


def _word_lists(batch: pa.RecordBatch, channel: Channel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Restored words of a batch, and the row and word of each token; words set apart come last."""
    words, codes, offsets = words_of(batch.column("text"))
    clean = channel.words(words)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    single = np.fromiter((len(w) == 1 and w.isalnum() for w in clean), dtype=bool, count=len(clean))
    one = single[codes] if len(codes) else np.zeros(0, dtype=bool)
    if not one.any():
        return clean, rows, codes
    same = one[1:] & one[:-1] & (rows[1:] == rows[:-1])
    starts = np.flatnonzero(one & ~np.concatenate([[False], same]))
    ends = np.flatnonzero(one & ~np.concatenate([same, [False]])) + 1
    long = ends - starts > 3
    more_row, more = [], []
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        letters = [clean[k] for k in codes[a:b]]
        if len(set(letters)) > 1:
            more_row.append(rows[a])
            more.append(channel.joined(letters))
    codes = np.concatenate([codes, len(clean) + np.arange(len(more))])
    rows = np.concatenate([rows, np.array(more_row, dtype=np.int64)])
    return clean + more, rows, codes


def _pieces(word: str) -> set[str]:
    marked = f"\n{word}\n"
    if len(word) < min(PIECE_SIZES) - 1:
        return {marked}
    return {marked[i : i + n] for n in PIECE_SIZES for i in range(len(marked) - n + 1)}


@dataclass(frozen=True)
class ToxicityModel:
    """All of these are bounded by parameters, so every task may hold them."""

    chars: np.ndarray
    pieces: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def _finder(pieces: tuple[str, ...]) -> ahocorasick.Automaton | None:
    finder = ahocorasick.Automaton()
    for k, piece in enumerate(pieces):
        finder.add_word(piece, (k, len(piece)))
    if not pieces:
        return None
    finder.make_automaton()
    return finder


def _found(batch: pa.RecordBatch, channel: Channel, finder) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, piece) pairs of a batch."""
    clean, row, word = _word_lists(batch, channel)
    if finder is None or not clean:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "\n" + "\n".join(clean) + "\n"
    starts = np.cumsum([0, *(len(w) + 1 for w in clean)])
    hits = [(end, k, n) for end, (k, n) in finder.iter(text)]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, piece, size = np.array(hits, dtype=np.int64).T
    # Place 0 is the first edge; the word that a piece lies in is the one its second place is in.
    owner = np.minimum(np.searchsorted(starts, end - size + 1, side="right") - 1, len(clean) - 1)
    hit = np.zeros(len(clean), dtype=bool)
    hit[owner] = True
    tokens = np.flatnonzero(hit[word])
    held = np.unique(row[tokens] * np.int64(len(clean)) + word[tokens])
    row, word = np.divmod(held, len(clean))
    order = np.argsort(owner, kind="stable")
    owner, piece = owner[order], piece[order]
    a, b = np.searchsorted(owner, word), np.searchsorted(owner, word, side="right")
    pieces = np.concatenate([piece[x:y] for x, y in zip(a, b, strict=True)])
    pairs = np.unique(np.repeat(row, b - a) * len(finder) + pieces)
    return np.divmod(pairs, len(finder))


def _counted(chars: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(chars)
        for batch in steps(batches, "text", 500_000):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            clean, row, word = _word_lists(batch, channel)
            known: dict[str, int] = {}
            cut = [[known.setdefault(x, len(known)) for x in _pieces(w)] if w else [] for w in clean]
            if not known:
                continue
            sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
            flat = np.fromiter((x for c in cut for x in c), dtype=np.int64, count=int(sizes.sum()))
            begin = np.cumsum(sizes) - sizes
            row, word = np.divmod(np.unique(row * np.int64(len(clean)) + word), len(clean))
            own = sizes[word]
            place = np.repeat(begin[word] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            row, piece = np.divmod(np.unique(np.repeat(row, own) * len(known) + flat[place]), len(known))
            sums = [np.bincount(piece[toxic[row] == k], minlength=len(known)) for k in (False, True)]
            columns = [pa.array(list(known), pa.string()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "clean", "toxic"])

    return count


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on labelled rows; ``labels`` has ``doc_id, toxic`` (null: no label, repeats: the largest).

    The sample holds at most ``sample`` rows of each class, by the smallest hash of the id; the
    bias is set to the share of toxic rows among all labelled ones.  Without both classes the
    model has no pieces and gives the smoothed share.
    """
    chars = char_model(docs)
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    marked = marked.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    picked = [
        marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)
    ]
    picked = stored(picked[0].union(picked[1]), "labelled")
    rows = stored(docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "toxic"), "sample")
    prior = math.log((share[1] + 1) / (share[0] + 1))
    if not (share[0] and share[1]):
        return ToxicityModel(chars, (), (), prior)
    counts = rows.mapInArrow(_counted(chars), "piece string, clean long, toxic long").groupBy("piece")
    counts = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("t") >= LEAST_DOCS)
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    p, q = (F.col("t") + 0.5) / (bad + 1.0), (F.col("c") + 0.5) / (good + 1.0)
    # Evidence: by how much the share among toxic rows is larger, in its own spread.
    evidence = (F.log(p) - F.log(q)) * F.sqrt("t")
    best = counts.where(F.log(p) - F.log(q) > 1.0).orderBy(evidence.desc(), "piece").limit(PIECES)
    pieces = tuple(r["piece"] for r in best.select("piece").collect())
    finder_of, chars_of = pieces, chars

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, finder = Channel(chars_of), _finder(finder_of)
        for batch in steps(batches, "text", 1_000_000):
            row, piece = _found(batch, channel, finder)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = [piece[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(own, pa.list_(pa.int64()))], ["toxic", "pieces"]
            )

    # At most 2 x sample rows of at most PIECES numbers.
    fitted = rows.mapInArrow(features, "toxic int, pieces array<long>").collect()
    x = np.zeros((len(fitted), len(pieces)))
    for k, r in enumerate(fitted):
        x[k, r["pieces"]] = 1
    y = np.array([r["toxic"] for r in fitted], dtype=float)
    weights, bias = _logistic(x, y)
    return ToxicityModel(chars, pieces, tuple(weights), bias + prior - math.log((bad + 1) / (good + 1)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps; the ridge keeps pieces that stand together small."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.full(a.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + keep * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the probability that its whole text is toxic.

    Null and empty texts have the score of a text without any piece.  Repeated rows and rows
    without an id are scored each on its own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, finder = Channel(model.chars), _finder(model.pieces)
        weights = np.array(model.weights)
        for batch in steps(batches, "text"):
            row, piece = _found(batch, channel, finder)
            total = np.full(batch.num_rows, model.bias)
            np.add.at(total, row, weights[piece] if len(piece) else 0.0)
            values = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(key, FOLDS) == HELD_FOLD, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of these documents and the shipped labels, without the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return train(docs, labels)


def accepted(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns kept.

    Rows are decided by their texts, so rows of one id may be decided differently.
    """

    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        channel, finder = Channel(model.chars), _finder(model.pieces)
        weights, bar = np.array(model.weights), math.log(threshold / (1 - threshold))
        for column in columns:
            out = [pa.array([], pa.bool_())]
            for batch in steps(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", 1_000_000):
                row, piece = _found(batch, channel, finder)
                total = np.full(batch.num_rows, model.bias)
                np.add.at(total, row, weights[piece] if len(piece) else 0.0)
                out.append(pa.array(total < bar))
            yield pa.concat_arrays(out)

    # Only texts go to Python and only verdicts come back.
    return docs.where(clean(F.col("text").cast("string")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
