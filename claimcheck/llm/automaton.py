"""Language-model scores from a weighted backoff automaton that is trained on the corpus.

States are contexts seen in training (n-grams of up to ``order - 1`` tokens).  A state has an
arc for each token seen after it, weighted ``(c(h w) + m P(w | h')) / (c(h) + m)``, and a
failure arc to the state of the shorter context h', weighted ``m / (c(h) + m)``; the state of
the empty context has an arc for every token, the smoothed unigram.  The weights of a state
sum to one.  A text is read once from left to right: from each state either the arc of the
next token is taken or failure arcs are followed until a state has it.

Counts are too many to hold in one place, so they never are: the corpus is stored in blocks of
tokens, every block asks for the counts of the n-grams it holds, and one shuffle of packed,
sorted keys both adds up the counts and answers the blocks.  From the answers each block builds
the part of the automaton that its own texts can reach, and walks it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import crc_mod, mixed, steps, stored, table, words_of

ORDER = 2
#: Weight of the shorter context in a state, in tokens.
MASS = 500.0
#: A block is closed at about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 6_000_000
#: Fewer texts of a block than this are read one by one, not a step of all at once.
FEW = 24
#: Keys that one task adds up.
PART_KEYS = 3_000_000
FOLDS, HELD_FOLD = 5, 1
#: Stand for the end and the begin of a text; no word hashes are made from them.
_END, _BEGIN = np.uint64(1), np.uint64(2)

_CELLS = ("ids", "marks", "offsets", "codes", "hashes")
_BLOCK = "block long, " + ", ".join(f"{c} binary" for c in _CELLS)
_HELD, _NAMELESS = 1, 2


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their low bytes together, then the next ones."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return raw.dtype.str.encode() + b" " + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    kind, _, body = bytes(data).partition(b" ")
    dtype = np.dtype(kind.decode())
    flat = np.frombuffer(zstandard.decompress(body), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _hash(word: str) -> int:
    """The hash of a word whose A-Z count as lower case."""
    return max(3, xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass").lower(), 42))


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, held, text`` as blocks of coded words: whole rows, a word list in each block."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", BLOCK_CHARS):
            words, codes, offsets = words_of(batch.column("text"))
            ids = batch.column("doc_id")
            marks = batch.column("held").to_numpy(zero_copy_only=False) * _HELD
            marks = marks + ids.is_null().to_numpy(zero_copy_only=False) * _NAMELESS
            cells = [
                ids.fill_null(0).to_numpy(),
                marks.astype(np.uint8),
                offsets,
                codes.astype(np.uint32),
                np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words)),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(0, 1), *(pa.array([_packed(c)], pa.binary()) for c in cells)],
                ["block", *_CELLS],
            )

    rows = docs.select("doc_id", "held", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(code, _BLOCK)


class Block:
    """A block's tokens (every text's words and its end) and the keys of its n-grams."""

    def __init__(self, row: dict, order: int):
        self.ids, marks, offsets, codes, hashes = (_unpacked(row[c]) for c in _CELLS)
        self.nameless, self.learnt = marks & _NAMELESS > 0, marks & _HELD == 0
        self.sizes = np.diff(offsets) + 1
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(self.ids)), self.sizes)
        token = np.append(hashes, _END)[np.insert(codes.astype(np.int64), offsets[1:], len(hashes))]
        #: How many tokens of the same text stand before each token.
        self.place = np.arange(len(token)) - np.repeat(self.firsts, self.sizes)
        gram = mixed(token)
        self.keys = [gram | np.uint64(1)]  # odd keys are single tokens
        for k in range(2, order + 1):
            back = np.full(len(token), _BEGIN)
            inside = np.flatnonzero(self.place >= k - 1)
            back[inside] = token[inside - (k - 1)]
            back[self.place < k - 2] = 0  # before the begin there is nothing
            gram = mixed(gram, back)
            self.keys.append(gram & ~np.uint64(1))

    def asked(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The sorted distinct keys, their counts in the block's training texts, and the place
        of each token's key of each order among them."""
        every = np.concatenate(self.keys)
        distinct, inverse = np.unique(every, return_inverse=True)
        learn = np.tile(self.learnt[self.text], len(self.keys))
        counts = np.bincount(inverse[learn], minlength=len(distinct)).astype(np.uint32)
        return distinct, counts, np.split(inverse, len(self.keys))

    def read(
        self, places: list[np.ndarray], counts: np.ndarray, n: int, texts: int, words: int, mass: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base score, score and known tokens of each text: one walk of the automaton over each."""
        automaton = Automaton(self, places, counts, n, texts, words, mass)
        base = np.add.reduceat(automaton.unigram[places[0]], self.firsts)
        known = np.add.reduceat((counts[places[0]] > 0).astype(np.int64), self.firsts)
        return base, automaton.walk(places[0], self.firsts, self.sizes), known


class Automaton:
    """The states and arcs that the texts of a block can reach, weighted by the corpus's counts.

    A state is the number of its context among the block's distinct n-grams; ``empty`` and
    ``begin`` follow them.  Arcs are sorted by state and token.  An n-gram that training has not
    seen is neither a state nor an arc, but for the arcs of the empty context, which has every
    token.  All weights are kept as logarithms to base 10.
    """

    def __init__(
        self, block: Block, places: list[np.ndarray], counts: np.ndarray, n: int, texts: int, words: int, mass: float
    ):
        order = len(places)
        self.empty, self.begin, self.width = len(counts), len(counts) + 1, len(counts) + 2
        self.first = self.begin if order > 1 else self.empty
        weight = (counts + 0.5) / (n + 0.5 * (words + 1))  # of tokens; longer n-grams follow
        self.unigram = np.log10(weight)
        grams = np.arange(len(counts))
        self.after = np.where((counts > 0) & (order > 1), grams, self.empty)
        total = np.append(counts, [0.0, texts])
        self.failure = np.full(self.width, self.empty)
        states, tokens, weights, nexts = [], [], [], []
        for k in range(2, order + 1):
            inside = np.flatnonzero(block.place >= k - 2)
            found, at = np.unique(places[k - 1][inside], return_index=True)
            at = inside[at]
            if k < order:
                self.failure[found] = places[k - 2][at]
            found, at = found[counts[found] > 0], at[counts[found] > 0]
            state = np.where(block.place[at] > 0, places[k - 2][at - 1], self.begin)
            weight[found] = (counts[found] + mass * weight[places[k - 2][at]]) / (total[state] + mass)
            states.append(state)
            tokens.append(places[0][at])
            weights.append(np.log10(weight[found]))
            nexts.append(found if k < order else places[k - 2][at])
        self.failing = np.log10(mass / (total + mass))
        none = [np.zeros(0, dtype=np.int64)]
        state, token = np.concatenate(states or none), np.concatenate(tokens or none)
        sort = np.argsort(state * self.width + token)
        self.arcs = (state * self.width + token)[sort]
        self.weights = np.concatenate(weights or [np.zeros(0)])[sort]
        self.nexts = np.concatenate(nexts or none)[sort].astype(np.int64)

    def walk(self, tokens: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log-probability of each text, read once from left to right.

        All texts take a step together, the longest first, so those that still go on are in
        front; the last few go on alone.
        """
        by_size = np.argsort(-sizes, kind="stable")
        going = np.searchsorted(-sizes[by_size], -np.arange(sizes.max(initial=0)), side="left")
        places = firsts[by_size]
        state, score = np.full(len(sizes), self.first), np.zeros(len(sizes))
        step = 0
        while step < len(going) and going[step] >= FEW:
            k = going[step]
            state[:k], gained = self._step(state[:k], tokens[places[:k] + step])
            score[:k] += gained
            step += 1
        if step < len(going):
            begins = memoryview(np.searchsorted(self.arcs, np.arange(self.width + 1) * self.width))
            for k in range(going[step]):
                rest = tokens[places[k] + step : places[k] + sizes[by_size[k]]]
                score[k] += self._alone(int(state[k]), rest, begins)
        out = np.empty(len(sizes))
        out[by_size] = score
        return out

    def _step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and what the step adds, failure arcs included."""
        gained = np.zeros(len(state))
        reached = np.empty(len(state), dtype=np.int64)
        left = np.arange(len(state))
        while len(left):
            last = state == self.empty
            done = left[last]
            gained[done] += self.unigram[token[last]]
            reached[done] = self.after[token[last]]
            left, state, token = left[~last], state[~last], token[~last]
            if not len(left):
                break
            wanted = state * self.width + token
            at = np.minimum(np.searchsorted(self.arcs, wanted), max(0, len(self.arcs) - 1))
            has = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(left), dtype=bool)
            gained[left[has]] += self.weights[at[has]]
            reached[left[has]] = self.nexts[at[has]]
            left, state, token = left[~has], state[~has], token[~has]
            gained[left] += self.failing[state]
            state = self.failure[state]
        return reached, gained

    def _alone(self, state: int, tokens: np.ndarray, begins: memoryview) -> float:
        """The same walk for one text."""
        arcs, nexts, weights = memoryview(self.arcs), memoryview(self.nexts), memoryview(self.weights)
        failure, failing = memoryview(self.failure), memoryview(self.failing)
        unigram, after = memoryview(self.unigram), memoryview(self.after)
        score, empty, width = 0.0, self.empty, self.width
        for token in tokens.tolist():
            while state != empty:
                wanted, stop = state * width + token, begins[state + 1]
                at = bisect_left(arcs, wanted, begins[state], stop)
                if at < stop and arcs[at] == wanted:
                    score += weights[at]
                    state = nexts[at]
                    break
                score += failing[state]
                state = failure[state]
            else:
                score += unigram[token]
                state = after[token]
        return score


def scores(docs: DataFrame, order: int = ORDER, mass: float = MASS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``docs`` has ``doc_id``, ``held`` (true: not learnt from; null: learnt from) and ``text``
    (null: empty; an empty text is its end token).  Other columns are not read.  Every text is
    read whole and counts cover all training texts, repeats and copies as often as they stand.
    Rows that share an id, or have none, are scored each on its own.  Without training texts
    every token is unknown; an empty table gives an empty one.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("held", F.lit(False)).alias("held"), F.col("text").cast("string")
    )
    coded = stored(blocks(rows), "blocks")
    size = coded.mapInArrow(_sizes, "learnt long, texts long, tokens long").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("learnt", "texts", "tokens"))
    )
    learnt, texts, tokens = size.first()
    parts = max(1, -(-tokens * order // PART_KEYS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            keys, counts, _ = Block(row, order).asked()
            cuts = np.searchsorted(keys, _bounds(parts))
            own = np.flatnonzero(np.diff(cuts))
            spans = list(zip(cuts[own], cuts[own + 1], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(own), row["block"])),
                    pa.array(own.astype(np.int32)),
                    pa.array([_packed_keys(keys[a:b]) for a, b in spans], pa.binary()),
                    pa.array([_packed(counts[a:b]) for a, b in spans], pa.binary()),
                ],
                ["block", "part", "keys", "counts"],
            )

    asked = coded.mapInArrow(ask, "block long, part int, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "block long, part int, counts binary, words long")
    answers = stored(answers, "answers")
    words = answers.groupBy("part").agg(F.max("words").alias("w")).agg(F.sum("w")).first()[0] or 0
    per_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("counts"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, order)
            _, _, places = block.asked()
            counts = np.concatenate([_unpacked(x["counts"]) for x in row["counts"]]).astype(float)
            base, score, known = block.read(places, counts, learnt, texts, words, mass)
            every = np.full(len(block.ids), learnt)
            ids = pa.array(block.ids, mask=block.nameless)
            columns = [ids, ~block.learnt, block.sizes, known, every, base, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _RESULT)

    kinds = ("long", "boolean", "long", "long", "long", "double", "double")
    schema = ", ".join(f"{n} {k}" for n, k in zip(_RESULT, kinds, strict=True))
    return coded.join(per_block, "block").mapInArrow(walk, schema)


_RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        learnt = _unpacked(row["marks"]) & _HELD == 0
        sizes = np.diff(_unpacked(row["offsets"])) + 1
        cells = [sizes[learnt].sum(), learnt.sum(), sizes.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(c)]) for c in cells], ["learnt", "texts", "tokens"])


def _bounds(parts: int) -> np.ndarray:
    """Even cuts of the range of keys."""
    width = (1 << 64) // parts
    return np.array([k * width for k in range(parts)] + [(1 << 64) - 1], dtype=np.uint64)


def _answer(group: pa.Table) -> pa.Table:
    """Add up a part's counts and answer each block with the totals of the keys it asked for.

    The number of parts follows the number of tokens, and a block asks once for a key, so a
    frequent n-gram is one entry of each block and a part is no larger for it.
    """
    keys = [_unpacked_keys(x.as_py()) for x in group.column("keys")]
    counts = [_unpacked(x.as_py()) for x in group.column("counts")]
    sizes = [len(k) for k in keys]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    answered = totals[inverse]
    cuts = np.cumsum(sizes)[:-1]
    cells = [_packed(x) for x in np.split(answered, cuts)]
    words = int(((distinct & np.uint64(1) == 1) & (totals > 0)).sum())
    return pa.table(
        {
            "block": group.column("block"),
            "part": group.column("part"),
            "counts": pa.array(cells, pa.binary()),
            "words": pa.array(np.full(len(sizes), words), pa.int64()),
        }
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs.withColumn("held", crc_mod("doc_id", FOLDS) == HELD_FOLD))
