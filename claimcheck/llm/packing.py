"""Best-fit packing of tokenised documents under several capacities.

A document is its token ids and a closing id; only a document longer than a sequence is cut.
Pieces are dealt into groups, and each group fills sequences from its longest piece on: among
the open sequences in which a piece fits under every capacity, the one whose remaining
capacities suit it best takes it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import give_back, one_thread, steps, stored, strings, table, words_of

SEQUENCE = 2048
CLOSING_ID = 0
#: Tokenizer file, by its name in the installed vocabulary package.
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs together.  Each group leaves about one sequence part-filled.
GROUP = 8192
#: Words a task remembers, in each of two generations.
REMEMBERED = 300_000
#: Words that are encoded at a time.
_CHUNK = 16_384

#: Capacities of a sequence: tokens, documents, attention cost (sum of squared lengths).
CAPACITIES = (SEQUENCE, SEQUENCE, SEQUENCE * SEQUENCE)
#: Weights of the capacities in the measure of fit.
WEIGHTS = (1.0, 0.001, 0.1)


# What the tokenizer file does before it merges letters.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that no normal form changes and that have one lower case, then signs: two pieces at most.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


class WordTokenizer:
    """Token ids of texts, word by word, with a bounded memory of words.

    The tokenizer splits at white space before anything else, so a text's ids are its words'
    ids in order.  New words are encoded many at a time, as words that are cut already.  Most
    are letters and closing signs; those are cut and lower-cased here and only merged there.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        one_thread()
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.new, self.old = _Words(), _Words()
        spec = json.loads(self.tokenizer.to_str())
        steps_ = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        suffix = spec["model"].get("end_of_word_suffix")
        self.merger = None
        if steps_ == _NORMALIZERS and splits[0].get("pattern") == {"Regex": _SPLIT} and suffix:
            self.merger = Tokenizer.from_file(path)
            self.merger.normalizer = None
            self.merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1 + len(spec["added_tokens"]), dtype=bool)
            self.closes[[k for x, k in spec["model"]["vocab"].items() if x.endswith(suffix)]] = True

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        ids, sizes = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), _CHUNK):
            part = words[at : at + _CHUNK]
            coded = self.tokenizer.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(coded.ids, dtype=np.uint16))
            sizes.append(np.bincount(np.array(coded.word_ids, dtype=np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _merged(self, letters: pa.Array, signs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words given as letters and signs: pieces that are merged once for all their words."""
        signed = pc.greater(pc.binary_length(signs), 0)
        coded = pa.concat_arrays([pc.utf8_lower(letters), signs.filter(signed)]).dictionary_encode()
        ids, sizes = self._pieces(strings(coded.dictionary))
        number, has = coded.indices.to_numpy(), signed.to_numpy(zero_copy_only=False)
        first, second = number[: len(letters)], number[len(letters) :]
        at = np.arange(len(letters)) + np.cumsum(has) - has
        order = np.empty(len(number), dtype=np.int64)
        order[at], order[at[has] + 1] = first, second
        flat, _ = _taken(ids, np.cumsum(sizes) - sizes, sizes, order)
        whole = sizes[first]
        whole[has] += sizes[second]
        return flat, whole

    def _pieces(self, pieces_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces; the last id of each, and no other, closes it."""
        ids, sizes = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(pieces_), _CHUNK):
            part = pieces_[at : at + _CHUNK]
            coded = self.merger.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(coded.ids, dtype=np.uint16))
            sizes.append(np.diff(np.flatnonzero(self.closes[ids[-1]]), prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: list[str]) -> None:
        odd = words
        if self.merger:
            cut = pc.extract_regex(pa.array(words, pa.large_string()), _PLAIN)
            plain = cut.is_valid()
            cut, is_plain = cut.filter(plain), plain.to_numpy(zero_copy_only=False)
            odd = list(compress(words, (~is_plain).tolist()))
            letters, signs = (pc.struct_field(cut, x) for x in ("letters", "signs"))
            self.new.add(list(compress(words, is_plain.tolist())), *self._merged(letters, signs))
        self.new.add(odd, *self._encode(odd))

    def known(self, words: list[str]) -> np.ndarray:
        """The number of each word in ``new``, which then holds them all."""
        if len(self.new.number) > self.remembered:
            self.old, self.new = self.new, _Words()
        number = self.new.number
        fresh = [w for w in words if w not in number]
        kept = np.array([self.old.number.get(w, -1) for w in fresh], dtype=np.int64)
        again = kept >= 0
        if again.any():
            moved = [w for w, k in zip(fresh, again.tolist(), strict=True) if k]
            self.new.add(moved, *self.old.ids_of(kept[again]))
            fresh = [w for w, k in zip(fresh, again.tolist(), strict=True) if not k]
        self._learn(fresh)
        return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))

    def forget(self) -> None:
        """Drop the words; the tokenizer itself stays."""
        self.new, self.old = _Words(), _Words()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each row begins and the last one ends."""
        words, codes, offsets = words_of(texts)
        numbers = self.known(words)
        flat, lengths = self.new.ids_of(numbers[codes] if len(codes) else numbers[:0])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat.astype("<u4"), ends[offsets]


class _Words:
    """Words by number, and their ids in one array (the vocabulary has fewer than 2**16)."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint16)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.number)
        self.number.update(zip(words, range(at, at + len(words)), strict=True))
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _taken(self.flat, self.begin, self.size, numbers)


def _taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these numbers, one after another, and how many each has."""
    sizes = size[numbers]
    ends = np.cumsum(sizes)
    place = np.repeat(begin[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return flat[place], sizes


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(name: str) -> WordTokenizer:
    """One tokenizer for each worker process; the file is the worker's own installed copy.

    A worker outlives its tasks, so who asks for it forgets its words when done.
    """
    if name not in _tokenizers:
        _tokenizers[name] = WordTokenizer(public_tokenizers.path(name))
    return _tokenizers[name]


def _cutter(name: str, size: int, closing: int):
    def rows_of(batch: pa.RecordBatch, tokenizer: WordTokenizer) -> pa.RecordBatch:
        ids, offsets = tokenizer.encode(batch.column("text"))
        ids = np.insert(ids, offsets[1:], np.uint32(closing)).astype("<u4", copy=False)
        lengths = np.diff(offsets) + 1
        counts = -(-lengths // size)
        row = np.repeat(np.arange(len(counts)), counts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = piece * size
        length = np.minimum(lengths[row] - start, size)
        begin = (np.cumsum(lengths) - lengths)[row] + start
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
        columns = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, sums))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(name)
        try:
            for batch in steps(batches, "text"):
                yield rows_of(batch, tokenizer)
                pa.default_memory_pool().release_unused()
        finally:
            tokenizer.forget()
            give_back()

    return cut


def pieces(docs: DataFrame, name: str = TOKENIZER, size: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for every piece of every row of ``docs``.

    ``start`` counts the document's ids before the piece, ``ids_crc32`` covers its ids as
    little-endian 32-bit numbers.  A null or empty text is the closing id alone.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_cutter(name, size, closing), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(
    needs: np.ndarray, capacities: tuple[float, ...] = CAPACITIES, weights: tuple[float, ...] = WEIGHTS, measure: str = "norm"
) -> np.ndarray:
    """The bin of each item; ``needs`` has a row for each item and a column for each capacity.

    Items are placed from the largest to the smallest share of their tightest capacity.  A bin
    takes an item only if every capacity holds.  ``measure`` picks among such bins: ``norm``
    the one with the smallest weighted norm of what would remain, ``dot`` the one whose
    remaining capacities have the largest weighted dot product with the needs.  Ties go to the
    bin opened first.  A bin that no item left could enter is closed.  An item above a
    capacity raises an error.
    """
    full = np.asarray(capacities, dtype=float)
    share = np.asarray(needs, dtype=float) / full
    scale = np.asarray(weights, dtype=float)
    if len(share) and share.max() > 1:
        raise ValueError("an item is larger than a capacity")
    order = np.lexsort((np.arange(len(share)), *[-share[:, k] for k in range(share.shape[1] - 1, 0, -1)], -share[:, 0]))
    room = np.empty((max(16, len(share)), share.shape[1]))
    out = np.empty(len(share), dtype=np.int64)
    opened, live = 0, np.empty(0, dtype=np.int64)
    smallest = share.min(axis=0) if len(share) else full
    for item in order:
        need = share[item]
        left = room[live] - need
        fits = (left >= -1e-12).all(axis=1)
        if fits.any():
            if measure == "norm":
                value = np.where(fits, ((left * left) * scale).sum(axis=1), np.inf)
                chosen = live[int(value.argmin())]
            else:
                value = np.where(fits, (room[live] * need * scale).sum(axis=1), -np.inf)
                chosen = live[int(value.argmax())]
        else:
            chosen, opened = opened, opened + 1
            room[chosen] = 1.0
            live = np.append(live, chosen)
        room[chosen] -= need
        out[item] = chosen
        if (room[chosen] < smallest - 1e-12).any():  # nothing that is left fits any more
            live = live[live != chosen]
    return out


def pack(found: DataFrame, group: int = GROUP, capacities: tuple[float, ...] = CAPACITIES) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset``: no sequence above any of the capacities.

    Pieces are dealt into groups by a hash of all they are, so repeats and ties are spread
    too; the number of groups follows the number of pieces.
    """
    total = found.count()
    groups = max(1, -(-total // group))
    whole = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        length = part["length"].to_numpy()
        bins = best_fit(np.stack([length, np.ones(len(length)), length * length], axis=1), capacities)
        order = np.argsort(bins, kind="stable")
        part, bins = part.iloc[order], bins[order]
        before = np.cumsum(part["length"].to_numpy()) - part["length"].to_numpy()
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        base = np.maximum.accumulate(np.where(first, before, 0))
        part = part.assign(sequence_id=bins + part["part"].to_numpy() * (1 << 32), offset=before - base)
        return part.drop(columns="part")

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return found.withColumn("part", part).groupBy("part").applyInPandas(fill, whole)


def packed(
    docs: DataFrame, name: str = TOKENIZER, group: int = GROUP, capacities: tuple[float, ...] = CAPACITIES
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs``.

    Null and empty texts are one token.  Repeated rows are packed each on its own.  A null
    doc_id stays null.  Other columns are not read; an empty table gives an empty one.
    """
    return pack(stored(pieces(docs, name), "pieces"), group, capacities)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
