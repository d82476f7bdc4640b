"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Distinct words kept with their counts by one Python worker; the table starts anew beyond that.
KEPT = 1_000_000
_loaded: dict[str, "WordBpe"] = {}


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies use for each byte: itself or one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class WordBpe:
    """Counts of a word-level BPE file: library rules split words, numpy merges them together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.suffix, self.vocab = suffix, vocab
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.width = max(vocab.values()) + 1
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made
        self.counts: dict[bytes, int] = {}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern + "| ")
        shown = _byte_signs()
        self.byte_id = np.array([vocab[c] for c in shown], np.int64)
        self.last_id = np.array([vocab[c + suffix] for c in shown], np.int64)

    def merged_lengths(self, sym: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Symbols left in each sequence (ids in `sym`, lengths in `left`) once no pair can merge.

        All sequences advance together: in each round every sequence merges all places of its
        lowest-ranked pair, left to right; finished sequences leave the arrays.
        """
        left, seq = left.copy(), np.repeat(np.arange(len(left)), left)
        none = len(self.made)
        while len(sym) > 1:
            same = seq[1:] == seq[:-1]
            pair = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where(same & (self.key[at] == pair), self.rank[at], none)
            first = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(np.r_[rank, none], first)
            group = np.cumsum(np.r_[False, ~same])
            best = lowest[group[:-1]]
            hit = (rank == best) & (rank < none)
            if not hit.any():
                break
            # of overlapping places, as in "aaa", every other one counts from the left
            index = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, -1))
            hit &= (index - run) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            left -= np.bincount(seq[where], minlength=len(left))
            stay &= (lowest < none)[group]
            sym, seq = sym[stay], seq[stay]
        return left

    def learn(self, new: list[bytes]) -> None:
        """Count the tokens of words that have not been met yet."""
        plain = [w for w in new if max(w) < 0xD4 and b"\xc2" not in w and b"<|" not in w]
        if plain:
            self.counts.update(zip(plain, self.plain_counts(plain)))
        for word in new:
            if word not in self.counts:
                self.counts[word] = self.any_count(word.decode("utf-8"))

    def plain_counts(self, new: list[bytes]) -> list[int]:
        """Counts of words of Latin, Greek and Cyrillic letters, digits and marks, all in one pass.

        The normaliser works on the words joined by spaces; a space never changes and no part of
        a word reaches over it.
        """
        text = self.library.normalizer.normalize_str(b" ".join(new).decode("utf-8"))
        data = np.frombuffer("\n".join(self.split.findall(text)).encode() + b"\n", np.uint8)
        stop = np.flatnonzero(data == 10)
        start = np.r_[0, stop[:-1] + 1]
        gap = data[start] == 32
        owner = np.cumsum(gap)[~gap]
        sym = self.byte_id[data]
        sym[stop - 1] = self.last_id[data[stop - 1]]
        of = np.repeat(np.arange(len(stop)), stop - start + 1)
        real = (data != 10) & ~gap[of]
        total = self.merged_lengths(sym[real], (stop - start)[~gap])
        return np.bincount(owner, total, len(new)).astype(np.int64).tolist()

    def any_count(self, text: str) -> int:
        """Count of one word by the library's own rules, special strings included."""
        parts, total, vocab = self.special.split(text) if self.special else [text], 0, self.vocab
        total += len(parts) - 1
        for part in parts:
            for token, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)) if part else ():
                symbols = [vocab.get(c) for c in token[:-1]] + [vocab.get(token[-1] + self.suffix)]
                symbols = np.array([x for x in symbols if x is not None], np.int64)
                total += int(self.merged_lengths(symbols, np.array([len(symbols)]))[0])
        return total

    def count(self, texts: list[bytes]) -> list[int]:
        parts = [t.split() for t in texts]  # ASCII white space: no token crosses it
        new = set(chain.from_iterable(parts)) - self.counts.keys()
        if len(self.counts) + len(new) > KEPT:
            self.counts.clear()
            new = set(chain.from_iterable(parts))
        new = list(new)
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        get = self.counts.__getitem__
        return [sum(map(get, p)) for p in parts]


def _tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    `path` is the vocabulary file on every machine. A null or empty text has no bytes and no
    tokens. Repeated rows each give a row; a null id stays null; other columns are ignored.
    No shuffle: each task counts its own rows, small groups of rows at a time.
    """
    id_type = docs.schema[id_col].dataType

    def count(batches):
        bpe = _tokenizer(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            for i in range(0, batch.num_rows, 512):
                part = texts.slice(i, 512)
                n = pa.array(bpe.count(part.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), pc.binary_length(part).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(count, f"doc_id {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
