"""Texts to token ids with a public tokenizer file, fast enough for whole corpora.

The tokenizer drops white space and never merges across it, so ids are made word by word and kept
for words that come again (a bounded memory in each Python worker). Texts are split at ASCII white space and
their words found by flat array lookups; a word with anything that could make its pieces differ from those
of the library (other white space among them) goes to the library as it is.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, find_words, text_buffer

#: Words that a worker remembers before it starts afresh (about 120 MB).
REMEMBERED = 600_000
_WIDE = re.compile("[^\x00-\xff]")
_ODD = re.compile("[\x1c-\x1f\x85\xa0]|<\\|(?:startoftext|endoftext)\\|>")
#: The tokenizer's own split, for lower-cased Latin-1; a line feed marks the end of a word.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|\n|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class _Lists:
    """Lists of ids, appended to and gathered by number."""

    def __init__(self):
        self.starts, self.lengths, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        self.n = self.used = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> int:
        """The number of the first list added."""
        n, used = self.n + len(lengths), self.used + len(flat)
        if n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.starts, self.lengths))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.uint32)])
        self.flat[self.used : used] = flat
        self.lengths[self.n : n] = lengths
        self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
        first, self.n, self.used = self.n, n, used
        return first

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists, one after another, and where each list ends."""
        n = self.lengths[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[rows] - (ends - n), n)
        at += np.arange(len(at))
        return self.flat[at], ends


class WordTokens:
    """Ids of whole texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        # the same model for pieces that are split and lower-cased already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.vocabulary = max(vocab.values()) + 1
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.short, self.long = Words(20), {}  # grows
        self.word_ids = _Lists()
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_ids = _Lists()
        self.piece_ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, new: list[str]) -> np.ndarray:
        """The numbers of different new words."""
        out = np.zeros(len(new), np.int64)
        joined = "\n".join(new)
        plain = new
        if _WIDE.search(joined) or _ODD.search(joined):
            odd = [k for k, w in enumerate(new) if _WIDE.search(w) or _ODD.search(w)]
            for k in odd:
                ids = self.whole.encode(new[k], add_special_tokens=False).ids
                out[k] = self.word_ids.add(np.array(ids, np.uint32), np.array([len(ids)]))
            left = np.ones(len(new), bool)
            left[odd] = False
            plain = [w for w, ok in zip(new, left.tolist()) if ok]
            joined = "\n".join(plain)
        if not plain:
            return out
        found = _PIECE.findall(joined.lower())
        found.append("\n")
        fresh = list(set(found) - self.pieces.keys())
        if fresh:
            ids = np.asarray(self.plain.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(fresh):
                raise ValueError("a piece did not end where the tokenizer ends words")
            first = self.piece_ids.add(ids, np.diff(stops, prepend=0))
            self.pieces.update(zip(fresh, range(first, first + len(fresh))))
        rows = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        flat, ends = self.piece_ids.gather(rows)
        first = self.word_ids.add(flat, np.diff(ends[rows == 0], prepend=0))
        out[slice(None) if plain is new else left] = np.arange(first, first + len(plain))
        return out

    def _rows(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of texts that begin at ``first`` (the last entry: where they end), and the place of each text's first word."""
        starts, ends, a, b, n = find_words(data, first)
        rows = self.short.find(a, b, n)  # longer words are never there
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = data.tobytes()
            seen = [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            own = dict.fromkeys(seen)
            known = {w: self.long[w] for w in own if w in self.long} if self.long else {}
            learn = [w for w in own if w not in known]
            own.update(zip(learn, self._learn([w.decode() for w in learn]).tolist()))
            own.update(known)
            self.long.update((w, own[w]) for w in learn if len(w) > 16)
            rows[new] = np.fromiter(map(own.__getitem__, seen), np.int64, len(new))
            _, one = np.unique(rows[new], return_index=True)
            one = new[one][n[new[one]] <= 16]
            self.short.add(a[one], b[one], n[one], rows[one])
        return rows, np.searchsorted(starts, first)

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, one after another, ``end_id`` after each where given, and the len(texts) + 1 places
        where a text's ids begin and end. A null text is empty."""
        if self.word_ids.n > REMEMBERED or len(self.pieces) > REMEMBERED:
            self.forget()
        data, first = text_buffer(texts)
        rows, words = self._rows(data, first) if len(data) else (np.zeros(0, np.int64), np.zeros(len(first), np.int64))
        ids, ends = self.word_ids.gather(rows)
        cuts = np.append(0, ends)[words]
        if end_id is None:
            return ids, cuts
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        places = cuts + np.arange(len(cuts))
        inner = np.ones(len(out), bool)
        inner[places[1:] - 1] = False
        out[inner] = ids
        return out, places

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        ids, cuts = self.encode_array(pa.array(texts, pa.large_string()))
        return np.split(ids, cuts[1:-1]) if len(texts) else []


def slices(texts: pa.Array, most: int = 1 << 21) -> list[tuple[int, int]]:
    """(first, rows) of parts of about ``most`` bytes, or of one text that is longer."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate([[0], np.cumsum(size)[:-1]]) // most if len(size) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(first.tolist(), np.diff(np.append(first, len(part))).tolist()))


_HELD: dict[str, WordTokens] = {}


def tokenizer(path: str) -> WordTokens:
    """One for each file in a Python worker."""
    if path not in _HELD:
        _HELD[path] = WordTokens(path)
    return _HELD[path]
