"""Token ids of whole texts from a ready-made tokenizer file, fast enough for a corpus."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain, islice

import numpy as np

#: Bytes of text that are split at once, and distinct pieces that one worker remembers.
SLICE_BYTES, REMEMBERED = 4 << 20, 1_200_000


class _Places(dict):
    """Key -> place; a new key takes the next one."""

    def __missing__(self, key: bytes | str) -> int:
        self[key] = place = len(self)
        return place


class _Runs:
    """Runs of ids by place."""

    def __init__(self) -> None:
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places in a row, and their numbers."""
        lengths = self.lengths[places]
        shift = self.starts[places] - np.cumsum(lengths) + lengths
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], lengths


class WordEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For tokenizers that lower-case, drop white space, and encode by themselves the pieces that a fixed pattern finds:
    contractions, runs of letters, single digits, runs of anything else, with an end mark on each piece's last token.

    A plain text (ASCII and composed Latin-1 letters, no special token) is cut into those pieces here. Any other text is
    cut at ASCII white space, which no piece spans. Each distinct piece or chunk is encoded once and found again in a
    table. New words go to the tokenizer many in one text and are told apart by the end mark. The table is bounded and
    starts anew when full.
    """

    letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    unusual = re.compile(rf"[^{letters}0-9\t-\r\x20-\x7e]|<\|").search
    pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9\t-\r ]+").findall

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = _Places(), _Runs()

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _learn(self, keys: list[str | bytes]) -> None:
        """Adds the ids of new pieces (str) and chunks (bytes), in this order."""
        is_word = np.fromiter((isinstance(k, str) and k.isalpha() for k in keys), bool, len(keys))
        words = [k for k, w in zip(keys, is_word.tolist(), strict=True) if w]
        joined, _ = self._encoded([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
        whole, sizes = self._encoded([k if isinstance(k, str) else k.decode() for k, w in zip(keys, is_word.tolist(), strict=True) if not w])
        lengths = np.empty(len(keys), np.int64)
        lengths[is_word] = np.diff(np.concatenate([[0], np.flatnonzero(self.ends[joined]) + 1]))
        lengths[~is_word] = sizes
        out, from_word = np.empty(int(lengths.sum()), np.uint32), np.repeat(is_word, lengths)
        out[from_word], out[~from_word] = joined, whole
        self.ids.add(out, lengths)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text. Null is an empty text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        before = len(self.known)
        per_text = [t.encode().split() if self.unusual(t) else self.pieces(t.lower()) for t in (t or "" for t in texts)]
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(per_text)), np.int64, int(counts.sum()))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        ids, lengths = self.ids.of(place)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def documents(self, texts: Sequence[str | None], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text followed by ``end_id``."""
        for part in slices(texts):
            ids, lengths = self.encode(part)
            at = 0
            for n in lengths:
                yield np.append(ids[at : at + n], np.uint32(end_id))
                at += n


def slices(texts: Sequence[str | None], most: int = SLICE_BYTES) -> Iterator[Sequence[str | None]]:
    """Runs of texts of about ``most`` characters, at least one text each."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python process, so that tasks which follow one another find the words that it knows."""
    return WordEncoder(path)
