"""Token ids of whole texts by a public tokenizer: each distinct string between white space is cut into words once a batch, each word encoded once a task."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

#: Words that a task keeps at most (about 4 MB).
KEPT_WORDS = 150_000
#: Of these, the first ones stay with the worker for its next task: they are mostly frequent ones.
KEPT_BETWEEN = 100_000
#: New words that are Python strings at a time.
NEW_WORDS = 8_192
#: Bytes of text that a task encodes at a time; a longer text stands alone.
ENCODED_BYTES = 1 << 20
#: Bytes of text that other tasks look at at a time.
STEP_BYTES = 8 << 20
# How word_bpe_49k cuts a lower-cased text into words, as its file states; its letters and digits among the characters that OTHER leaves.
_LETTER, _DIGIT = r"a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{17f}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
WORD = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s\x{{a0}}{_LETTER}{_DIGIT}]+)"
#: Outside these characters, normalisation and lower case may depend on more than one character: the tokenizer gets the whole text.
OTHER = r"[^\t-\r\x20-\x7e\x{a0}-\x{12f}\x{131}-\x{17f}]|<\|(?:startoftext|endoftext)\|>"


def default_tokenizer() -> str:
    """Place of the vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut to about ENCODED_BYTES of text each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // ENCODED_BYTES
        starts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            if j > i:
                yield batch.slice(i, j - i)
                release()


def cut(text: str, limit: int) -> Iterator[str]:
    """Pieces of at most `limit` characters, cut at white space (within a word if it alone is longer)."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(w, at + 1, at + limit) for w in " \n\t\r\x0b\x0c")
        end = end if end > at else at + limit
        yield text[at:end]
        at = end
    yield text[at:]


def parts(texts: pa.Array, limit: int = STEP_BYTES, whole: bool = False) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The texts (null: empty) in steps of about `limit` bytes, and the number of each one's text. A longer text comes alone, in pieces or whole."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    long = sizes > limit
    step = np.cumsum(np.where(long, 0, sizes)) // limit + np.cumsum(long) + np.cumsum(np.concatenate([[False], long[:-1]]))[: len(long)]
    starts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
    for i, j in zip(starts, starts[1:], strict=False):
        if not whole and j == i + 1 and long[i]:
            for piece in cut(texts[i].as_py(), limit):
                yield pa.array([piece], pa.string()), np.array([i])
                release()
        elif j > i:
            yield texts.slice(i, j - i), np.arange(i, j)
            release()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks between white space of the texts (no nulls), one after the other, and where each text's begin, with the end of all."""
    lists = pc.ascii_split_whitespace(texts)
    found, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    full = pc.not_equal(found, "")  # white space at an end leaves an empty chunk
    if not pc.all(full, min_count=0).as_py():
        bounds = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds]
        found = found.filter(full)
    return found, bounds


def chunked(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks between white space, the number of each chunk of the texts (no nulls), and where each text's begin."""
    found, bounds = _split(texts)
    found = found.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False), bounds


def _spread(flat: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` that `codes` name (run i ends before ends[i + 1]), one after the other, and where each begins, with the end of all."""
    sizes = np.diff(ends)[codes]
    at = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(ends[codes] - at[:-1], sizes) + np.arange(at[-1])], at


def coded(texts: pa.Array, make) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of the texts, one after the other, and where each text's begin: make(chunk), bytes, of each chunk between white space."""
    chunks, codes, bounds = chunked(texts)
    own = [make(x) for x in chunks]
    sizes = np.fromiter(map(len, own), np.int64, len(own)) // 2
    ids, ends = _spread(np.frombuffer(b"".join(own), "<u2"), np.concatenate([[0], np.cumsum(sizes)]), codes)
    return ids, ends[bounds]


class Encoder:
    """As the tokenizer's encode(text, add_special_tokens=False), for byte-level BPE over lower-cased words.

    A batch's texts are cut into chunks at white space and its distinct chunks into words, each by one Arrow operation.
    The ids of distinct words are spread over the chunks, those of the chunks over the texts. Kept words lie in one Arrow
    array and their ids in one flat array, which takes some 25 bytes a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_shown = {c: shown.pre_tokenize_str(chr(c))[0][0] for c in range(32, 0x180)}
        self._keep(pa.array([], pa.string()), np.zeros(0, np.uint16), np.zeros(1, np.int64), 0)

    def _keep(self, words: pa.Array, flat: np.ndarray, ends: np.ndarray, limit: int) -> None:
        n = min(len(words), limit)
        self._known, self._flat, self._ends = pa.concat_arrays([words.slice(0, n)]), flat[: ends[n]].copy(), ends[: n + 1].copy()

    @property
    def words(self) -> list[str]:
        """The kept words, in the order in which they came."""
        return self._known.to_pylist()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Gives the kept words back but for the first KEPT_BETWEEN, for the end of a task: a worker that waits holds little more than the tokenizer."""
        self._keep(self._known, self._flat, self._ends, KEPT_BETWEEN)
        release()

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, one after the other, and where each word's begin, with the end of all. New words are kept, up to KEPT_WORDS."""
        at = pc.index_in(words, self._known)
        codes = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not at.null_count:
            return _spread(self._flat, self._ends, codes)
        new = words.filter(at.is_null())
        model, found, sizes = self.tokenizer.model, array("H"), array("q")
        for i in range(0, len(new), NEW_WORDS):
            for word in "\n".join(new.slice(i, NEW_WORDS).to_pylist()).translate(self.bytes_shown).split("\n"):
                found.extend(ids := [t.id for t in model.tokenize(word)])
                sizes.append(len(ids))
        codes[at.is_null().to_numpy(zero_copy_only=False)] = len(self._known) + np.arange(len(new))
        flat = np.concatenate([self._flat, np.array(found, np.uint16)])
        ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(np.array(sizes, np.int64))])
        if len(self._known) < KEPT_WORDS:
            self._keep(pa.concat_arrays([self._known, new]), flat, ends, KEPT_WORDS)
        return _spread(flat, ends, codes)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other (16 bits), and where each text's begin (one more than texts). Null: no ids."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, OTHER)
        special = pc.any(odd, min_count=0).as_py()
        chunks, bounds = _split(pc.utf8_lower(pc.if_else(odd, "", texts) if special else texts))
        chunks = chunks.dictionary_encode()
        words, starts = _split(pc.replace_substring_regex(pc.replace_substring(chunks.dictionary, "\xa0", " "), WORD, r"\1 "))
        words = words.dictionary_encode()
        flat, ends = _spread(*self._ids(words.dictionary), words.indices.to_numpy())
        ids, ends = _spread(flat, ends[starts], chunks.indices.to_numpy())
        starts = ends[bounds]
        if special:
            own = [np.array(self.whole(t.as_py()), np.uint16) if o else ids[i:j] for t, o, i, j in zip(texts, odd.to_pylist(), starts, starts[1:], strict=False)]
            ids, starts = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return ids, starts


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)
