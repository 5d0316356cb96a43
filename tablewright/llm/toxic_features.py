"""The dense features of toxicity, by text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .encoding import chunked, parts

#: Bytes of a task's step, and chunks between white space that it keeps (about 10 MB).
STEP, KEPT = 2 << 20, 30_000
#: Lengths of the beginnings of words that the lexicon may hold, marked with ^.
PREFIXES = (3, 6)
NEAR = 3
# Common insults, and pronouns of address in the corpus's languages.
SEEDS = frozenset("idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown dumb ugly hate fool jerk filth idiota estúpido estúpida imbécil basura asco inútil dummkopf idioten blöd widerlich abschaum connard imbécile débile ordure nul".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORDS = re.compile(r"\w+")
HIDDEN = re.compile(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+")
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
SEED, LEARNED, PREFIX, SECOND = 1, 2, 4, 8
NAMES = "seed learned prefix lexicon_count near_second second capitals exclamations questions punctuation hidden hidden_lexicon repeats log_words".split()


class Chunks(dict):
    """By chunk between white space: its words, hidden words, those of the lexicon, and its words' flags if one has any; made anew for each task."""

    def __init__(self, lexicon: frozenset[str]):
        self.words = {x: SEED for x in SEEDS}
        for unit in lexicon:
            if not unit.startswith("^"):
                self.words[unit] = self.words.get(unit, 0) | LEARNED
        for word in SECOND_PERSON:
            self.words[word] = self.words.get(word, 0) | SECOND
        self.starts = frozenset(x[1:] for x in lexicon if x.startswith("^"))
        self.first = frozenset(x[: PREFIXES[0]] for x in self.starts)

    def flags(self, word: str) -> int:
        """SEED, LEARNED, PREFIX and SECOND of a lower-case word."""
        found = self.words.get(word, 0)
        if word[: PREFIXES[0]] in self.first and any(word[:k] in self.starts for k in range(PREFIXES[0], min(PREFIXES[1], len(word) - 1) + 1)):
            found |= PREFIX
        return found

    def __missing__(self, chunk: str) -> tuple[int, int, int, list[int]]:
        low = chunk.lower()
        if chunk.isalpha():
            found = 1, 0, 0, [f] if (f := self.flags(low)) else []
        else:
            flags = list(map(self.flags, WORDS.findall(low)))
            hidden = [self.words.get(x.translate(LEET), 0) & (SEED | LEARNED) > 0 for x in HIDDEN.findall(low)]
            found = len(flags), len(hidden), sum(hidden), flags if any(flags) else []
        if len(self) < KEPT:
            self[chunk] = found
        return found


def _marks(texts: pa.Array) -> np.ndarray:
    """Capitals, !, ?, marks and bytes that two equal ones precede (marks, letters and digits of ASCII), by text (no nulls)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    capital = (b >= 65) & (b <= 90)
    capital[:-1] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    again = np.zeros(len(b), bool)
    starts = offsets - offsets[0]
    again[2:] = (b[2:] == b[1:-1]) & (b[2:] == b[:-2]) & (b[2:] > 32) & (b[2:] < 127)
    for i in (0, 1):  # these have no two before them in their text
        again[np.minimum(starts[:-1] + i, max(0, len(b) - 1))[: len(b)]] = False
    sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int32)])[starts] for x in (capital, b == 33, b == 63, _MARK[b], again)]
    return np.diff(np.stack(sums, 1), axis=0)


def features(texts: pa.Array, chunks: Chunks) -> np.ndarray:
    """A row of the values of NAMES for each text; null counts as empty. Densities are by word or character, so they don't depend on a text's length.

    Texts of more than STEP bytes are looked at in pieces, between which words don't count as near each other.
    """
    counts, marks, flagged, chars = np.zeros((len(texts), 3)), np.zeros((len(texts), 5)), np.zeros((len(texts), 6)), np.zeros(len(texts))
    for own, number in parts(texts, STEP):
        strings, codes, bounds = chunked(own)
        marks[number] += _marks(own)
        chars[number] += pc.utf8_length(own).to_numpy(zero_copy_only=False)
        if not len(codes):
            continue
        made = list(map(chunks.__getitem__, strings))
        table = np.array([m[:3] for m in made], np.int32)
        of = np.repeat(number, np.diff(bounds))
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        counts[of[starts]] += np.add.reduceat(table[codes], starts, axis=0, dtype=np.int64)
        # places of the words with flags, counted over all texts of the step, with a gap between texts
        first = np.cumsum(table[codes, 0]) - table[codes, 0] + (NEAR + 1) * of
        marked = np.flatnonzero(np.fromiter((bool(m[3]) for m in made), bool, len(made))[codes])
        found = [(begin + i, f, t) for k, begin, t in zip(codes[marked].tolist(), first[marked].tolist(), of[marked].tolist(), strict=True) for i, f in enumerate(made[k][3]) if f]
        at, flag, text = np.array(found, np.int64).reshape(-1, 3).T
        toxic, second = flag & (SEED | LEARNED | PREFIX) > 0, at[flag & SECOND > 0]
        near = np.zeros(len(at), bool)
        if toxic.any() and len(second):
            k = np.searchsorted(second, at)
            near = toxic & (np.minimum(np.abs(at - second[np.minimum(k, len(second) - 1)]), np.abs(at - second[np.maximum(k - 1, 0)])) <= NEAR)
        for i, x in enumerate((flag & SEED > 0, flag & LEARNED > 0, flag & PREFIX > 0, toxic, near, flag & SECOND > 0)):
            flagged[:, i] += np.bincount(text[x], minlength=len(texts))
    n, c = np.maximum(1, counts[:, :1]), np.maximum(1, chars)[:, None]
    share = flagged / n
    return np.concatenate([share[:, :3], np.log1p(flagged[:, 3:4]), share[:, 4:], marks[:, :4] / c, counts[:, 1:] / n, marks[:, 4:] / c, np.log1p(counts[:, :1])], 1)
