"""Token ids by the tokenizers library, with a cache of what stands between blanks.

In the vocabulary's rule for cutting text into pieces, no piece holds a blank after a character that is none. So a text may be
cut before each such blank, and the ids of the parts joined are the ids of the whole text. Most parts recur, so that the library
has to encode only those that a worker has not seen yet.
"""

from __future__ import annotations

import re
import string
from array import array

MOST_CACHED, LONGEST_CACHED = 1_200_000, 48
#: A space after anything that some Unicode version takes for a blank doesn't part the text.
UNSURE = "\\s\x1c-\x1f\x85\xa0\u180e\u200b-\u200f\u2028\u2029\u2060\ufeff"
_CUT, _UNSURE = re.compile(f"(?<![{UNSURE}]) "), re.compile(f"[{UNSURE}]")
#: Letters that all Unicode versions take for such, and marks that make pieces of their own after a letter.
_LETTERS, _MARKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", re.escape(string.punctuation)
#: A word and marks, and perhaps another word and marks on the next line.
_SIMPLE = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)(?:\n([{_LETTERS}]+)([{_MARKS}]*))?")


def _open(part: str) -> bool:
    """Whether a part is empty or ends with one of UNSURE."""
    return not part or _UNSURE.match(part, len(part) - 1) is not None


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit numbers in bytes, the same as the library's plain call."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # without the rule for cutting
        self.forget()
        self.line_end = self._encode(["\n"])[0]
        # The vocabulary writes bytes that are no visible Latin-1 characters as those from U+0100 on, in order.
        self.visible = np.arange(256, dtype="<u2")
        unseen = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
        self.visible[unseen] = np.arange(256, 256 + len(unseen))
        self.space = chr(self.visible[32])
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(self.space)]] = True

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}  # of parts and words after a space; none is empty or ends with one of UNSURE
        self.heads: dict[str, bytes] = {}  # of words without one: a text's first, and those after a line end
        self.tails: dict[str, bytes] = {}  # of marks after a letter

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder for each vocabulary and worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, parts: list[str]) -> list[bytes]:
        return parts and [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _visible(self, text: str) -> str:
        import numpy as np

        return text.replace(" ", self.space) if text.isascii() else self.visible[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, each after a space. No merge joins a letter and a space, so they are encoded as one piece."""
        import numpy as np

        flat = array("I", self.bare.encode_batch_fast([self._visible(" " + " ".join(words))], add_special_tokens=False)[0].ids).tobytes()
        ends = [*(4 * np.flatnonzero(self.spaced[np.frombuffer(flat, "<u4")])).tolist(), len(flat)]
        return [flat[s:e] for s, e in zip(ends, ends[1:])]

    def _first(self, word: str) -> bytes:
        """The ids of a word of letters without a space before it."""
        ids = self.heads.get(word)
        if ids is None:
            ids = self.heads[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(self._visible(word))]).tobytes()
        return ids

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._encode([marks])[0]
            if len(marks) <= LONGEST_CACHED:
                self.tails[marks] = ids
        return ids

    def _rest(self, found: re.Match) -> bytes:
        """The ids of what _SIMPLE found after its first word."""
        _, marks, second, more = found.groups()
        ids = self._tail(marks) if marks else b""
        if second:
            ids += self.line_end + self._first(second)
            if more:
                ids += self._tail(more)
        return ids

    def _head(self, part: str) -> bytes:
        found = _SIMPLE.fullmatch(part) if len(part) <= LONGEST_CACHED else None
        return self._first(found[1]) + self._rest(found) if found else self._encode([part])[0]

    def _learn(self, parts: list[str], inner: int) -> list[bytes] | None:
        """The ids of parts, each after a space; those of short ones that don't end with one of UNSURE go into the cache.

        None if one of the first inner parts is empty or ends so, since the space that follows it doesn't part the text then.
        """
        cache, words, marked, rest = self.cache, [], [], []
        for at, part in enumerate(parts):
            # The plain cases without a regular expression: ASCII letters, perhaps marks.
            short, core, found = len(part) <= LONGEST_CACHED, "", None
            if short and part.isascii():
                if part.isalpha():
                    words.append(part)
                    continue
                core = part.rstrip(string.punctuation)
            if not core.isalpha():
                if not (found := _SIMPLE.fullmatch(part) if short else None):
                    if at < inner and _open(part):
                        return None
                    rest.append(at)
                    continue
                core = found[1]
            if core not in cache:
                words.append(core)
            if len(core) < len(part):
                marked.append((part, core, found))
        if words:
            words = list(dict.fromkeys(words))
            cache.update(zip(words, self._words(words)))
        for part, core, found in marked:
            cache[part] = cache[core] + (self._rest(found) if found else self.tails.get(marks := part[len(core) :]) or self._tail(marks))
        out = list(map(cache.get, parts))
        for at, ids in zip(rest, self._encode([" " + parts[at] for at in rest])):
            out[at] = ids
            if len(parts[at]) <= LONGEST_CACHED and not _open(parts[at]):
                cache[parts[at]] = ids
        return out

    def _joined(self, parts: list[str], cut: bool) -> bytes | None:
        """The ids of a text cut before spaces. cut: at those that part it; else at all, and None if one of them doesn't."""
        head, parts[0] = parts[0], ""
        if not cut and head and len(parts) > 1 and _open(head):
            return None
        known = list(map(self.cache.get, parts))
        known[0] = self._head(head) if head else b""
        if None in known:
            new = [i for i, x in enumerate(known) if x is None]
            # The cache has no part that is empty or ends with one of UNSURE, so such are among the new ones.
            found = self._learn([parts[i] for i in new], 0 if cut else len(new) - (new[-1] == len(parts) - 1))
            if found is None:
                return None
            for i, ids in zip(new, found):
                known[i] = ids
        return b"".join(known)

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.cache) + len(self.heads) + len(self.tails) > MOST_CACHED:
                self.forget()
            ids = self._joined(text.split(" "), False)
            out.append(self._joined(_CUT.split(text), True) if ids is None else ids)
        return out
