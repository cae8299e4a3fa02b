"""Byte-level BPE ids by the tokenizers library.

The pre-tokenizer of this family of vocabularies always cuts before a lone space and around a lone newline, and merges never
cross a cut, so a word (with the space before it) has the same ids wherever it stands.  A batch is cut into words and coded
by distinct word in Arrow; each worker keeps the ids of words that it has met, up to a bound, and asks the library for new
ones in one call, as lines of one text; the texts' ids are then gathered by number.  A text with any other white space, or two
in a row, goes to the library whole.  Tests compare with whole texts' ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

#: Marks that close a word; after a letter or number a run of them is a piece of its own.
MARKS = ".,;:!?)]}*%#&$\"'"
#: Words that a worker keeps, and bytes of text to a call.
KEPT, CALL = 850_000, 6 << 20


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = np.dtype(np.uint16 if self.library.get_vocab_size() <= 65536 else np.uint32)
        line = self._ids(["\n", "a\n b,\nc."])
        self.line = np.frombuffer(line[0], self.dtype)
        self.known = {"\n": line[0]}
        # words are taken apart only where the library does so too
        self.apart = len(self.line) == 1 and line[1] == b"".join(self._ids(["a", "\n", " b", ",", "\n", "c", "."]))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[str]) -> None:
        for a in range(0, len(words), 2000):
            some = words[a : a + 2000]
            flat = self._ids(["\n".join(some)])[0]
            cuts = (np.flatnonzero(np.frombuffer(flat, self.dtype) == self.line[0]) * self.dtype.itemsize).tolist()
            self.known.update(zip(some, [flat[x:y] for x, y in zip([0, *(c + self.dtype.itemsize for c in cuts)], [*cuts, len(flat)], strict=True)], strict=True))

    def _learn(self, words: list[str]) -> None:
        """Different words, none of them known."""
        plain, closed = [], []
        for w in words:
            if w[-1] in MARKS and (b := w.rstrip(MARKS)) and b[-1].isalnum():
                closed.append((w, b, w[len(b) :]))
            else:
                plain.append(w)
        self._ask(plain)
        known = self.known
        self._ask([p for p in {b for _, b, _ in closed} | {m for _, _, m in closed} if p not in known])
        known.update([(w, known[b] + known[m]) for w, b, m in closed])

    def _call(self, texts: pa.Array) -> list[np.ndarray]:
        whole = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False).astype(bool) | (not self.apart)
        if len(self.known) > KEPT:  # frequent words were met first: the older half stays
            self.known = dict(islice(self.known.items(), KEPT // 2))
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        # one string taken apart is made faster than many
        code, words = coded.indices.to_numpy(), pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\0")[0].as_py().split("\0")
        ids = list(map(self.known.get, words))
        gone = [k for k, x in enumerate(ids) if x is None]
        # two spaces or lines in a row leave a word that is empty or a space; other white space and controls do not print
        odd = [k for k in gone if words[k] in ("", " ") or not words[k].isprintable()]
        strange = set(odd)
        self._learn([words[k] for k in gone if k not in strange])
        for k in gone:
            ids[k] = b"" if k in strange else self.known[words[k]]
        if odd:
            bad = np.zeros(len(words), bool)
            bad[odd] = True
            whole |= np.add.reduceat(bad[code], at[:-1]) > 0
        pool = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        each = size[code]
        ends = np.cumsum(each, dtype=np.int32)
        gather = np.repeat((np.cumsum(size, dtype=np.int32) - size)[code] - (ends - each), each)
        gather += np.arange(len(gather), dtype=np.int32)
        flat, cut = pool[gather], np.concatenate([[0], ends[at[1:] - 1]]).tolist()
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        left = np.flatnonzero(whole).tolist()
        for k, b in zip(left, self._ids([texts[k].as_py() for k in left]), strict=True):
            out[k] = np.frombuffer(b, self.dtype)
        return out

    def encode(self, texts: Iterable[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()
        first = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= CALL or i + 1 == len(sizes):
                yield from self._call(texts.slice(first, i + 1 - first))
                first, size = i + 1, 0


@C.kept
@cache
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary, until another operator's task enters."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
