"""Fast batch encoding with a lower-casing word-end BPE (``word_bpe_49k.json``).

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. This
vocabulary drops white space and ends every pre-token with a word-end token, so the ids
of a text are those of its pre-tokens one after another. For text in Latin-1 the
pre-tokens are found with array operations and looked up in a table of known pre-tokens;
the tokenizer itself is called for new ones, and for all other text. The table is
direct-mapped and of fixed size (an entry that needs a taken slot replaces the holder),
so memory does not grow with the corpus.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarry.llm.arrowtext import mix, texts

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    """Class of each Latin-1 code point, as the tokenizer's pattern sorts them."""
    kind = np.full(256, _OTHER, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isalpha():
            kind[i] = _LETTER
        elif c.isnumeric():
            kind[i] = _DIGIT
    kind[[0x20, 9, 10, 11, 12, 13, 0x85, 0xA0]] = _SPACE
    return kind


class WordBpe:
    SLOTS = 1 << 20
    POOL = 1 << 22  # ids kept for the table; when full, the table starts anew

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for pre-tokens that are lower case already
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.dtype = np.dtype(f"<u{self.id_bytes(path)}")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t for t in (x.content for x in self.full.get_added_tokens_decoder().values())]
        self.kind = _classes()
        self._clear()

    @staticmethod
    def id_bytes(path: str) -> int:
        from tokenizers import Tokenizer

        return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4

    def _clear(self) -> None:
        self.key = np.zeros((self.SLOTS, 2), dtype=np.uint64)
        self.at = np.zeros(self.SLOTS, dtype=np.int64)
        self.len = np.zeros(self.SLOTS, dtype=np.int32)
        self.pool = np.zeros(self.POOL, dtype=self.dtype)
        self.used = 0

    # -- columns ---------------------------------------------------------------

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids one after another, ids per row) for slices of the column."""
        for part in texts(column):
            raw = [part.raw(i).decode("utf-8", "replace") for i in range(part.n)]
            fast = [self._latin(t) for t in raw]
            flat, counts = self._encode_latin([f for f in fast if f is not None])
            if None in fast:
                flat, counts = self._merge(raw, fast, flat, counts)
            yield part.first, flat, counts

    def _latin(self, text: str) -> bytes | None:
        """The lower-cased text as Latin-1, if the array path covers it."""
        if "'" in text or "\0" in text or any(s in text for s in self.special):
            return None
        try:
            text.encode("latin-1")
            return text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _merge(self, raw, fast, flat, counts):
        starts = np.cumsum(counts) - counts
        out, k = [], 0
        for text, f in zip(raw, fast, strict=True):
            if f is None:
                out.append(self._encode_any(text))
            else:
                out.append(flat[starts[k]:starts[k] + counts[k]])
                k += 1
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def _encode_any(self, text: str) -> np.ndarray:
        """Any text: its words are encoded apart (white space never joins a pre-token);
        words the array path covers go there, the others to the tokenizer."""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        fast = [self._latin(w) for w in words]
        slow = [w for w, f in zip(words, fast, strict=True) if f is None]
        flat, counts = self._encode_latin([f for f in fast if f is not None])
        starts = np.cumsum(counts) - counts
        more = iter(self.full.encode_batch_fast(slow, add_special_tokens=False)) if slow else iter(())
        out, k = [np.zeros(0, self.dtype)], 0
        for f in fast:
            if f is None:
                out.append(np.array(next(more).ids, dtype=self.dtype))
            else:
                out.append(flat[starts[k]:starts[k] + counts[k]])
                k += 1
        return np.concatenate(out)

    # -- the array path --------------------------------------------------------

    def _encode_latin(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        buf = np.frombuffer(b"".join(rows), dtype=np.uint8)
        if not len(buf):
            return np.zeros(0, self.dtype), np.zeros(len(rows), dtype=np.int64)
        kind = self.kind[buf]
        first = np.empty(len(buf), dtype=bool)  # a pre-token, or a run of spaces, begins
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == _DIGIT
        begin = np.cumsum(sizes) - sizes
        first[begin[sizes > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(buf))
        real = kind[starts] != _SPACE
        starts, ends = starts[real], ends[real]
        at, size = self._look_up(buf, starts, ends - starts)
        total = np.cumsum(size, dtype=np.int64)
        place = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at - (total - size), size)
        flat = self.pool[place]
        row = np.searchsorted(begin, starts, side="right") - 1
        return flat, np.bincount(row, weights=size, minlength=len(rows)).astype(np.int64)

    def _look_up(self, buf, starts, lens) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each pre-token in the pool."""
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        keep = np.array([(1 << (8 * min(n, 8))) - 1 for n in range(17)], dtype=np.uint64)
        short = lens <= 16
        n = np.where(short, lens, 16)
        key = np.empty((len(starts), 2), dtype=np.uint64)  # the bytes themselves: no hash, no clash
        key[:, 0] = view[starts].view("<u8")[:, 0] & keep[np.minimum(n, 8)]
        key[:, 1] = view[starts + 8].view("<u8")[:, 0] & keep[np.maximum(n - 8, 0)]
        slot = (mix(key[:, 0] ^ mix(key[:, 1])) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        held = self.key[slot]
        hit = short & (held[:, 0] == key[:, 0]) & (held[:, 1] == key[:, 1])
        at, size = self.at[slot], self.len[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            at[miss], size[miss] = self._learn(buf, starts, lens, key, slot, miss, at, size, hit)
        return at, size

    def _learn(self, buf, starts, lens, key, slot, miss, at, size, hit):
        raw = buf.tobytes()
        words = [raw[s:s + n] for s, n in zip(starts[miss].tolist(), lens[miss].tolist(), strict=True)]
        new = dict.fromkeys(words)
        plain = [w.decode("latin-1") for w in new]
        ids, ends = [np.zeros(0, np.int64)], []
        for i in range(0, len(plain), 2000):
            part = plain[i:i + 2000]
            got = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            stop = np.flatnonzero(self.ends[got]) + 1
            if len(stop) != len(part):
                raise ValueError("the vocabulary does not end each pre-token with a word-end token")
            ends.append(stop)
            ids.append(got)
        flat = np.concatenate(ids)
        base = np.cumsum([0] + [len(x) for x in ids[1:]])[:-1]
        stops = np.concatenate([e + b for e, b in zip(ends, base, strict=True)])
        begin = np.concatenate([[0], stops[:-1]])
        if self.used + len(flat) > len(self.pool):
            # start the table anew, keeping what this call still points to
            old = self.pool
            mine = np.flatnonzero(hit)
            total = np.cumsum(size[mine], dtype=np.int64)
            kept = old[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at[mine] - (total - size[mine]), size[mine])]
            self._clear()
            if len(kept) + len(flat) > len(self.pool):
                self.pool = np.zeros(2 * (len(kept) + len(flat)), dtype=self.dtype)
            self.pool[:len(kept)] = kept
            at[mine] = total - size[mine]
            self.used = len(kept)
        self.pool[self.used:self.used + len(flat)] = flat
        order = {w: i for i, w in enumerate(new)}
        which = np.fromiter((order[w] for w in words), dtype=np.int64, count=len(words))
        place, count = self.used + begin[which], (stops - begin)[which]
        self.used += len(flat)
        short = lens[miss] <= 16
        s = slot[miss][short]
        # several new words can want one slot: the last one written holds all its fields
        self.key[s], self.at[s], self.len[s] = key[miss][short], place[short], count[short]
        return place, count
