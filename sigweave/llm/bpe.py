"""Byte-level BPE over Arrow batches, with each distinct piece of text encoded once.

Ids never cross the bounds of pre-tokens, so a text's ids are those of its pre-tokens end to end.
Plain Latin texts are split by classes of bytes; others are cut before their single spaces, where
the pre-tokenizer always cuts too, and the chunks split by its pattern. Pre-tokens are
dictionary-encoded, and only those not met before go to the tokenizer. Texts in which a space
stands inside a run of white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: White space in the pattern's sense, a space, then white space or the end.
RUN = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}] (?:[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]|$)"
#: The split pattern of byte-level BPE, a fixed value of the vocabulary's format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "Ġ"  # how the byte alphabet writes a space
CACHE = 300_000
JOINED = 2_000
#: Longer texts (in bytes) are encoded in parts, cut before a space that follows a letter or digit, where the pattern always cuts.
LONG = 2 << 20
CUT = regex.compile(r"(?<=[\p{L}\p{N}]) ")

#: Kinds of bytes: a single space, other white space, letters (as lead and trail bytes of U+00C0 to U+027F), digits, others.
SINGLE, BLANK, REFUSED = 0, 1, 9
CLASS = np.full(256, 4, np.uint8)
CLASS[32], CLASS[9:14], CLASS[48:58] = SINGLE, BLANK, 3
CLASS[65:91] = CLASS[97:123] = CLASS[0x80:0xC0] = CLASS[0xC3:0xCA] = 2
CLASS[[39, 0xC0, 0xC1, 0xC2]] = CLASS[28:32] = CLASS[0xCA:256] = REFUSED


def byte_alphabet() -> dict[int, str]:
    """Byte to character: printable bytes stand for themselves, the others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeEncoder:
    """Encodes batches of texts to ids; keeps the first ``CACHE`` pre-tokens or so."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.spaced = Tokenizer.from_file(path)
        self.spaced.encode_special_tokens = True
        self.spaced.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_alphabet()
        self.find = regex.compile(PRETOKEN).findall
        vocab = self.whole.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        # Pre-tokens met before, all their ids end to end, and where each one's begin and how many these are.
        self.known, self.store = pa.array([""], pa.large_string()), np.zeros(0, "<u4")
        self.begin, self.lens = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``words``, in some order, and where each word's begin and how many these are."""
        listed, order, streams, lens = words.to_pylist(), [], [], np.zeros(len(words), np.int64)
        blank = np.fromiter(map(str.isspace, listed), bool, len(listed))
        led = np.fromiter((w[0] == " " for w in listed), bool, len(listed))
        for i in np.flatnonzero(blank).tolist():
            ids = np.array(self.whole.encode(listed[i], add_special_tokens=False).ids, "<u4")
            lens[i] = len(ids)
            order.append(np.array([i]))
            streams.append(ids)
        for group, glue in ((led & ~blank, " "), (~led & ~blank, f" {SPACE} ")):
            group = np.flatnonzero(group)
            for at in range(0, len(group), JOINED):
                part = group[at : at + JOINED]
                written = "\n".join([listed[i] for i in part.tolist()]).encode("utf-8").decode("latin-1").translate(self.letters)
                line = glue.join(written.split(self.letters[10]))
                ids = np.array(self.spaced.encode(line, add_special_tokens=False).ids, "<u4")
                cuts = np.flatnonzero(self.begins[ids])
                if glue == " ":
                    n = np.diff(cuts, append=len(ids))
                else:
                    n = np.diff(cuts, prepend=-1, append=len(ids)) - 1
                    ids = np.delete(ids, cuts)
                if len(n) != len(part):
                    raise AssertionError("pre-tokens and ids don't line up")
                lens[part] = n
                order.append(part)
                streams.append(ids)
        order = np.concatenate(order)
        begin = np.empty(len(listed), np.int64)
        begin[order] = np.cumsum(lens[order]) - lens[order]
        return np.concatenate(streams), begin, lens

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of ``words`` begin and how many these are; only words not met before are encoded."""
        at = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy()
        store, begin, lens, new = self.store, self.begin[at], self.lens[at], np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            ids, begin[new], lens[new] = self._encode_new(fresh)
            begin[new] += len(store)
            store = np.concatenate([store, ids])
            if len(self.known) + len(new) <= CACHE:
                self.known, self.store = pa.concat_arrays([self.known, fresh]), store
                self.begin, self.lens = np.append(self.begin, begin[new]), np.append(self.lens, lens[new])
        return store, begin, lens

    def _gather(self, store: np.ndarray, begin: np.ndarray, lens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries ``row`` end to end, and each entry's number."""
        each = lens[row]
        ends = np.cumsum(each)
        return store[np.arange(ends[-1]) + np.repeat(begin[row] - ends + each, each)], each

    def _latin(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the texts that bytes alone can split into pre-tokens, and which these are.

        They have Latin letters up to U+027F, no apostrophe and no two white spaces in a row.
        """
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        data = data[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind = CLASS[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[bounds] = True
        head = begins[:-1]
        wrong = kind == REFUSED
        follows = ~head[1:]
        wrong[1:] |= (kind[1:] <= BLANK) & (kind[:-1] <= BLANK) & follows
        wrong[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        own = np.ones(n, bool)
        own[np.searchsorted(bounds, np.flatnonzero(wrong), side="right") - 1] = False
        own &= np.diff(bounds) > 0
        starts = head.copy()
        starts[1:] |= (kind[1:] <= BLANK) | ((kind[1:] != kind[:-1]) & (kind[:-1] != SINGLE))
        if not own.all():
            starts &= np.repeat(own, np.diff(bounds))
        at = np.flatnonzero(starts)
        if not len(at):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), own
        if own.all():
            cuts = np.append(at, len(data))
            words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        else:
            inside = np.repeat(own, np.diff(bounds))
            moved = np.cumsum(inside) - inside
            data = np.ascontiguousarray(data[inside])
            cuts = np.append(moved[at], len(data))
            words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        stream, each = self._gather(*self._look_up(coded.dictionary), coded.indices.to_numpy())
        text_of = np.searchsorted(bounds, at, side="right") - 1
        counts = np.bincount(text_of, weights=each, minlength=n).astype(np.int64)
        return stream, counts[own], own

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts that are not empty, cut before their single spaces."""
        odd = pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.zeros(len(texts), np.int64)
        stream = np.zeros(0, "<u4")
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if len(parts):
            sizes = pc.list_value_length(parts).to_numpy()
            coded = pc.list_flatten(parts).dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            codes = coded.indices.to_numpy().astype(np.int64) * 2 + 1  # odd: a space stands before
            firsts = np.cumsum(sizes) - sizes
            codes[firsts] -= 1
            used = np.zeros(2 * len(coded.dictionary), bool)
            used[codes] = True
            keys = np.flatnonzero(used)
            words = coded.dictionary.to_pylist()
            found = [self.find(" " + words[k >> 1] if k & 1 else words[k >> 1]) for k in keys.tolist()]
            known = list({w for ws in found for w in ws})
            store, begin, n = self._look_up(pa.array(known, pa.large_string()))
            raw, begin, n = store.tobytes(), 4 * begin, 4 * n
            held = {w: raw[a : a + size] for w, a, size in zip(known, begin.tolist(), n.tolist())}
            ids = [b"".join([held[w] for w in ws]) for ws in found]
            lens = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
            place = np.zeros(len(used), np.int64)
            place[keys] = np.arange(len(keys))
            stream, each = self._gather(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lens) - lens, lens, place[codes])
            counts[~odd] = np.add.reduceat(each, firsts)
        if not odd.any():
            return stream, counts
        wholes = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        counts[odd] = [len(w) for w in wholes]
        return merged(odd, counts, np.concatenate(wholes), stream), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's number of ids. A null text has none.

        Texts beyond ``LONG`` are encoded part by part, so memory follows their ids, not the work on them.
        """
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        long = np.flatnonzero(pc.binary_length(texts).to_numpy() > LONG)
        if not len(long):
            return self._encode(texts)
        ids, counts, at = [], [], 0
        for i in [*long.tolist(), len(texts)]:
            if i > at:
                own, n = self._encode(texts.slice(at, i - at))
                ids.append(own)
                counts.append(n)
            if i < len(texts):
                own = [self._encode(pa.array([part], pa.large_string()))[0] for part in parts(texts[i].as_py())]
                ids.extend(own)
                counts.append(np.array([sum(map(len, own))], np.int64))
            at = i + 1
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        if not len(texts):
            return np.zeros(0, "<u4"), counts
        stream, counts_own, own = self._latin(texts)
        counts[own] = counts_own
        rest = ~own & (pc.binary_length(texts).to_numpy() > 0)
        if not rest.any():
            return stream, counts
        other, counts[rest] = self._chunks(texts.filter(pa.array(rest)))
        return merged(rest, counts, other, stream), counts


def parts(text: str) -> Iterator[str]:
    """``text`` cut where pre-tokens end, in parts of ``LONG`` / 2 characters or, where no cut follows, more."""
    at = 0
    while m := CUT.search(text, at + LONG // 2):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def merged(chosen: np.ndarray, counts: np.ndarray, theirs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Ids in order of texts, from those of the ``chosen`` texts and those of the others."""
    out = np.empty(int(counts.sum()), "<u4")
    mask = np.repeat(chosen, counts)
    out[mask], out[~mask] = theirs, others
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> BpeEncoder:
    """One encoder for each Python worker."""
    return BpeEncoder(path)
