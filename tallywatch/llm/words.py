"""Token ids of many texts, each distinct space-separated piece being encoded once.

The tokenizers in use split a text into pre-tokens that never cross from a character that is no
white space into a space. Cut there, the pieces of a text can be encoded one by one and their ids
put together; a piece seen before costs one look-up. Pieces keep their leading space.

A piece of letters, digits and marks is further cut into its runs, at places where every tokenizer
in use begins a pre-token: behind a letter or digit before a mark, and the other way round, and
around a line break. Texts have far fewer distinct runs than pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np

from tallywatch.llm.common import kept, spans_of

#: Characters that no library takes for white space; a cut before a space is made only behind one of them.
SOLID = r"!-~¡-ᙿᚁ-᠍᠏-῿⁰-⿿、-﻾＀-\U0010ffff"
#: Kinds of bytes in UTF-8. Runs of a plain piece are of one kind: 1 letters (of ASCII and U+00C0 to U+00FF) and digits, 2 marks, 3 a line
#: break. Bytes of kind 0 are in no plain piece; an apostrophe begins a pre-token with letters, and 97 and B7 behind C3 make signs.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 2
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = 1
KIND[[0x27, 0x97, 0xB7]] = 0
KIND[0x0A] = 3


def runs_of(pieces):
    """(runs of all strings of an Arrow array in order, how many each string has); one that is not plain is one run.

    A plain string holds bytes above 0 in KIND, and line breaks only one at a time between others.
    """
    import pyarrow as pa

    upto = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
    starts, ends = upto[:-1] - upto[0], upto[1:] - upto[0]
    kind = KIND[data]
    # A run begins at a byte of another kind than the one before.
    begins = np.zeros(len(data) + 1, bool)
    begins[1 : len(data)] = kind[1:] != kind[:-1]
    odd = kind == 0
    odd[:-1] |= (kind[:-1] == 3) & (kind[1:] == 3)
    full = ends > starts
    plain = full.copy()
    plain[full] = (kind[starts[full]] != 3) & (kind[ends[full] - 1] != 3)
    plain[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = False
    begins[:-1] &= np.repeat(plain, ends - starts)
    begins[starts] = False
    inner = np.flatnonzero(begins)
    sizes = 1 + np.diff(np.searchsorted(inner, np.append(starts, len(data))))
    cuts = np.empty(len(pieces) + len(inner) + 1, np.int64)
    first = np.zeros(len(cuts), bool)
    first[np.cumsum(sizes) - sizes] = True
    first[-1] = True
    cuts[first] = np.append(starts, len(data))
    cuts[~first] = inner
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))), sizes


def _strings(array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Encodes batches of texts; ``encode`` gives the ids of a list of pieces, whether they begin a text or not.

    When the table of known pieces holds ``limit`` pieces or ``limit`` * 16 characters, those used once are
    forgotten, or all if too many remain.
    With ``end_id``, every text ends in that id. A text in which ``whole`` matches is one piece.
    With ``parts``, plain pieces are looked up run by run. A use counts once a batch and distinct piece.
    """

    def __init__(
        self, encode: Callable[[list[str], str], tuple[np.ndarray, np.ndarray]], end_id: int | None = None, limit: int = 600_000, whole: re.Pattern | None = None,
        parts: bool = False,
    ):
        self.encode, self.end_id, self.limit, self.whole, self.parts = encode, end_id, limit, whole, parts
        self.cut = re.compile(f"(?<=[{SOLID}]) ")
        self.odd = re.compile(f" (?<=[^{SOLID}] )")  # from space to space, which is faster than from character to character
        self._forget()

    def _forget(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        # Code 0 is the end of a text.
        self.known = 1
        if self.end_id is not None:
            self.flat[0], self.lengths[0] = self.end_id, 1
        self.used, self.chars = 1, 0
        self.uses = np.zeros(1, np.int64)

    def _thin(self) -> None:
        first, later, flat, starts, lengths = self.first, self.later, self.flat, self.starts, self.lengths
        often = self.uses > 1
        self._forget()
        for old, new in ((first, self.first), (later, self.later)):
            old = {w: c for w, c in old.items() if often[c] and len(w) < 64}
            if len(old) > self.limit // 2:
                continue
            codes = np.fromiter(old.values(), np.int64, len(old))
            self._add(list(old), new, flat[spans_of(starts[codes], lengths[codes])], lengths[codes])

    def _learn(self, pieces: list[str], codes: dict[str, int], lead: str) -> None:
        self._add(pieces, codes, *self.encode(pieces, lead))

    def _add(self, pieces: list[str], codes: dict[str, int], ids: np.ndarray, sizes: np.ndarray) -> None:
        known, total = self.known, len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known + len(pieces) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + total] = ids
        self.starts[known : known + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[known : known + len(pieces)] = sizes
        codes.update(zip(pieces, range(known, known + len(pieces))))
        self.used += total
        self.known += len(pieces)
        self.chars += sum(map(len, pieces))

    def _pieces(self, texts: list[str]):
        """(distinct pieces as an Arrow array, where each text's pieces begin and end, the place of every piece among the distinct ones)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values
        odd = [i for i, text in enumerate(texts) if text[:1] == " " or (self.whole and self.whole.search(text)) or self.odd.search(text)]
        if odd:  # cut only where it is safe, or not at all
            cut, own = [], np.diff(offsets)
            parts, begin = [], 0
            for i in odd:
                text = texts[i]
                pieces = [text] if self.whole and self.whole.search(text) else self.cut.split(text)
                parts += [values.slice(begin, offsets[i] - begin), pa.array(pieces, values.type)]
                begin = offsets[i + 1]
                cut.append(len(pieces))
            parts.append(values.slice(begin))
            own[odd] = cut
            values = pa.concat_arrays(parts)
            offsets = np.concatenate([[0], np.cumsum(own)])
        coded = values.dictionary_encode()
        return coded.dictionary, offsets, coded.indices.to_numpy()

    def _codes(self, names: list[str], known: dict[str, int], lead: str) -> np.ndarray:
        codes = np.fromiter(map(known.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(codes < 0)
        if len(new):
            # New pieces are numbered in order.
            codes[new] = self.known + np.arange(len(new))
            self._learn([names[i] for i in new.tolist()], known, lead)
        return codes

    def _runs(self, pieces) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the runs of all pieces, how many each has); the first run of a piece has the leading space."""
        if not self.parts:
            return self._codes(_strings(pieces), self.later, " "), np.ones(len(pieces), np.int64)
        runs, sizes = runs_of(pieces)
        first = np.zeros(len(runs), bool)
        first[np.cumsum(sizes) - sizes] = True
        codes = np.zeros(len(runs), np.int32)
        for at, known, lead in ((first, self.later, " "), (~first, self.first, "")):
            coded = runs.filter(at).dictionary_encode()
            codes[at] = self._codes(_strings(coded.dictionary), known, lead)[coded.indices.to_numpy()]
        return codes, sizes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if self.known >= self.limit or self.chars >= 16 * self.limit:
            self._thin()
        pieces, offsets, flat = self._pieces(texts)
        # Of the pieces of a batch only the distinct ones are looked up.
        counts = np.diff(offsets) - 1
        heads, rest = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
        leads = np.zeros(len(flat), bool)
        leads[offsets[:-1]] = True
        heads[flat[leads]] = True
        rest[flat[~leads]] = True
        begun = self._codes(_strings(pieces.filter(heads)), self.first, "")
        codes, sizes = self._runs(pieces.filter(rest))
        codes, sizes = np.concatenate([begun, codes]), np.concatenate([np.ones(len(begun), np.int64), sizes])
        as_head, as_rest = np.cumsum(heads) - 1, np.cumsum(rest) + (len(begun) - 1)
        uses = np.bincount(codes, minlength=self.known)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        # The ids of every distinct piece, the end of a text behind them.
        lengths = self.lengths[codes]
        known = np.append(self.flat[spans_of(self.starts[codes], lengths)], self.flat[: self.lengths[0]])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        begins = np.cumsum(sizes) - sizes
        starts = np.append(upto[begins], upto[-1])
        lengths = np.append(upto[begins + sizes] - upto[begins], self.lengths[0])
        # Per text: its head, its other pieces, its end.
        units = np.full(len(flat) + len(texts), len(sizes), np.int32)
        ends = np.cumsum(counts + 2)
        heads_at = ends - counts - 2
        inner = np.ones(len(units), bool)
        inner[heads_at] = inner[ends - 1] = False
        units[heads_at] = as_head[flat[leads]]
        units[inner] = as_rest[flat[~leads]]
        lengths = lengths[units]
        ids = known[spans_of(starts[units], lengths)]
        return ids, np.add.reduceat(lengths, heads_at) if len(texts) else counts


def library_encoder(json_text: str, end_id: int | None = None, limit: int = 600_000, specials: bool = False) -> PieceEncoder:
    """Pieces encoded by the tokenizers library.

    Strings of special tokens in a text are ordinary text, or with ``specials`` their ids, as is the library's
    default; the library then takes a text with such a string as a whole.

    Runs of new pieces are encoded as one string, as they would stand in a text, and the ids dealt
    out by the number of bytes they stand for. A run in which an id crosses from a piece into the
    next, or bytes got lost, is encoded piece by piece.
    """
    return kept(("library", json_text, end_id, limit, specials), lambda: _library_encoder(json_text, end_id, limit, specials))


def _library_encoder(json_text: str, end_id: int | None, limit: int, specials: bool) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.encode_special_tokens = not specials
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    whole = re.compile("|".join(added)) if specials and added else None
    suffix = tokenizer.model.end_of_word_suffix or ""
    # A byte is one character of a token here; where words have an end mark, white space has no ids.
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    size_of = np.array([len(n.removesuffix(suffix)) if suffix else len(n) for n in names], np.int64)
    solid = re.compile(f"[{SOLID}]$")
    odd = re.compile(f" (?<=[^{SOLID}] )")

    def apart(pieces: list[str]):
        # The library's answers take a hundred bytes an id, so there are only a few at a time.
        for i in range(0, len(pieces), 32):
            for e in tokenizer.encode_batch_fast(pieces[i : i + 32], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def encode(pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        if not lead:
            rows = list(apart(pieces))
            return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(pieces), np.int64)
        step = 256
        runs = [pieces[i : i + step] for i in range(0, len(pieces), step)]
        joined = [lead + lead.join(run) for run in runs]
        for k, (run, text, ids) in enumerate(zip(runs, joined, apart(joined))):
            kept_text = ["".join(p.split()) for p in run] if suffix else run
            bytes_in = np.fromiter(map(len, kept_text if text.isascii() else map(str.encode, kept_text)), np.int64, len(run)) + (0 if suffix else len(lead))
            ends, marks = np.cumsum(size_of[ids]), np.cumsum(bytes_in)
            at = np.searchsorted(ends, marks, "left")
            if len(ends) and at[-1] == len(ends) - 1 and (ends[at] == marks).all() and bytes_in.all() and solid.search(text) and not odd.search(text):
                sizes[k * step : k * step + len(run)] = np.diff(at, prepend=-1)
                parts.append(ids)
            else:
                rows = list(apart([lead + p for p in run]))
                sizes[k * step : k * step + len(run)] = [len(r) for r in rows]
                parts += rows
        return np.concatenate(parts), sizes

    return PieceEncoder(encode, end_id, limit, whole, parts=True)
