"""Token ids of whole texts by a public byte-level tokenizer file, piece by piece through a bounded cache."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from symloom.llm.shared import worker_state

#: About 200 bytes each; a worker holds at most twice as many.
CACHED_WORDS = 300_000
LONGEST_CACHED = 48
PIECES_AT_ONCE = 400
#: Texts are cut into pieces in blocks of about so many bytes.
BLOCK_BYTES = 4 << 20

# A space as byte-level vocabularies write it.
SPACE_BYTE = "Ġ"

# Classes of bytes; what is not told for sure is OTHER (no white space) or UNSURE.
UNSURE, LETTER, DIGIT, MARK, OTHER, SPACE, LINE_END, APOSTROPHE = range(8)


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 0x80:
        return OTHER
    if char in " \n'":
        return {" ": SPACE, "\n": LINE_END, "'": APOSTROPHE}[char]
    if char.isalnum():
        return LETTER if char.isalpha() else DIGIT
    return MARK if char.isprintable() else UNSURE


def _cut_between(before: int, after: int) -> int:
    """1: a cut; 2: a cut if the line's end before is a piece of its own; else 0."""
    solid = {LETTER, DIGIT, MARK, APOSTROPHE, OTHER}
    if before == LINE_END and after in solid:
        return 2
    if before in solid and after in (SPACE, LINE_END):
        return 1
    # An apostrophe may begin a contraction with the letters after it, and is a mark otherwise.
    runs = {LETTER: 0, DIGIT: 1, MARK: 2, APOSTROPHE: 2}
    return int(before in runs and after in runs and before != APOSTROPHE and runs[before] != runs[after])


CLASSES = bytes(_class_of(byte) for byte in range(256))
CUTS = bytes(_cut_between(pair >> 3, pair & 7) if pair < 64 else 0 for pair in range(256))
#: Classes of the characters that UTF-8 writes in two and in three bytes.
TWO_BYTES = np.array([LETTER if chr(c).isalpha() else UNSURE if chr(c).isspace() else OTHER for c in range(1 << 11)], np.uint8)
WHITE = np.array([c for c in range(1 << 11, 1 << 16) if chr(c).isspace()])


def piece_starts(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that lie in ``data``, as UTF-8, between ``bounds``; the bounds are among the places.

    A cut is made before a space or a line's end that follows no white space, after a single line's end before none, and where
    letters, digits and ASCII marks meet, but for what follows an apostrophe. All are ends of a byte-level tokenizer's
    pre-tokens, and no piece but a single line's end ends with white space that has something after it.
    """
    classes = np.frombuffer(bytearray(data.translate(CLASSES)), np.uint8)
    if not data.isascii():
        row = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((row >= 0xC2) & (row <= 0xDF))
        classes[at] = classes[at + 1] = TWO_BYTES[(row[at] & np.uint16(0x1F)) << np.uint16(6) | row[at + 1] & 0x3F]
        # White space of three bytes begins with E1, E2 or E3.
        at = np.flatnonzero((row >= 0xE1) & (row <= 0xE3))
        code = (row[at] & np.int64(0x0F)) << 12 | (row[at + 1] & np.int64(0x3F)) << 6 | row[at + 2] & 0x3F
        at = at[np.isin(code, WHITE)]
        classes[at] = classes[at + 1] = classes[at + 2] = UNSURE
    pairs = (classes[:-1] << np.uint8(3) | classes[1:]).tobytes()
    cuts = np.frombuffer(b"\0" + pairs.translate(CUTS) + b"\0", np.uint8)
    inside = cuts == 1
    inside[bounds] = True
    after_line = np.flatnonzero(cuts == 2)
    inside[after_line[inside[after_line - 1]]] = True
    return np.flatnonzero(inside)


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text; the driver reads it once and sends it along (1 to 2 MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


class WordEncoder:
    """Encodes texts as the tokenizers library does; ids of short pieces are kept and used again.

    A text is cut where the tokenizer cuts, too, so its ids are those of its pieces. The different pieces of a block of
    texts are looked up once; those not met before go to the model, if they are one pre-token for sure, or else to the whole tokenizer,
    many as one text, whose ids are given back to the pieces by their bytes. Pieces are kept in two generations: when the
    younger one holds ``CACHED_WORDS`` it becomes the older one, and what is met again moves to the next, so frequent ones stay.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            # Byte-level vocabularies write each byte as one character.
            self.id_bytes[number] = len(token)

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ids of pieces that begin with a space and end with none: one encoded text, cut by bytes."""
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            some = pieces[at : at + PIECES_AT_ONCE]
            ids = self._encode_all([b"".join(some).decode()])[0]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            cuts = 4 * (np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(sizes), side="left") + 1)
            data, start = ids.tobytes(), 0
            for end in cuts.tolist():
                yield data[start:end]
                start = end

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces not met before."""
        found, spaced, alone, tokenize = {}, [], [], self.model.tokenize
        for piece in pieces:
            text = piece.decode()
            after_space = text[0] == " "
            if text.isascii() and (text[1:] if after_space else text).isalpha():
                # One pre-token, so the model alone decides.
                tokens = tokenize(SPACE_BYTE + text[1:] if after_space else text)
                found[piece] = array("I", [token.id for token in tokens]).tobytes()
            elif after_space and not text[-1].isspace():
                spaced.append(piece)
            else:
                alone.append(piece)
        found.update(zip(spaced, self._encode_pieces(spaced), strict=True))
        found.update(zip(alone, [ids.tobytes() for ids in self._encode_all([p.decode() for p in alone])], strict=True))
        return found

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        ids = list(map(words.get, pieces))
        missing = [k for k, known in enumerate(ids) if known is None]
        found = {pieces[k]: older[pieces[k]] for k in missing if pieces[k] in older}
        found.update(self._learn([pieces[k] for k in missing if pieces[k] not in found]))
        for k in missing:
            ids[k] = found[pieces[k]]
            if len(pieces[k]) <= LONGEST_CACHED:
                words[pieces[k]] = ids[k]
        return ids

    def _encode_block(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        starts = piece_starts(data, bounds)
        buffers = [None, pa.py_buffer(starts), pa.py_buffer(data)]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, buffers).dictionary_encode()
        ids = pa.array(self._look_up(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        _, places, held = ids.buffers()
        ends = np.frombuffer(places, np.int64, len(starts))[np.searchsorted(starts, bounds)].tolist()
        whole = held.to_pybytes()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        encoded, block, size = [], [], 0
        for text in texts:
            block.append(text.encode())
            size += len(block[-1])
            if size >= BLOCK_BYTES:
                encoded += self._encode_block(block)
                block, size = [], 0
        return encoded + self._encode_block(block)


def vocabulary_size(tokenizer_json: str) -> int:
    """One more than the largest id that the tokenizer gives."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values()) + 1


def encoder(tokenizer_json: str) -> WordEncoder:
    """The encoder of this Python worker."""
    state = worker_state("encoders")
    key = hash(tokenizer_json)
    if key not in state:
        state[key] = WordEncoder(tokenizer_json)
    return state[key]
