"""Public tokenizers applied to whole texts, cut where no token can cross.

A text is cut into pieces at boundaries that the vocabulary itself proves to be
safe, each distinct piece goes through the tokenizer library once per worker
while it stays in a bounded cache, and the results are joined.  The ids are
those the library gives for the whole text.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

CACHE_PIECES = 700_000
SEGMENT_CHARS = 1 << 20

_encoders: dict[str, "Encoder"] = {}


def load(path: str) -> "Encoder":
    """The encoder of a vocabulary file, kept for the life of the Python worker."""
    if path not in _encoders:
        _encoders[path] = SentencePieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return _encoders[path]


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("packed ids need four-byte little-endian integers")


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Encoder:
    """Cuts texts into pieces and keeps what the library made of each piece."""

    _cuts = False
    cache_pieces = CACHE_PIECES
    flush_chars = 4 * SEGMENT_CHARS

    def __init__(self) -> None:
        self._known: dict[str, bytes] = {"": b""}

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its packed ids.  A batch should hold a few MB of text."""
        found: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        chars = 0
        for row, text in enumerate(texts):
            for segment in segments(text) if self._cuts else (text,):
                waiting.append((row, self.pieces(segment)))
                chars += len(segment)
                if chars > self.flush_chars:
                    self._flush(waiting, found)
                    waiting, chars = [], 0
        self._flush(waiting, found)
        return [b"".join(parts) for parts in found]

    def _flush(self, waiting: list[tuple[int, list[str]]], found: list[list[bytes]]) -> None:
        """Encode what is new in one call of the library, then look everything up."""
        new = set().union(*(pieces for _, pieces in waiting)).difference(self._known)
        if len(self._known) + len(new) > self.cache_pieces:
            self._known = {"": b""}
            new = set().union(*(pieces for _, pieces in waiting), ("",))
        listed = list(new)
        if listed:
            self._known.update(zip(listed, self.encode_pieces(listed)))
        look = self._known.__getitem__
        for row, pieces in waiting:
            found[row].append(b"".join(map(look, pieces)))


# A single space between two letters or digits of ASCII: neither white space
# rules nor normalisation can reach across it in any of the supported files.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def segments(text: str) -> Iterator[str]:
    """Parts of a long text, cut at single spaces, which are dropped.

    Every kind of file treats the start of a text as it treats a word after a
    single space, so the parts encode to the ids of the whole.  A text without
    such a place stays whole.
    """
    start = 0
    while len(text) - start > SEGMENT_CHARS:
        found = _SAFE.search(text, start + SEGMENT_CHARS)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


# Stands for a space that no word follows; no text can hold half a surrogate pair.
_LONE = "\ud800"


def _is_cut(text: str) -> bool:
    """A text that holds the vocabulary's own sign for a space stays whole."""
    return "▁" not in text


class SentencePieceEncoder(Encoder):
    """A ``.model`` file.

    Pieces are cut before runs of spaces and before line ends if the vocabulary
    shows that no token reaches across: an identity normaliser with the space
    put in front of the text, no symbols of the user's own, no piece with a
    space after another character, no piece with a line end.  Otherwise a text
    is one piece.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        self._cuts = (
            not normal.precompiled_charsmap
            and normal.add_dummy_prefix
            and normal.escape_whitespaces
            and not normal.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and all(piece.type != piece.USER_DEFINED for piece in model.pieces)
            and not any("▁" in piece.piece.lstrip("▁") or "\n" in piece.piece for piece in model.pieces)
        )

    def pieces(self, text: str) -> list[str]:
        if not self._cuts:
            return [text]
        if not text:
            return []
        if not _is_cut(text):
            return [text]
        if "  " in text or " \n" in text or text[0] == " " or text[0] == "\n" or text[-1] == " ":
            found = re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)
            return [piece if piece[0] == "\n" else piece[1:] or _LONE for piece in found]
        return text.replace("\n", " \n").split(" ")

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not self._cuts:
            return [pack(ids) for ids in self._library.encode(pieces, num_threads=1)]
        # A piece that starts with a line end follows no space, so the space
        # that the library puts in front of it is taken off again.
        texts = ["\n" if piece == _LONE else piece for piece in pieces]
        return [
            pack(ids[:1] if piece == _LONE else ids[1:] if piece[:1] == "\n" and _is_cut(piece) else ids)
            for piece, ids in zip(pieces, self._library.encode(texts, num_threads=1))
        ]


# Closing marks; a run of them is always one run to the splitting rule.
_MARKS = ".,;:!?#$%&*)"
NUMBERED_PIECES = 600_000


class _Numbers(dict):
    """Pieces by number; a piece that is looked up for the first time gets the next one."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class _Numbered:
    """Numbered pieces and their ids: all ids in one array, where those of each piece begin and how many they are."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self._ids = np.zeros(0, np.uint32)
        self._first, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, older: "_Numbered", encode_pieces) -> None:
        """The ids of the pieces that are new: from an older generation, or from the library."""
        new, self.numbers.new = self.numbers.new, []
        look = older.numbers.get
        at = np.fromiter([look(piece, -1) for piece in new], np.int64, len(new))
        unseen = np.flatnonzero(at < 0)
        packed = encode_pieces([new[n] for n in unseen.tolist()])
        count = np.empty(len(new), np.int64)
        count[unseen] = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        # First what the older generation has, then what it has not.
        order = np.argsort(at < 0, kind="stable")
        seen = at[order[: len(new) - len(unseen)]]
        count[order[: len(seen)]] = older._count[seen]
        first = np.empty(len(new), np.int64)
        first[order] = len(self._ids) + np.cumsum(count[order]) - count[order]
        self._ids = np.concatenate([self._ids, older.gather(seen)[0], np.frombuffer(b"".join(packed), np.uint32)])
        self._first, self._count = np.concatenate([self._first, first]), np.concatenate([self._count, count])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of pieces, and how many there are up to each piece."""
        counts = self._count[numbers]
        ends = np.cumsum(counts)
        return self._ids[np.repeat(self._first[numbers] - ends + counts, counts) + np.arange(counts.sum())], ends


class JsonEncoder(Encoder):
    """A ``.json`` file of the tokenizers library, without added special tokens.

    Pieces are cut at spaces and line ends if the file drops white space;
    otherwise a text is one piece.  Among the pieces, plain words (letters of
    the Latin blocks, which normalise one by one) are looked up in lower case
    and without closing punctuation where the file lower-cases.
    """

    numbered_pieces = NUMBERED_PIECES

    def __init__(self, path: str) -> None:
        super().__init__()
        import json

        import tokenizers

        self._library = tokenizers.Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._cuts = self._drops_white_space(spec)
        self._now, self._before = _Numbered(), _Numbered()
        self._bytes = _ByteLetters()

    @staticmethod
    def _drops_white_space(spec: dict) -> bool:
        """The rules under which a word is encoded alone as it is in a text."""
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [s for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"]
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and len(splits) == 1
            and splits[0]["behavior"] == "Removed"
            and splits[0]["invert"]
            and {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            in spec["pre_tokenizer"]["pretokenizers"]
            and "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in splits[0]["pattern"]["Regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        )

    def pieces(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ") if self._cuts else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its packed ids: pieces become numbers, and numbers gather ids, a few MB at a time.

        Two generations of pieces are held.  When the newer one is full it becomes
        the older one, from which pieces that come again are taken over.
        """
        if not self._cuts:
            return super().encode(texts)
        found: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []
        chars = 0
        for row, text in enumerate(texts):
            for segment in segments(text):
                pieces = self.pieces(segment)
                waiting.append((row, np.fromiter(map(self._now.numbers.__getitem__, pieces), np.int32, len(pieces))))
                chars += len(segment)
                if chars > 4 * SEGMENT_CHARS:
                    self._gather(waiting, found)
                    waiting, chars = [], 0
        self._gather(waiting, found)
        return [b"".join(parts) for parts in found]

    def _gather(self, waiting: list[tuple[int, np.ndarray]], found: list[list[bytes]]) -> None:
        if not waiting:
            return
        self._now.learn(self._before, self.encode_pieces)
        ids, ends = self._now.gather(np.concatenate([numbers for _, numbers in waiting]))
        start = piece = 0
        for row, numbers in waiting:
            piece += len(numbers)
            end = int(ends[piece - 1])
            found[row].append(ids[start:end].tobytes())
            start = end
        if len(self._now.numbers) > self.numbered_pieces:
            self._now, self._before = _Numbered(), self._now

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not self._cuts:
            return self._one_by_one(pieces)
        parts: list[tuple[str, str] | None] = []
        others: set[str] = set()
        known: dict[str, bytes] = {"": b""}
        tokenize, letters = self._library.model.tokenize, self._bytes
        for piece in pieces:
            word = piece.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or max(word) < "ɐ" and "İ" not in word):
                word, marks = word.lower(), piece[len(word) :]
                parts.append((word, marks))
                if word not in known:
                    # One run of letters: normalised and split already, so the
                    # merges of the vocabulary are all that is left to do.
                    spelt = word if word.isascii() else word.translate(letters)
                    known[word] = pack([token.id for token in tokenize(spelt)])
                if marks not in known:
                    others.add(marks)
            else:
                parts.append(None)
                others.add(piece)
        listed = list(others)
        rest = dict(zip(listed, self._one_by_one(listed)))
        known.update((marks, rest[marks]) for part in parts if part and (marks := part[1]) in rest)
        return [known[p[0]] + known[p[1]] if p else rest[piece] for p, piece in zip(parts, pieces)]

    def _one_by_one(self, pieces: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(pieces, add_special_tokens=False)
        return [pack(one.ids) for one in found]


class _ByteLetters(dict):
    """Letters to the letters that stand for their bytes, as the library maps them."""

    def __missing__(self, code: int) -> str:
        from tokenizers import pre_tokenizers

        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))
        self[code] = "".join(part for part, _ in mapped)
        return self[code]
