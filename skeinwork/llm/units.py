"""Token ids of whole texts, exactly as the tokenizers library gives them, from the tokenizer's own file.

ByteIds is for byte-level BPE: the file's vocabulary, whose ids are merge ranks, drives tiktoken, which splits by the same
pattern and merges by rank. tests/llm compare it with the library over every code point and on random texts; a text with a
run of white space that its matcher gives up on goes to the library.

WordIds is for lower-casing word BPE. White space is dropped before merging, so a text is cut at spaces and line ends and each
distinct piece is looked up. A piece of printable ASCII and Latin-1 letters, without the apostrophe and "<", is split into
letters, single digits and signs as the file's pattern does, lower-cased (simple there, and NFC changes nothing), and each
part is merged by the library's model. All other pieces, so any that could hold a special string, go through the library
as they are. A special string has no space, so no cut runs through one.

WordRuns gives the same ids for a whole Arrow column: its distinct pieces are found by Arrow, the parts of all simple ones
are merged in two calls of tiktoken, numpy puts the ids in the order of the texts. Merging by rank is the file's merging where
no two merges make the same string, and only strings that the library makes whole from their own characters have a rank: a
string that comes up inside a longer one was merged from its own characters alone, in the same order.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64  # characters; longer pieces are not kept
# Pattern of byte-level BPE, as in the file's split rule.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_SUFFIX = "</w>"
# Characters that no simple piece holds: the end of a part, the end of a piece.
_PART, _PIECE = "\x00", "\x01"
_MARKED = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}{_PIECE}]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def library(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    return Tokenizer.from_file(path)


class ByteIds:
    """Ids of a text by byte-level BPE."""

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = library(path)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        code = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(map(code.__getitem__, w)): k for w, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in special}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # white space too long for its matcher
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class WordIds(dict):
    """Piece to its ids as little-endian bytes (16 bits an id where the vocabulary fits); at most `limit` short pieces are kept."""

    def __init__(self, path: str, limit: int = 800_000):
        super().__init__()
        self.tokenizer, self.limit = library(path), limit
        self.model, alphabet = self.tokenizer.model, byte_alphabet()
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.spelled = {c: "".join(map(alphabet.__getitem__, chr(c).encode())) for c in range(0x80, 0x100)}
        self.known: dict[str, object] = {}  # parts that need no merge
        self.parts: dict[str, object] = {}

    def cut(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def value(self, ids: list[int]):
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def joined(self, values: list):
        return b"".join(values)

    def part(self, part: str):
        """Value of one pre-token, already lower-cased: looked up, else merged by the library."""
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else part.translate(self.spelled)
            found = self.value([t.id for t in self.model.tokenize(spelled)])
            if len(self.parts) >= self.limit:
                self.parts = dict(self.known)
            if len(part) <= LONGEST:
                self.parts[part] = found
        return found

    def __missing__(self, piece: str):
        if _SIMPLE.fullmatch(piece):
            low = piece.lower()
            found = self.part(low) if low.isalpha() else self.joined([self.part(p) for p in _PARTS.findall(low)])
        else:
            found = self.value(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text)))


def word_ranks(tokenizer) -> dict[bytes, int] | None:
    """Ids of the strings of a word BPE by their bytes, `_PART` for the end of a word; None where ranks don't say what is merged."""
    from tokenizers.models import BPE

    model = json.loads(tokenizer.to_str())["model"]
    if model.get("end_of_word_suffix") != _SUFFIX or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    alphabet = byte_alphabet()
    made = ["".join((a, b)) for a, b in merges]
    base = [c + end for c in alphabet for end in ("", _SUFFIX)]
    places = [vocab[w] for w in made]
    if not vocab.keys() >= {*base} or len({*made, *base}) != len(made) + len(base) or max(vocab[w] for w in base) > min(places, default=1 << 32) or places != sorted(places):
        return None
    whole, inner = tokenizer.model, BPE(vocab, merges)  # the second without an end of words
    code = {c: b for b, c in enumerate(alphabet)}
    ranks = {bytes([b]): vocab[c] for c, b in code.items()}
    for w in base + made:
        end = w.endswith(_SUFFIX) and len(w) > len(_SUFFIX)
        spelled = w.removesuffix(_SUFFIX) if end else w
        raw = bytes(map(code.__getitem__, spelled))
        if not {0, 1} & {*raw} and [t.id for t in (whole if end else inner).tokenize(spelled)] == [vocab[w]]:
            ranks[raw + _PART.encode() * end] = vocab[w]
    return ranks


class WordRuns:
    """Ids of all texts of an Arrow column by word BPE, as WordIds gives them: each distinct piece is merged once, many in a call."""

    def __init__(self, path: str):
        import tiktoken

        self.words = WordIds(path)
        self.dtype = np.dtype(self.words.dtype)
        self.ranks = word_ranks(self.words.tokenizer) or {}
        if self.ranks:
            self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=r"[^\x00\x01]+\x00|\x01", mergeable_ranks=self.ranks, special_tokens={})
            self.last = np.zeros(1 + max(self.ranks.values()), bool)  # ids that end a word
            self.last[[k for w, k in self.ranks.items() if w.endswith(_PART.encode())]] = True

    def of_letters(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of letters alone one after another, and each piece's number of ids."""
        ids = self.encoding.encode_to_numpy(_strung(pieces, _PART).lower())
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def of_mixed(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of all other simple pieces."""
        ids = self.encoding.encode_to_numpy(_MARKED.sub(rf"\g<0>{_PART}", _strung(pieces, _PIECE).lower()))
        ends = np.flatnonzero(ids == self.ranks[_PIECE.encode()])
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def of_others(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.words.__getitem__, pieces.to_numpy(zero_copy_only=False)))  # faster than to_pylist
        return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces in any order, each piece's start there and its number of ids."""
        letters = simple = np.zeros(len(pieces), bool)
        if self.ranks:
            short = pc.less_equal(pc.binary_length(pieces), LONGEST)
            letters, simple = (
                pc.and_(short, pc.match_substring_regex(pieces, f"^{p}$")).to_numpy(zero_copy_only=False) for p in (f"[{_LETTERS}]+", _SIMPLE.pattern)
            )
        places = [np.flatnonzero(x) for x in (letters, simple & ~letters, ~simple)]
        found = [of(pieces.take(pa.array(x))) for of, x in zip((self.of_letters, self.of_mixed, self.of_others), places, strict=True) if len(x)]
        order, n = np.concatenate(places), np.concatenate([n for _, n in found])
        starts, sizes = np.empty((2, len(pieces)), np.int64)
        starts[order], sizes[order] = np.cumsum(n) - n, n
        return np.concatenate([ids.astype(self.dtype) for ids, _ in found]), starts, sizes

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (at least one; null: empty) one after another, and each text's number of ids."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        ids, starts, sizes = self.distinct(coded.dictionary)
        piece = coded.indices.to_numpy()
        n = sizes[piece]
        ends = np.cumsum(n)
        at = np.repeat(starts[piece] - ends + n, n)
        at += np.arange(len(at))
        return ids[at], np.diff(ends[np.cumsum(cut.value_lengths().to_numpy()) - 1], prepend=0)


def _strung(pieces: pa.Array, end: str) -> str:
    """All pieces, each with its end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), end)[0].as_py() + end


_LOADED: dict[tuple, object] = {}


def loaded(kind, path: str, *more):
    """One instance of ByteIds, WordIds, a subclass or WordRuns a worker process and file: it outlives a task where workers are reused."""
    key = kind, path, *more
    if key not in _LOADED:
        _LOADED[key] = kind(path, *more)
    return _LOADED[key]
