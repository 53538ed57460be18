"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that can end its encoding: among
the vocabulary tokens that are suffixes of the prefix, the one that is compatible with the
last token of the prefix before it. An automaton over the vocabulary yields these suffixes,
a pair test undoes merges to decide compatibility, and the back-pointers of the whole
pre-token spell its ids. The result equals rank-ordered merging without simulating it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import per_text, text_of, text_udf

#: White space as the tokenizer's normaliser sees it.
WHITE_SPACE = r"\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below U+0250 a table of letters and numbers stands for the letter and number classes, which does not change between
#: versions of Unicode. What lies beyond is normalised and parted by the tokenizers library itself, whose tables decide.
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
_ASCII = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9"}
_LATIN = {r"\p{L}": r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe"}
#: Pre-tokens kept per worker with their ids, in number and letters; past either the store is emptied and fills anew.
STORE, STORE_LETTERS = 250_000, 8_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value, by the public byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return [out[b] for b in range(256)]


def _spelled_out(pattern: str, letters: dict[str, str]) -> str:
    for name, these in letters.items():
        pattern = pattern.replace(f"[{name}]", f"[{these}]").replace(name, these)
    return pattern


class _Store(dict):
    """Pre-tokens met so far with their ids, within STORE and STORE_LETTERS; very long ones are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.letters = encode, 0

    def __missing__(self, word: str) -> bytes:
        got = self.encode(word)
        if len(word) <= STORE_LETTERS >> 8:
            self.letters += len(word)
            if len(self) >= STORE or self.letters > STORE_LETTERS:
                self.clear()
                self.letters = len(word)
            self[word] = got
        return got


class WordBpe:
    """Encoder and decoder for a tokenizers file with word-end BPE over byte-level letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.pieces: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t for t, i in self.special.items()}
        self._special = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._path, self._parts = path, next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = self._parts["pattern"]["Regex"].replace("\\s", WHITE_SPACE)
        self._ascii_words, self._latin_words = (re.compile(_spelled_out(pattern, x)).findall for x in (_ASCII, _LATIN))
        self._between_spaces = re.compile(f"[^{WHITE_SPACE}]+").findall
        self.latin_line_words = re.compile(_spelled_out(pattern, _LATIN) + r"|\n").findall
        self._letters = dict(enumerate(byte_alphabet()))
        self.store = _Store(self._entry)
        #: stretches between white space that hold code points beyond Latin, with their ids
        self.others = _Store(lambda stretch: b"".join(map(self.store.__getitem__, self._library_words(stretch))))
        self._merges(vocab, model["merges"])

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        """What the dynamic programme needs: merges and the automaton over the tokens."""
        #: (left, right) -> rank of their merge, and of each token the pair it is merged from.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, rank
        self._compatible = lru_cache(1 << 16)(self._undo)
        self.automaton = ahocorasick.Automaton()
        self._end = "\0"
        #: letters of each token that the automaton knows, the word's end counting as one
        self.sizes: dict[int, int] = {}
        for token, i in vocab.items():
            if self.suffix and token.endswith(self.suffix):
                key = token[: -len(self.suffix)] + self._end
            else:
                key = token
            if self._merges_to_itself(i):
                self.automaton.add_word(key, (len(key), i))
                self.sizes[i] = len(key)
        self.automaton.make_automaton()

    def _merges_to_itself(self, token: int) -> bool:
        """Whether the two parts of a token, side by side, would really be merged into it."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._undo(a, b, self.born[token])

    def _undo(self, left: int, right: int, bound: int | None = None) -> bool:
        """Whether left and right stay apart until the merge of rank `bound` (None: for ever).

        The tokens that touch the seam are taken apart, latest merge first. While a pair of
        them touches, no merge across the seam may come before the merge that ends its time.
        """
        born, rank, parts = self.born, self.rank, self.parts
        until = bound if bound is not None else len(rank) + 1
        #: until: the pair (left, right) touches before the merge of this rank; ties go left to right
        strict = True
        while True:
            r = rank.get((left, right))
            if r is not None and (r < until or (r == until and not strict)):
                return False
            x, y = born.get(left, -1), born.get(right, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                until, strict, left = x, True, parts[left][1]
            else:
                # a merge of equal rank at the seam starts further left, so it would go first
                until, strict, right = y, False, parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token in byte-level letters. A prefix's last token tells where the prefix before it ends."""
        n = len(word)
        last = array("i", [-1]) * (n + 2) if n > 4096 else [-1] * (n + 2)
        compatible = self._compatible
        for end, (size, token) in self.automaton.iter(word + self._end):
            at = end + 1
            if last[at] >= 0:
                continue
            before = at - size
            if before == 0 or (last[before] >= 0 and compatible(last[before], token)):
                last[at] = token
        at = n + 1 if last[n + 1] >= 0 else 0
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]

    def _entry(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self._letters)
        ids = self.encode_word(mapped)
        return struct.pack(f"<{len(ids)}I", *ids)

    @cached_property
    def _library(self) -> tuple:
        """The library's normaliser and the part of its pre-tokenizer that cuts, as functions of a text."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        cut = pre_tokenizers.Split(Regex(self._parts["pattern"]["Regex"]), self._parts["behavior"].lower(), self._parts["invert"])
        return Tokenizer.from_file(self._path).normalizer.normalize_str, cut.pre_tokenize_str

    def _library_words(self, text: str) -> list[str]:
        normalize, cut = self._library
        return [word for word, _ in cut(normalize(text))]

    def pre_tokens(self, text: str) -> list[str]:
        """The words of a text between special tokens: NFC, each letter in lower case; white space only parts words."""
        low = text.lower()
        if text.isascii():
            return self._ascii_words(low)
        if _BEYOND_LATIN.search(text) or _BEYOND_LATIN.search(low):
            return self._library_words(text)
        return self._latin_words(low)

    def _ids(self, text: str) -> Iterator[bytes]:
        """The ids of a text between special tokens, word by word. No word goes across white space, and no letter is composed across it."""
        if text.isascii() or not (_BEYOND_LATIN.search(text) or _BEYOND_LATIN.search(text.lower())):
            yield from map(self.store.__getitem__, self.pre_tokens(text))
            return
        for stretch in self._between_spaces(text):
            if stretch.isascii() or not (_BEYOND_LATIN.search(stretch) or _BEYOND_LATIN.search(stretch.lower())):
                yield from map(self.store.__getitem__, self.pre_tokens(stretch))
            else:
                yield self.others[stretch]

    def _segments(self, text: str) -> Iterator[tuple[bool, str]]:
        if self._special is None or "<|" not in text:
            yield False, text
            return
        at = 0
        for m in self._special.finditer(text):
            yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        yield False, text[at:]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for special, part in self._segments(text):
            if special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += self._ids(part)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined by blanks, as a tokenizer without a decoder does; unknown ids vanish."""
        return " ".join([self.pieces[i] for i in ids if i in self.pieces])


@lru_cache(2)
def encoder(path: str) -> WordBpe:
    """One encoder per worker process and vocabulary file."""
    return WordBpe(path)


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 of the ids of the whole text and of what they decode to.

    Null text counts as empty; an empty text has no ids and decodes to the empty string.
    Ids of any type, null and repeated ones pass through as they are. Each row is handled
    alone, without any shuffle; other columns are ignored.
    """

    def digest(texts: list[str]) -> list:
        bpe, n, a, b = encoder(path), [], [], []
        for text in texts:
            raw = bpe.encode_bytes(text)
            n.append(len(raw) // 4)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4").tolist()).encode("utf-8")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return per_text(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with the ids of each text as array<int>; an existing column of that name is replaced."""
    encode = text_udf("array<int>", lambda texts: [np.frombuffer(encoder(path).encode_bytes(t), "<u4").astype("int32") for t in texts], pa.list_(pa.int32()))
    return docs.withColumn(ids_col, encode(text_of(text_col)))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """rows with the decoded text of each id array; null ids give an empty text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = encoder(path)
        return pa.array([bpe.decode(x.as_py() or []) for x in ids], pa.string())

    return rows.withColumn(text_col, decode(F.col(ids_col)))
