"""Byte-pair encoding by a traversal of the trie of distinct words, and decoding.

The last token of each prefix determines the encoding: a prefix ends in the one token that is a suffix of it and
may follow the last token of what stands before. So a node of the trie needs one number, its last token, and
the encodings of all prefixes that words share are found once. Words in sorted order are the trie in depth-first
order: what a word shares with the one before it is on the stack already.

Whether one token may follow another is decided by playing the merges backwards. On the seam between them stand,
at any time, a token of the left one's right edge and one of the right one's left edge; the pair holds unless some
such pair would itself have been merged before one of the two was taken into a larger token.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import CACHED, LONG, PARTS, Recent, encoded, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
#: Pairs of tokens that a worker keeps judged.
PAIRS = 500_000
#: Parts of these characters are cut by WORD, which there agrees with the tokenizer's own splitter.
PLAIN = re.compile("[ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n0-9{_LETTER}]+|[ \n]+(?![^ \n])|[ \n]+")


@functools.cache
def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Bpe:
    """A byte-level BPE vocabulary from a tokenizer's file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in _byte_chars().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of: dict[int, bytes] = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        #: When each token is made (bytes: before all else), and of what.
        self.made: dict[int, int] = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = self.ids[left + right]
            self.rank[self.ids[left], self.ids[right]] = n
            if whole not in self.parts:
                self.made[whole], self.parts[whole] = n, (self.ids[left], self.ids[right])
        if any(len(t) > 1 and i not in self.parts for t, i in self.ids.items()):
            raise ValueError("the vocabulary has tokens that no merge makes")
        #: Every end of a token's bytes, and the token it is, if any.
        self.ends = {t[i:]: -1 for t in self.ids for i in range(len(t))} | self.ids
        self.follows: dict[int, bool] = {}
        self._library = Tokenizer.from_file(path)
        self._to_byte = {c: b for b, c in _byte_chars().items()}
        self.words, self.known = Recent(CACHED), Recent(PARTS)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of two tokens is these two."""
        key = left << 32 | right
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            found = self.follows[key] = self._may_follow(left, right)
        return found

    def _may_follow(self, left: int, right: int) -> bool:
        never = len(self.rank)
        left_taken = right_taken = never  # when each is merged into what it is a part of here
        while True:
            at = self.rank.get((left, right), never)
            # of equal pairs the leftmost is merged first: one that overlaps on the left wins, on the right it loses
            if at < left_taken and at <= right_taken and at < never:
                return False
            if self.made[left] > self.made[right]:
                left_taken, left = self.made[left], self.parts[left][1]
            elif right in self.parts:
                right_taken, right = self.made[right], self.parts[right][0]
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words as little-endian unsigned 32-bit integers: a walk over their trie."""
        out: dict[bytes, bytes] = {}
        ends, follow = self.ends.get, self.may_follow
        before = b""
        last: list[int] = [-1]  # the last token of each prefix of the word walked
        size: list[int] = [0]  # and its length
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                may, start = [], end - 1
                while start >= 0 and (token := ends(word[start:end])) is not None:
                    if token >= 0:
                        may.append((start, token))
                    start -= 1
                for start, token in reversed(may):
                    if follow(last[start], token) if start else self._alone(token):
                        last.append(token)
                        size.append(end - start)
                        break
            tokens, at = array("I"), len(word)
            while at:
                tokens.append(last[at])
                at -= size[at]
            tokens.reverse()
            out[word] = tokens.tobytes()
            before = word
        return out

    def _alone(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as it: its parts may follow each other once their own merge is left out."""
        if token not in self.parts:
            return True
        key = -1 - token
        found = self.follows.get(key)
        if found is None:
            left, right = self.parts[token]
            found = self.follows[key] = self._alone(left) and self._alone(right) and self._first_seam(left, right)
        return found

    def _first_seam(self, left: int, right: int) -> bool:
        """As ``may_follow``, but for the merge of the two tokens themselves."""
        merge = self.rank[left, right]
        left_taken = right_taken = merge
        while True:
            if self.made[left] > self.made[right]:
                left_taken, left = self.made[left], self.parts[left][1]
            elif right in self.parts:
                right_taken, right = self.made[right], self.parts[right][0]
            else:
                return True
            at = self.rank.get((left, right), merge)
            if at < left_taken and at <= right_taken and at < merge:
                return False

    def _cut(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, as the tokenizer's own splitter has them."""
        if PLAIN.fullmatch(text):
            return [w.encode() for w in WORD.findall(text)]
        return [bytes(map(self._to_byte.__getitem__, w)) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """A text's stretches without special tokens, and special tokens, leftmost and then longest first."""
        while text:
            hits = [(text.find(t), -len(t), t) for t in self.special if t in text]
            if not hits:
                break
            at, _, token = min(hits)
            yield text[:at], None
            yield token, self.special[token]
            text = text[at + len(token) :]
        yield text, None

    def _learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct parts of texts."""
        cut: dict[str, list[bytes | int]] = {}
        for p in parts:
            if not self._odd(p):
                cut[p] = self._cut(p)
            else:
                cut[p] = [w for s, i in self._segments(p) for w in (self._cut(s) if i is None else [i])]
        used = {w for ws in cut.values() for w in ws if type(w) is bytes}
        self.words.now.update(self.encode_words(self.words.lacking(used)))
        words = self.words.now
        out = {p: b"".join([words[w] if type(w) is bytes else w.to_bytes(4, "little") for w in ws]) for p, ws in cut.items()}
        for w in used:
            if len(w) > LONG:
                del words[w]
        self.words.aged()
        return out

    def _odd(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A text is cut before each space that stands between two characters that are no white space, or after one
        that is: the splitter never joins what stands on either side. Distinct parts are encoded once.
        """
        return encoded(texts, _parts, self.known, self._learn)

    def decode(self, ids: bytes) -> str:
        """The text of ids: the bytes of all tokens, special ones included, together; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _parts(text: str) -> list[str]:
    """Parts of a text, cut before single spaces that are followed by no white space; else the text is one part."""
    pieces = text.split(" ")
    rest = pieces[1:]
    if not rest:
        return pieces
    for p in rest:
        if not p or p[0].isspace():
            return [text]
    return [pieces[0], *[" " + p for p in rest]] if pieces[0] else [" " + p for p in rest]


_loaded: dict[str, Bpe] = {}


def load(name: str = TOKENIZER) -> Bpe:
    if name not in _loaded:
        _loaded[name] = Bpe(tokenizer_file(name))
    return _loaded[name]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` for every row.

    A null text counts as empty and has no ids. Rows are encoded on their own, repeated ones included. Other
    columns are left out, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(ids: bytes, text: str) -> tuple[bytes, str]:
        return ids, text

    return _mapped(docs, id_col, text_col, tokenizer, f"`{id_col}` {id_type}, ids binary, decoded string", of, [pa.binary(), pa.string()], ["ids", "decoded"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """As ``round_trip``, but the count of the ids and the SHA-256 of the ids and of the decoded text, made where they arise."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(ids: bytes, text: str) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(docs, id_col, text_col, tokenizer, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", of, [pa.int64(), pa.string(), pa.string()], names)


def _mapped(docs, id_col, text_col, tokenizer, schema, of, types, names) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                made = [of(ids, bpe.decode(ids)) for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[i] for m in made], t) for i, t in enumerate(types)]], names=[id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
