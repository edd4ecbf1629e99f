"""Token ids of whole texts, cut into pieces of bounded length."""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import SEPARATORS

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_OF_DOCUMENT = 0
#: Words whose ids a worker remembers at most, in each of two generations.
REMEMBERED = 300_000
_SPACES = bytes.maketrans(b"\t\n\x0b\f\r", b"     ")
#: Letters below are in their composed form, and all versions of Unicode agree which they are.
_SAFE = "\u0250"
_PUNCTUATION = string.punctuation.encode()
#: The letters by which byte-level models spell bytes that aren't printable Latin-1.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}
#: The normalizer that turns each run of white space into one space.
COLLAPSE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
_encoders: dict[str, Encoder] = {}


def parts_of(definition: dict | None, kind: str, each: str) -> list[dict]:
    """The steps of a tokenizer's normalizer or pre-tokenizer, of which a sequence may hold several."""
    if definition is None:
        return []
    return definition[each] if definition["type"] == kind else [definition]


def drops_spaces(definition: dict) -> bool:
    """Whether the pre-tokenizer keeps only what its pattern finds, and the pattern finds no white space."""
    first = next(iter(parts_of(definition["pre_tokenizer"], "Sequence", "pretokenizers")), None)
    if not first or first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return False
    try:
        found = regex.compile(first["pattern"]["Regex"])
    except (KeyError, regex.error):
        return False
    return not any(re.search(r"\s", m[0]) for a in " a1.'" for b in " a1.'" for space in SEPARATORS for m in found.finditer(a + space + b))


def keeps_letters(definition: dict) -> bool:
    """Whether the pre-tokenizer (one that :func:`drops_spaces`) leaves a run of letters whole and cuts it from
    ASCII punctuation after it, and then only spells bytes as letters."""
    first, *rest = parts_of(definition["pre_tokenizer"], "Sequence", "pretokenizers")
    if [(r["type"], r["add_prefix_space"], r["use_regex"]) if r["type"] == "ByteLevel" else None for r in rest] != [("ByteLevel", False, False)]:
        return False
    found = regex.compile(first["pattern"]["Regex"])
    cut = lambda t: [m[0] for m in found.finditer(t)]
    letters = [c for c in map(chr, range(ord(_SAFE))) if c.isalpha()]
    marks = _PUNCTUATION.decode()
    whole = ["".join(letters) * 9, *(a + b for a in "alrstvmde" for b in letters), *(b + a for a in "alrstvmde" for b in letters)]
    return all(cut(w) == [w] for w in whole) and all(cut(c + a + b) == [c, *cut(a + b)] for a in marks for b in ["", *marks] for c in ("s", "ab", "é"))


def is_safe(text: str) -> bool:
    """Letters that normalizers leave as they are; a lowered İ ends in a mark, which is no letter."""
    return text.isalpha() and max(text) < _SAFE


class Known(dict):
    """Ids of words by word; those not held come from older ones or are learned, and stay."""

    def __init__(self, learn: Callable[[bytes], bytes], older: dict[bytes, bytes]):
        super().__init__()
        self.learn, self.older = learn, dict(older)

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.older.get(word) or self.learn(word)
        return ids


class Encoder:
    """Ids of texts.

    Where the tokenizer drops white space, no token crosses it, so a text's ids are those
    of its words in order and each worker remembers the ids of words it has met; words
    not met for a while are forgotten.  Which tokenizers do is read from their definition.
    Other tokenizers get whole texts, and so does a text that holds an added token in
    whatever case: those are found in the raw text, before any word is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.learn, {})
        definition = json.loads(self.tokenizer.to_str())
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        steps = parts_of(definition["normalizer"], "Sequence", "normalizers")
        self.lowers = any(n["type"] == "Lowercase" for n in steps)
        #: Whether ASCII case is dropped, and a comma or stop after a letter stands alone.
        self.folds = self.lowers and encode("Ab,C. d.") == encode("ab ,c . d .") and encode("ab,c. d.") == encode("ab ,c . d .")
        self.added = [t["content"].lower().encode() for t in definition["added_tokens"] if t["content"]]
        plain = all(n["type"] in ("NFC", "Lowercase") or n == COLLAPSE for n in steps) and definition["model"]["type"] == "BPE" and definition["model"]["dropout"] is None
        self.by_word = plain and definition["truncation"] is None and definition["post_processor"] is None and drops_spaces(definition)
        #: Whether letters alone go to the model as one piece.
        self.direct = self.by_word and keeps_letters(definition)
        self.model = self.tokenizer.model

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def pieces(self, letters: str) -> bytes:
        """Ids of a run of letters, as the model has them."""
        ids = [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, word: bytes) -> bytes:
        """Ids of a word not met before.  Letters go to the model without the tokenizer's
        other steps; a word that ends in a letter and punctuation is the word before the
        punctuation and the punctuation."""
        if self.direct:
            if word.isalpha():
                return self.pieces((word.lower() if self.lowers else word).decode())
            stem = word.rstrip(_PUNCTUATION)
            if len(stem) < len(word) and (stem[-1:].isalpha() or is_safe(stem.decode()[-1:].lower())):
                return self.known[stem] + self.known[word[len(stem) :]]
            text = word.decode().lower() if self.lowers else word.decode()
            if is_safe(text):
                return self.pieces(text)
        return self.whole([word.decode()])[0]

    def words(self, text: str) -> list[bytes] | None:
        """The text's words, None where an added token may stand among them."""
        data = text.encode("utf-8", "replace").translate(_SPACES)
        low = data.lower()
        if any(token in low for token in self.added):
            return None
        if self.folds and b"\xcc" not in data and b"\xcd" not in data:  # else a combining mark may join a letter of one case only
            data = low
        return data.split(b" ")

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self.whole(texts)
        if len(self.known) > REMEMBERED:
            self.known = Known(self.learn, self.known)
        found = []
        for text in texts:
            words = self.words(text)
            found.append(self.whole([text])[0] if words is None else b"".join(map(self.known.__getitem__, words)))
        return found

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


def encoder(tokenizer: str) -> Encoder:
    """This process's encoder; a bare file name means one of the installed public vocabularies."""
    if tokenizer not in _encoders:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _encoders[tokenizer] = Encoder(path)
    return _encoders[tokenizer]


def encoded(texts: Iterable[str | None], tokenizer: str, at_once: int = 1 << 17) -> Iterator[bytes]:
    """Ids of each text, null as empty, with the end-of-document id; texts are encoded in
    groups of about ``at_once`` characters."""
    group, size, end = [], 0, END_OF_DOCUMENT.to_bytes(4, "little")
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= at_once:
            yield from (ids + end for ids in encoder(tokenizer).ids_of(group))
            group, size = [], 0
    if group:
        yield from (ids + end for ids in encoder(tokenizer).ids_of(group))


def texts_in(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, one at a time: all of them as Python's would be the batch again."""
    return (t.as_py() for t in batch["text"])


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, ids before it, its ids) of each piece of a document's ids."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        yield piece, at // 4, ids[at : at + 4 * capacity]


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str = DEFAULT_TOKENIZER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty and gives the end-of-document id alone.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    fields = [base.schema["doc_id"], *(StructField(n, LongType()) for n in ("piece", "start", "length", "ids_crc32"))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, whole in enumerate(encoded(texts_in(batch), tokenizer)):
                rows += [(at, piece, start, len(ids) // 4, zlib.crc32(ids)) for piece, start, ids in pieces_of(whole, capacity)]
            found = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(fields)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(found[0]), *found[1:]], names=[f.name for f in fields])

    return base.mapInArrow(cut, StructType(fields))
