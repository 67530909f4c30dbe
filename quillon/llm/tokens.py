"""Token counts by the whole-token shortcut.

Offline step (:func:`prove`): every vocabulary entry is decoded and encoded
alone.  Those that form one pre-token and come back as their own single id are
*proven*: a pre-token that equals one of them is one token, no merges needed.
The online step splits a text into pre-tokens, adds one for each proven one and
runs the merges only for the rest (with a bounded cache).

The character classes of the pre-tokeniser are read off the library itself for
the code points up to U+024F and for common punctuation; a text with any other
character is encoded by the library as a whole, so that differences between
Unicode versions cannot change a count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blocks, built, share, table

#: Code points whose classes are probed.
PROBED = [*range(0x250), *range(0x2010, 0x2028), 0x20AC]
#: Bound of the cache of merged pre-tokens, and longest pre-token it keeps.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 64


@dataclass(frozen=True)
class Proof:
    """What the offline step finds; its size is bounded by the vocabulary."""

    json: str
    pattern: str
    unsafe: str
    specials: tuple[str, ...]
    proven: dict[str, int]


def _byte_table() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def prove(path: str) -> Proof:
    """Probe character classes and find the strings that encode alone as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    one = lambda s: len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
    letters, digits, others, spaces = [], [], [], []
    for c in map(chr, PROBED):
        home = [kind for kind, probe in ((letters, "a"), (digits, "1"), (others, "!"), (spaces, "\n")) if one(probe + c)]
        if len(home) == 1 and one(c):
            home[0].append(c)
    cls = lambda chars: "".join(re.escape(c) for c in chars)
    a, n, o, s = map(cls, (letters, digits, others, spaces))
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[{o}]+|[{s}]+(?![^{s}])|[{s}]+"
    unsafe = rf"[^{a}{n}{o}{s}]"
    split, odd = re.compile(pattern), re.compile(unsafe)
    back = {v: k for k, v in _byte_table().items()}
    strings: list[tuple[str, int]] = []
    specials = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not odd.search(text) and split.findall(text) == [text] and not any(x in text for x in specials):
            strings.append((text, k))
    encoded = tokenizer.encode_batch([x for x, _ in strings], add_special_tokens=False)
    return Proof(tokenizer.to_str(), pattern, unsafe, specials, {x: k for (x, k), e in zip(strings, encoded) if e.ids == [k]})


class Encoder(dict):
    """Pre-token to its count (or, with ``ids``, to its little-endian ids)."""

    def __init__(self, proof: Proof, ids: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(proof.json)
        self.find, self.odd = re.compile(proof.pattern).findall, re.compile(proof.unsafe).search
        self.ids = ids
        self.special = {x: self.value([self.tokenizer.token_to_id(x)]) for x in proof.specials}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(proof.specials, key=len, reverse=True))) + ")").split if proof.specials else lambda text: [text]
        self.stand_in = _byte_table()
        self.proven = {x: self.value([k]) for x, k in proof.proven.items()}
        super().__init__(self.proven)

    def value(self, ids: list[int]):
        return b"".join(k.to_bytes(4, "little") for k in ids) if self.ids else len(ids)

    def __missing__(self, token: str):
        merged = self.tokenizer.model.tokenize(token.encode().decode("latin-1").translate(self.stand_in))
        found = self.value([t.id for t in merged])
        if len(token) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[token] = found
        return found

    def parts(self, text: str) -> list:
        found = []
        for k, piece in enumerate(self.cut(text)):
            if k % 2:
                found.append(self.special[piece])
            elif piece and self.odd(piece):
                found.append(self.value(self.tokenizer.encode(piece, add_special_tokens=False).ids))
            elif piece:
                found.extend(map(self.__getitem__, self.find(piece)))
        return found

    def _plain(self, text: str) -> bool:
        """Whether a text has neither special strings nor characters of unknown class."""
        return not any(x in text for x in self.special) and not self.odd(text)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(text)) if self._plain(text) else self.parts(text))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)) if self._plain(text) else self.parts(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text.

    Null texts count as empty (0 tokens); null ids, repeated rows and ties are
    kept row by row; other columns of ``docs``, whatever their names, are not
    read.  An empty table gives an empty result.  ``path``: a byte-level BPE
    file of the tokenizers library with the usual English-contraction split.
    """
    shared = share(docs.sparkSession, prove(path or default_path()))

    def count(frames):
        own = built(shared, Encoder, False)
        for frame in blocks(frames, "text"):
            n = [own.count(x) for x in frame["text"]]
            size = [len(x.encode()) for x in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "n_bytes": size, "n_tokens": n, "over_limit": [k > limit for k in n]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op9_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
