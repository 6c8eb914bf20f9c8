"""Byte-level BPE encoding and decoding (operator 1).

Ranks are turned into a model of the tokenizers library: every way to make a token of two
tokens becomes a merge, in rank order, so that the library merges whatever pair has the
lowest joined rank. Texts are cut at spaces that precede a word, where no match of the
pattern can cross, and each distinct piece is encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import Known, added, lean, list_of, list_parts, ragged, slices, without

#: Parts of texts that a worker keeps encoded.
CACHE_PIECES = 300_000
#: A space or none, letters, and signs at the end: two matches of a pattern that parts letters from signs.
_STEM_AND_SIGNS = r"^(?P<stem> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-/:-@\[-`{-~]+)$"
#: White space of Unicode beyond ASCII, on whose classes regular expression engines differ.
_RARE = "\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿"
_RARE_SPACE = re.compile(f"[{_RARE}]")
#: Texts in which some space isn't followed by a word, and empty texts.
_ODD = f"[{_RARE}]| [ \t\n\r\x0b\x0c]| \\z|^\\z"
_BEFORE_WORD = re.compile("(?= [^ \t\n\r\x0b\x0c])")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """An encoder and decoder for one rank file and one pattern, made once in each worker."""

    _made: dict[tuple[str, str], ByteBpe] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        import numpy as np

        self.path, self.pattern, self._tokenizer = path, pattern, None
        ranks = read_ranks(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.known = Known(CACHE_PIECES, self._learn)
        self._parted: bool | None = None

    @property
    def tokenizer(self):
        """The library's model of the ranks; decoding alone does without it."""
        if self._tokenizer is None:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Regex, Tokenizer, models, pre_tokenizers

            shown = byte_characters()
            spell = {token: "".join(shown[b] for b in token) for token in self.tokens if token}
            merges = [(spell[t[:k]], spell[t[k:]]) for t in self.tokens for k in range(1, len(t)) if t[:k] in spell and t[k:] in spell]
            model = models.BPE(vocab={spell[t]: r for r, t in enumerate(self.tokens) if t}, merges=merges, ignore_merges=True, cache_capacity=0)
            self._tokenizer = Tokenizer(model)
            self._tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
        return self._tokenizer

    @property
    def parted(self) -> bool:
        """Whether the pattern parts letters from the signs after them."""
        if self._parted is None:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ab?!' Ün&.")
            self._parted = [span for _, span in cut] == [(0, 3), (3, 6), (6, 9), (9, 11)]
        return self._parted

    def _learn(self, pieces: list[str]):
        import numpy as np

        counts, ids = [], []
        for at in range(0, len(pieces), 20_000):
            own = [np.array(c.ids, dtype="<i4") for c in self.tokenizer.encode_batch_fast(pieces[at : at + 20_000], add_special_tokens=False)]
            counts += map(len, own)
            ids += [np.concatenate(own)]
        return np.array(counts, dtype=np.int64), np.concatenate([*ids, np.empty(0, "<i4")])

    def encode(self, texts: pa.Array):
        """(ends, ids): the end of each text's ids, and all ids. A null text has none.

        In most texts every space stands before a word, so that Arrow's split finds the pieces
        and a dictionary of them; the others are cut one by one.
        """
        import numpy as np

        texts = pc.fill_null(texts, "")
        is_odd = pc.match_substring_regex(texts, _ODD)
        odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False))
        plain = texts if not len(odd) else pc.if_else(is_odd, "", texts)
        words = pc.split_pattern(plain, " ")
        heads = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # All but the first of a text have the space before them.
        later = pc.binary_join_element_wise(pa.scalar(""), coded.dictionary, " ")
        codes[heads[:-1]] = len(later) + np.arange(len(texts))
        pieces = [later, words.values.take(pa.array(heads[:-1]))]
        if len(odd):
            own = {k: _pieces(texts[k].as_py()) for k in odd.tolist()}
            parts, at, held = [], 0, len(later) + len(texts)
            for k in odd.tolist():
                parts += [codes[heads[at] : heads[k]], np.arange(len(own[k])) + held]
                held += len(own[k])
                at = k + 1
            pieces.append(pa.array([x for k in odd.tolist() for x in own[k]], type=pa.string()))
            sizes = np.diff(heads)
            sizes[odd] = [len(own[k]) for k in odd.tolist()]
            codes = np.concatenate([*parts, codes[heads[at] :]])
            heads = np.concatenate([[0], np.cumsum(sizes)])
        first = pa.concat_arrays(pieces)
        second = pa.nulls(len(first), pa.string())
        if self.parted:
            cut = pc.extract_regex(first, _STEM_AND_SIGNS)
            first, second = pc.if_else(cut.is_valid(), pc.struct_field(cut, "stem"), first), pc.struct_field(cut, "signs")
        return self.known.encoded(first, second, codes, heads)

    def decode(self, ends, ids) -> pa.Array:
        """The bytes of each row's ids, given the offsets of the rows."""
        import numpy as np

        places, each = ragged(self.starts, self.sizes, ids)
        upto = np.concatenate([[0], np.cumsum(each)])[ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(upto), pa.py_buffer(self.bytes[places])])


def _pieces(text: str) -> list[str]:
    if not text:
        return []
    return [text] if _RARE_SPACE.search(text) else _BEFORE_WORD.split(text)


def spans(text: str, lengths) -> tuple[list[int], list[int]]:
    """Start and end of each token in characters, from its tokens' lengths in bytes.

    A token that holds part of a character has the span of the whole character.
    """
    import numpy as np

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    ends = np.cumsum(lengths)
    if not len(ends) or ends[-1] != len(data):
        return [], []
    upto = np.cumsum((data & 0xC0) != 0x80)
    return (upto[ends - lengths] - 1).tolist(), upto[ends - 1].tolist()


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", offsets: bool = False, back: bool = False) -> DataFrame:
    """df with `ids` (array<int>), with `starts` and `ends` in characters if offsets, and with
    `decoded` (binary), what decode() makes of the ids, if back: in one pass of one worker.

    Each match of the pattern in the whole text is encoded by itself, without special tokens.
    A null or empty text gets an empty list. Columns of df named like the new ones are replaced;
    all others stay, repeated rows too. Offsets need a pattern that covers every character.
    """
    names = ["ids", "starts", "ends"][: 3 if offsets else 1]
    kinds: dict[str, T.DataType] = dict.fromkeys(names, T.ArrayType(T.IntegerType()))
    kinds |= {"decoded": T.BinaryType()} if back else {}
    df = without(df, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = ByteBpe.of(ranks, pattern)
        for batch in slices(batches, text):
            ends, ids = coder.encode(batch.column(text))
            new = [list_of(ends, ids)]
            if offsets:
                sizes = np.split(coder.sizes[ids], ends[:-1])
                both = [spans(t or "", n) for t, n in zip(batch.column(text).to_pylist(), sizes)]
                new += [pa.array([b[k] for b in both], type=pa.list_(pa.int32())) for k in (0, 1)]
            if back:
                new.append(coder.decode(np.concatenate([[0], ends]), ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds])

    return df.mapInArrow(lean(run), added(df, **kinds))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with `decoded` (binary): the bytes of the ids in their order.

    Bytes, not text, since ids may begin or end inside a character; decoded_text() makes text
    of them. Null or empty ids give empty bytes. An existing column `decoded` is replaced.
    """
    df = without(df, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(ranks, pattern)
        for batch in slices(batches, ids):
            decoded = coder.decode(*list_parts(batch.column(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(lean(run), added(df, decoded=T.BinaryType()))


def decoded_text(parts: pa.Array) -> list[str]:
    """Text of consecutive byte parts (such as the windows of a token stream).

    A character split between two parts comes whole with the later one; bytes that never
    become a character are replaced by U+FFFD.
    """
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    given = pc.fill_null(parts, b"").to_pylist() if isinstance(parts, (pa.Array, pa.ChunkedArray)) else list(parts)
    return [reader.decode(part, final=k == len(given) - 1) for k, part in enumerate(given)]
