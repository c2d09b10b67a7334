"""Operator 10, packing token pieces into sequences by first-fit decreasing.

Each document is encoded, ended by an end id, and cut into pieces of at most ``limit`` ids. Pieces are dealt at random,
by hash, into groups of about ``group_size``; within a group they are placed in order of falling length, each into the
first sequence with room, found by a tournament tree over the free room of the group's sequences (log n steps a piece).
A group is a bounded number of rows, whatever the documents' sources, lengths or repeated ids, and groups are
independent.

The vocabulary's pieces never span white space. Texts of Latin-1 characters, of which lower case and classes follow from
a table, are cut into pieces by array operations, several texts at once, and the vocabulary's merges are applied in one
call a text. Other texts, and those that may hold a special token, are encoded word by word behind bounded caches of
words and of their parts.

Edge cases. Null or empty text: the end id alone. A text longer than ``limit``: full pieces and a rest. Ties in length
are placed in order of doc_id and start. Repeated rows are packed once each. Bytes that aren't UTF-8 are encoded as
U+FFFD. Extra columns of documents are dropped by ``token_pieces``; ``pack`` keeps all columns of its pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.shared import broadcast_if_small, text_bytes

LIMIT, GROUP_SIZE, END_ID = 4096, 4096, 2
#: Bytes of text that are encoded together.
CHUNK = 1 << 19


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word that the vocabulary cuts into its letters, in lower case, and the marks after them: ASCII and Latin-1.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Latin-1 characters in lower case, white space as a space, and their classes as the vocabulary's pattern has them.
_LOWER = bytes(32 if chr(x) in "\t\n\x0b\x0c\r\x85\xa0" else ord(chr(x).lower()) for x in range(256))
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.array([_SPACE if x == 32 else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(x))[0], _OTHER) for x in _LOWER], np.uint8)


def latin(text: bytes) -> bytes | None:
    """A text in Latin-1; None if it has other characters, or may hold a special token, which lower case could make or break."""
    if b"<|" in text:
        return None
    try:
        return text if text.isascii() else text.decode().encode("latin-1")
    except UnicodeError:
        return None


def spaced(texts: list[bytes]) -> list[str]:
    """Latin-1 texts in lower case with a space after each of their pieces.

    Pieces are English endings after an apostrophe (``'s``, ``'re``), runs of letters, single numbers, and runs of what
    is neither of these nor white space. Latin-1 letters have one form and a lower case that doesn't depend on their place.
    """
    flat = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    kind = _CLASS[flat]
    left, right = kind[:-1], kind[1:]
    cut = ((left != right) | (left == _NUMBER)) & (left != _SPACE) & (right != _SPACE)
    at = np.flatnonzero(flat == ord("'"))
    at = at[kind[at - 1] != _OTHER]  # the last byte is a space, so the first one has a byte before it
    x, y = flat[at + 1], flat[np.minimum(at + 2, len(flat) - 1)]
    long = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
    size = np.where(long, 2, np.isin(x, np.frombuffer(b"stmd", np.uint8)))
    at, size = at[size > 0], size[size > 0]
    cut[at] = False
    cut[at + size] = kind[at + size + 1] != _SPACE
    cuts = np.flatnonzero(cut) + 1
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends = (ends + np.searchsorted(cuts, ends)).tolist()
    out = np.insert(flat, cuts, 32).tobytes().decode("latin-1")
    return [out[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def words_of(text: bytes) -> list[bytes]:
    """Words of any text that have the text's ids, one after the other."""
    return text.decode("utf-8", "replace").encode().split()


class _Cache:
    """Two generations: a full young one becomes the old one, so what is still in use survives and the size is bounded."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def missing(self, keys: set) -> list:
        young, old = self.young, self.old
        new = []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    new.append(k)
                else:
                    young[k] = v
        return new

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:  # kept while the worker lives; what a task learns isn't
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


_RANKED: dict = {}


def _ranked(path: str):
    """The vocabulary's merges over pieces that end in a space, which stands for its end mark."""
    if path not in _RANKED:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merged = model["vocab"], [model["vocab"][a + b] for a, b in model["merges"]]
        if any(a >= b for a, b in zip(merged[:-1], merged[1:])) or len(vocab) - len(merged) != 512 or min(merged) < 512:
            raise ValueError(f"the ids of {path} aren't numbered by its merges")
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]  # bytes that stand for themselves in byte-level tokens
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*shown}))}
        ranks = {bytes(map(byte.__getitem__, t.removesuffix("</w>"))) + b" " * t.endswith("</w>"): i for t, i in vocab.items()}
        _RANKED[path] = tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
    return _RANKED[path]


class WordEncoder:
    """Ids of words as little-endian 32-bit bytes. Words are looked up first, then the letters and marks of plain ones."""

    def __init__(self, path: str, most_words: int = 300_000, most_parts: int = 200_000):
        self.tokenizer, self.words, self.parts = _tokenizer(path), _Cache(most_words), _Cache(most_parts)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece of the text
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn_parts(self, parts: set[str]) -> None:
        if new := self.parts.missing(parts):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            at = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            raw, young = ids.tobytes(), self.parts.young
            for x, i, j in zip(new, at[:-1], at[1:], strict=True):
                young[x] = raw[4 * i : 4 * j]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; best with the words of several texts at once."""
        self.words.turn()
        self.parts.turn()
        known = self.words.young
        found = list(map(known.get, words))
        if None in found:
            blank = [i for i, x in enumerate(found) if x is None]
            new = self.words.missing({words[i] for i in blank})
            plain = [(w, m[1].decode().lower(), m[2].decode()) for w in new if (m := _PLAIN.fullmatch(w))]
            self._learn_parts({x for _, a, b in plain for x in ((a, b) if b else (a,))})
            part = self.parts.young
            for w, a, b in plain:
                known[w] = part[a] + part[b] if b else part[a]
            odd = [w for w in new if w not in known]
            for w, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
            for i in blank:
                found[i] = known[words[i]]
        return found


class TextEncoder:
    """Ids of texts as little-endian 32-bit bytes; best with several texts at once."""

    def __init__(self, path: str):
        self.path, self.merge = path, _ranked(path).encode_to_numpy

    @cached_property
    def words(self) -> WordEncoder:
        return WordEncoder(self.path)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        forms = [latin(t) for t in texts]
        found = (self.merge(t).astype("<u4", copy=False).tobytes() for t in spaced([x for x in forms if x is not None]))
        odd = [words_of(t) for t, x in zip(texts, forms, strict=True) if x is None]
        words = iter(self.words([w for own in odd for w in own]) if odd else ())
        others = (b"".join(islice(words, len(own))) for own in odd)
        return [next(others if x is None else found) for x in forms]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): ids as little-endian 32-bit bytes."""
    path = path or vocabulary()
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = TextEncoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts, size = iter(b.column(0).to_pylist()), [], 0

            def encoded() -> pa.RecordBatch:
                rows = []
                for doc, raw in zip(islice(ids, len(texts)), encode(texts), strict=True):
                    raw += end
                    n = len(raw) // 4
                    rows += [(doc, s, min(limit, n - s), n, raw[4 * s : 4 * (s + limit)]) for s in range(0, n, limit)]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

            for text in text_bytes(b.column(1)):
                texts.append(text)
                size += len(text)
                if size > CHUNK:
                    yield encoded()
                    texts, size = [], 0
            if texts:
                yield encoded()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def first_fit(lengths: list[int], limit: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each of ``lengths``, placed in the given order into the first sequence with room.

    Leaf i of the tree is sequence i's free room, and each inner node the larger of its children, so the first
    sequence with enough room is found by going down to the left wherever the left has it.
    """
    size = 1 << max(0, len(lengths) - 1).bit_length()
    room, out = [limit] * (2 * size), []
    for n in lengths:
        at = 1
        while at < size:
            at *= 2
            if room[at] < n:
                at += 1
        out.append((at - size, limit - room[at]))
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def pack(pieces: DataFrame, limit: int = LIMIT, group_size: int = GROUP_SIZE, seed: int = 0) -> DataFrame:
    """``pieces`` (doc_id, start, length and any other columns) with sequence_id and offset, which replace columns of these names.

    Pieces are read three times, so they should be a written table. A group that is much too large, since many rows share
    doc_id and start, is dealt anew by the rows' places in that table.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = -(-pieces.count() // group_size) or 1
    own, sub, at, parts = ("".join([f"__{c}", *("_" for x in pieces.columns if x.startswith(f"__{c}"))]) for c in ("group", "sub", "at", "parts"))
    dealt = pieces.withColumn(own, F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.lit(groups))).withColumn(at, F.monotonically_increasing_id())
    large = dealt.groupBy(own).count().where(F.col("count") > 2 * group_size).select(own, F.ceil(F.col("count") / group_size).alias(parts))
    dealt = dealt.join(broadcast_if_small(large, 64 * groups), own, "left").withColumn(sub, F.pmod(at, F.coalesce(parts, F.lit(1)))).withColumn(parts, F.coalesce(parts, F.lit(1)))
    columns = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key, t):
        import pyarrow.compute as pc

        t = t.take(pc.sort_indices(t, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        found = np.array(first_fit(t.column("length").to_pylist(), limit), np.int64).reshape(-1, 2)
        group, part, n = (k.as_py() for k in key)
        t = t.select(columns).append_column("sequence_id", pa.array((found[:, 0] * n + part) * groups + group))
        return t.append_column("offset", pa.array(found[:, 1]))

    return dealt.groupBy(own, sub, parts).applyInArrow(place, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids replaced by the ids' checksum."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
