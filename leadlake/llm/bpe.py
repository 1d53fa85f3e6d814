"""BPE encoding and decoding of whole texts: a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import whole_text
from .bpe_files import read_bpe

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how the word-level vocabulary cuts a text; what lies between is dropped.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What str.split() takes for white space and the vocabulary does not.
NOT_BLANK = regex.compile("[\x1c-\x1f]").search
NONE = 1 << 60


def merge(symbol: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols of a word after all merges, lowest rank first and leftmost among equals.

    Leaf i of the tree holds rank << 32 | i of the pair that starts at i, or NONE, so the root is the next merge. A merge
    changes three leaves, each in as many steps as the tree is high.
    """
    n = len(symbol)
    if n < 2:
        return symbol
    get = ranks.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        r = get(symbol[i] << 20 | symbol[i + 1])
        if r is not None:
            tree[width + i] = r << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            low = value if value < other else other
            if tree[k] == low:
                return
            tree[k] = value = low

    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        symbol[i] = merged = made[top >> 32]
        j = after[i]
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        r = None
        if k < n:
            before[k] = i
            r = get(merged << 20 | symbol[k])
        put(i, NONE if r is None else r << 32 | i)
        p = before[i]
        if p >= 0:
            r = get(symbol[p] << 20 | merged)
            put(p, NONE if r is None else r << 32 | p)
    out, i = [], 0
    while i < n:
        out.append(symbol[i])
        i = after[i]
    return out


class Encoder(dict):
    """Ids of blank-separated words and of pieces, kept for the life of a Python worker up to ``room`` entries of each."""

    def __init__(self, bpe: dict, room: int):
        super().__init__()
        self.bpe, self.room, self.added = bpe, room, bpe["added"]
        self.known: dict[str, str] = {}
        self.special = regex.compile("(" + ("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) or "(?!)") + ")")
        self.pieces = regex.compile(PIECES).findall
        self.blank = regex.compile(r"\s+").split
        self.token = {str(i): t for i, t in enumerate(bpe["tokens"])}

    def piece(self, piece: str) -> str:
        ids = self.known.get(piece)
        if ids is None:
            data = piece.encode()
            symbols = [self.bpe["start"][b] for b in data]
            symbols[-1] = self.bpe["last"][data[-1]]
            ids = "".join([f"{i} " for i in merge(symbols, self.bpe["ranks"], self.bpe["made"])])
            if len(self.known) < self.room and len(piece) < 100:
                self.known[piece] = ids
        return ids

    def __missing__(self, word: str) -> str:
        """Ids of a word, each followed by a space."""
        out = []
        for k, part in enumerate(self.special.split(word)):
            if k % 2:
                out.append(f"{self.added[part]} ")
            elif part:
                # Letter by letter, so without the special form of a final sigma.
                out += map(self.piece, self.pieces(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()))
        ids = "".join(out)
        if len(self) < self.room and len(word) < 100:
            self[word] = ids
        return ids

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        words = self.blank(text) if NOT_BLANK(text) else text.split()
        return "".join(map(self.__getitem__, words))[:-1]

    def decode(self, ids: str) -> str:
        """The vocabulary file names no decoder: the tokens themselves, joined by one space."""
        return " ".join(map(self.token.__getitem__, ids.split()))


def _encoder(shared, room: int) -> Encoder:
    held = shared.value  # one for each Python worker, so words known from earlier tasks stay
    if "encoder" not in held:
        held["encoder"] = Encoder(held["bpe"], room)
    return held["encoder"]


def codec(spark: SparkSession, path: str, room: int = 500_000) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Column functions (encode: text -> array of ids, decode: array of ids -> text) for the BPE file at ``path``."""
    shared = spark.sparkContext.broadcast({"bpe": read_bpe(path)})

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(shared, room)
        for texts in batches:
            yield pd.Series([list(map(int, e.encode(t).split())) for t in texts])

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(shared, room)
        for many in batches:
            yield pd.Series([" ".join(e.bpe["tokens"][i] for i in ids) for ids in many])

    return F.pandas_udf(encode, "array<int>").asNondeterministic(), F.pandas_udf(decode, "string").asNondeterministic()


def digests(spark: SparkSession, path: str, room: int = 500_000) -> Callable[[Column], Column]:
    """A column function: text -> struct(n_tokens, ids_sha256, decoded_sha256); the text is decoded from its ids."""
    shared = spark.sparkContext.broadcast({"bpe": read_bpe(path)})

    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = _encoder(shared, room)
        for texts in batches:
            rows = []
            for t in texts:
                ids = e.encode(t)
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(both, "n_tokens long, ids_sha256 string, decoded_sha256 string").asNondeterministic()


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str | Column = "text") -> DataFrame:
    """``keep`` with ids (array of int) and decoded (text) for each row; cases as for :func:`encoding_digests`."""
    encode, decode = codec(docs.sparkSession, path)
    return docs.select(*keep, encode(whole_text(text)).alias("ids")).withColumn("decoded", decode("ids"))


def encoding_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str | Column = "text") -> DataFrame:
    """One row for each row of ``docs``: ``keep``, n_tokens, ids_sha256, decoded_sha256.

    Whole texts, no added special tokens; a special string inside a text is its own id. Null and empty texts have no ids
    and the digests of empty text; repeated rows are encoded each; an empty table gives no rows; other columns of ``docs``
    are not read. One narrow stage without shuffle; a very long word costs n log n.
    """
    got = docs.select(*keep, digests(docs.sparkSession, path)(whole_text(text)).alias("_got"))
    return got.select(*keep, "_got.n_tokens", "_got.ids_sha256", "_got.decoded_sha256")
