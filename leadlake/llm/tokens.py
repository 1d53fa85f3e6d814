"""Token counts of whole texts without encoding them: heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import whole_text
from .bpe_files import read_bpe

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: how byte-level BPE cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A count that no text reaches; it marks chunks that cannot be counted on their own.
ODD = 1 << 50


def count_symbols(data: bytes, start: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols left of one piece: its bytes minus its merges.

    The heap holds rank << 32 | position of the left symbol, so the lowest rank and then the leftmost pair comes first;
    ``after`` and ``before`` link the symbols that are left. An entry is stale when its position holds another rank by now.
    """
    n = len(data)
    if n < 2:
        return n
    symbol = [start[b] for b in data]
    get = ranks.get
    now = [get(symbol[i] << 20 | symbol[i + 1], -1) for i in range(n - 1)]
    now.append(-1)
    heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
    if not heap:
        return n
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        top = pop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        if now[i] != rank:
            continue
        left -= 1
        symbol[i] = merged = made[rank]
        j = after[i]
        k = after[i] = after[j]
        now[j] = now[i] = -1
        if k < n:
            before[k] = i
            r = get(merged << 20 | symbol[k], -1)
            if r >= 0:
                now[i] = r
                push(heap, r << 32 | i)
        p = before[i]
        if p >= 0:
            now[p] = r = get(symbol[p] << 20 | merged, -1)
            if r >= 0:
                push(heap, r << 32 | p)
    return left


class Counter(dict):
    """Counts of space-led chunks and of pieces, kept for the life of a Python worker up to ``room`` entries of each."""

    def __init__(self, bpe: dict, room: int):
        super().__init__()
        self.start, self.ranks, self.made, self.room = bpe["start"], bpe["ranks"], bpe["made"], room
        self.known: dict[str, int] = {}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(bpe["added"], key=len, reverse=True)) or r"(?!)")
        self.pieces = regex.compile(PIECES).findall
        self.chunks = regex.compile(r"(?V1)(?= \S)").split
        self.blank = regex.compile(r"\s").match

    def piecewise(self, chunk: str) -> int:
        total, known = 0, self.known
        for piece in self.pieces(chunk):
            n = known.get(piece)
            if n is None:
                n = count_symbols(piece.encode(), self.start, self.ranks, self.made)
                if len(known) < self.room and len(piece) < 100:
                    known[piece] = n
            total += n
        return total

    def __missing__(self, word: str) -> int:
        """``word`` follows a space. That space opens a piece only if a visible character follows."""
        n = ODD if not word or self.blank(word) or self.special.search(word) else self.piecewise(" " + word)
        if len(self) < self.room and len(word) < 100:
            self[word] = n
        return n

    def whole(self, text: str) -> int:
        words = text.split(" ")
        if self.special.search(words[0]) is None:
            n = self.piecewise(words[0]) + sum(map(self.__getitem__, islice(words, 1, None)))
            if n < ODD:
                return n
        n = len(self.special.findall(text))
        for part in self.special.split(text):
            for chunk in self.chunks(part):
                n += self[chunk[1:]] if chunk[:1] == " " and chunk[1:] and not self.blank(chunk[1:]) else self.piecewise(chunk)
        return n


def token_counter(spark: SparkSession, path: str, room: int = 700_000) -> Callable[[Column], Column]:
    """A column function: text -> number of tokens by the byte-level BPE file at ``path``."""
    shared = spark.sparkContext.broadcast({"bpe": read_bpe(path)})

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value  # one for each Python worker, so counts known from earlier tasks stay
        if "counter" not in held:
            held["counter"] = Counter(held["bpe"], room)
        counter = held["counter"]
        for texts in batches:
            yield pd.Series([counter.whole(t) for t in texts], dtype="int64")

    # Not pure to the planner, so that a filter on the count does not run the merges a second time.
    udf = F.pandas_udf(count, "long").asNondeterministic()
    return udf


def token_counts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str | Column = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: ``keep``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Whole texts, without begin, end or added special tokens; a special string inside a text is one token. Null and empty
    texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives no rows; other columns of
    ``docs``, whatever their names, are not read. One narrow stage, no shuffle; a very long piece costs n log n.
    """
    count = token_counter(docs.sparkSession, path)
    rows = docs.select(*keep, F.octet_length(whole_text(text)).cast("long").alias("n_bytes"), count(whole_text(text)).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
