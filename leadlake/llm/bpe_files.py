"""Byte-pair vocabularies read from a tokenizer file on the driver.

A vocabulary is bounded by its file (some 50,000 merges, under 3 MB), so its tables are broadcast. The path is a parameter;
the file need not exist on executors.
"""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_bpe(path: str) -> dict:
    """Tables of a byte-level BPE file.

    start, last: a byte's symbol inside a word and at its end; ranks: left << 20 | right -> rank; made: rank -> symbol;
    tokens: symbol -> its string; added: special string -> symbol.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
    letters = byte_letters()
    ranks, made = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks[ids[left] << 20 | ids[right]] = rank
        made.append(ids[left + right])
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in [*ids.items(), *added.items()]:
        tokens[i] = token
    return {"start": [ids[c] for c in letters], "last": [ids[c + end] for c in letters], "ranks": ranks, "made": made, "tokens": tokens, "added": added}
