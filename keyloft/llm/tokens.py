"""Token counting with the public tokenizers, in Arrow functions that return lengths only.

A text is cut into units at places where the tokenizer's own splitting rule always cuts, so the tokens of the text are the
tokens of its units in order. Units repeat a lot, so each worker keeps the encodings of short ones; those it has not seen
are encoded in batches balanced by bytes.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import tokenizer_path, map_arrow, table, worker_store

#: Characters of a text's segment, 16 times as many bytes are taken up at once; bytes that one call encodes; units that a worker remembers; longest of them.
SEGMENT, CALL_BYTES, REMEMBER, LONGEST = 1 << 16, 1 << 18, 300_000, 64

SHARED = ("tokenizer", "units", "ends")

_INSIDE_WHITE = re.compile(r"\s \s")
_AFTER_WORD = re.compile(r"(?<=\S)(?= )")
_BREAK = re.compile(r"(?<=\S) ")
_ODD_MARK = re.compile("[^a-z\u00df-\u00f6\u00f8-\u00ff][.,] ")
#: A word of Latin letters, which is one token group, and perhaps a full stop or comma, which is another.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?")


def segments(text: str, limit: int = SEGMENT) -> list[str]:
    """A text in parts of about ``limit`` characters, each cut before a space that follows a character that is no white space.

    Both tokenizers always cut there. A stretch without such a place stays whole.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        found = _BREAK.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def byte_units(text: str) -> list[str]:
    """Units of a text for byte-level BPE, where a space belongs to the word after it.

    A cut before a space is exact unless white space stands on both sides of that space.
    """
    if _INSIDE_WHITE.search(text):
        return _AFTER_WORD.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def word_units(text: str) -> list[str]:
    """Units of a text for word BPE, which drops white space and case.

    Lower-casing first and parting the commas and full stops that end words make units repeat more. The first is done for
    Latin-1 texts without special strings, where it can't change a token; the second where each such mark follows a letter
    and precedes a space, so that it is a token group of its own anyway.
    """
    text = text.replace("\n", " ")
    if "<|" not in text and _is_latin(text):
        text = text.lower()
        if not _ODD_MARK.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def octets(text: str) -> int:
    """UTF-8 bytes of a text."""
    return len(text) if text.isascii() else len(text.encode())


UNITS = {"byte_bpe_50k.json": byte_units, "word_bpe_49k.json": word_units}


class Encoder:
    """Encodings of units by the tokenizers library, remembered while the worker lives.

    ``reduce`` turns the ids of a unit into what is kept of them.
    """

    def __init__(self, path: str, reduce, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.units = UNITS.get(os.path.basename(path), lambda text: [text])
        store = worker_store()
        key = ("tokenizer", path)
        if key not in store:
            store[key] = Tokenizer.from_file(path)
            store[key].no_truncation()
            store[key].no_padding()
            ends = None
            if self.units is word_units:
                vocabulary = store[key].get_vocab()
                ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
                ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            store[("ends", path)] = ends
        self.tokenizer, self.reduce, self.ends = store[key], reduce, store[("ends", path)]
        self.known: dict[str, object] = store.setdefault(("units", path, name), {})

    def learn(self, units: set[str]) -> list[str]:
        """Encodes units in calls of about CALL_BYTES bytes; returns those that are not to be remembered.

        While there is room, short units are remembered. A full memory stays as it is, for common units come early, until
        hardly any of a call's units is in it, as when the language changes.
        """
        room, brief = len(self.known) < REMEMBER, []
        joined = [u for u in units if _WORD.fullmatch(u)] if self.ends is not None else []
        for plain, group in ((False, units.difference(joined) if joined else units), (True, joined)):
            call: list[str] = []
            size = 0
            for u in [*group, None]:
                n = 0 if u is None else octets(u)
                if call and (u is None or size + n > CALL_BYTES):
                    if plain:
                        self.encode_joined(call)
                    else:
                        for x, e in zip(call, self.tokenizer.encode_batch_fast(call, add_special_tokens=False)):
                            self.known[x] = self.reduce(e.ids)
                    brief += call if not room else [x for x in call if len(x) > LONGEST]
                    call, size = [], 0
                if u is not None:
                    call.append(u)
                    size += n
        return brief

    def encode_joined(self, call: list[str]) -> None:
        """Encodes words in one text and cuts the ids after each word's last token, which the vocabulary marks."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(call)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        parts = np.cumsum([2 if x[-1] in ".," else 1 for x in call])
        if len(last) != parts[-1]:
            raise RuntimeError("the vocabulary does not mark the last token of a word")
        at = 0
        whole = ids.tobytes()
        for x, to in zip(call, last[parts - 1].tolist()):
            self.known[x] = to - at if self.reduce is len else self.reduce(np.frombuffer(whole, "<u4", to - at, 4 * at))
            at = to

    def values(self, texts: list[str]):
        """For each text, the reduced encodings of its units in order, as an iterator to be used up at once."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + octets(texts[to]) <= 16 * SEGMENT):
                size += octets(texts[to])
                to += 1
            cut = [[self.units(s) for s in segments(t)] if t else [] for t in texts[at:to]]
            seen = {u for parts in cut for units in parts for u in units}
            new = seen.difference(self.known)
            brief = self.learn(new)
            for parts in cut:
                yield chain.from_iterable(map(self.known.__getitem__, units) for units in parts)
            if len(self.known) - len(brief) >= REMEMBER and 20 * len(new) > 19 * len(seen):
                self.known.clear()
            else:
                for x in brief:
                    del self.known[x]
            at = to


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: the tokens of the whole text, without added special tokens.

    tokenizer is the path of a tokenizers JSON file. A null text counts as empty; repeated rows are counted each; other
    columns are ignored; special strings inside a text become their special token, as is the library's default. A text of
    any length is counted whole, segment by segment. An empty table gives an empty result.
    """

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        encoder = Encoder(tokenizer, len, "count")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = [sum(v) for v in encoder.values([x or "" for x in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], schema=kinds)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long", SHARED).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
