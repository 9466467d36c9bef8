"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over windows of 32 bytes cuts each text into chunks where the hash says so, hence at
the same places in every text that shares a passage. The least hash of a text's cuts deals texts
over range partitions and orders them there, so that texts with common chunks meet in one task,
next to each other, while a large group of copies still spreads over many ranges (the id is part
of the key). A task encodes each chunk it has not seen once and reuses it in all other texts. A new
chunk is in turn made of runs between white space, and a plain run of a word and marks, the finest
chunks; the tokenizer gets only those not seen yet. A task keeps a bounded number of each.

A cut may fall inside a word, so the joins are repaired: from the cut, the re-encoded stretch
widens to the nearest white space on either side. There both sides agree exactly with the encoding
of the whole text, since this tokenizer's normaliser and pre-tokenizer never look across white
space. ``splits_at_white_space`` checks that of a tokenizer and refuses others.

Defined results: null and empty texts have no ids and decode to the empty text. Special tokens
written in a text become their ids, as the tokenizers library does. Repeated rows give equal rows.
An empty table gives an empty table. Own columns are carried under their names; others are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import to_arrow

#: Bytes of text, on average, in a chunk: 2^9.
CHUNK_BITS = 9
WINDOW = 32
#: Words, runs and chunks that a task holds in each of two generations.
WORDS, RUNS, CHUNKS = 60_000, 50_000, 2_000
BATCH_BYTES = 2 << 20
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def splits_at_white_space(path: str) -> bool:
    """If a tokenizer file drops white space before its merges, so that runs encode on their own."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    drops = any(
        s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "[^\\s" in s["pattern"].get("Regex", "")
        for s in steps
    ) or any(s["type"] in ("Whitespace", "WhitespaceSplit") for s in steps)
    return drops and spec.get("decoder") is None and spec.get("post_processor") is None


def window_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes from each byte on."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((n + WINDOW - 8,), "<u8", buffer=data, strides=(1,))
    mixed = words[:n] * np.uint64(_FACTORS[0])
    for i in range(1, 4):
        mixed = (mixed ^ (mixed >> np.uint64(31))) + words[8 * i : 8 * i + n] * np.uint64(_FACTORS[i])
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(_FACTORS[1])


def cuts(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Where chunks begin (never inside a character), and the least hash at a cut."""
    hashes = window_hashes(data)
    at = np.flatnonzero(hashes >> np.uint64(64 - CHUNK_BITS) == 0)
    least = hashes[at].min() if len(at) else hashes.min(initial=np.uint64(2**63))
    at = at[(data[at] & 0xC0) != 0x80]
    return at[at > 0], int(least >> np.uint64(1))


def meeting_key(texts: pd.Series) -> pd.Series:
    return pd.Series(
        [cuts(np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8))[1] for t in texts], dtype="int64"
    )


class Store:
    """What encodings are known: two generations of bounded size, of which the older one goes."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Keys to be added; those of the older generation come over to the younger."""
        new = []
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        for key in keys.difference(self.young):
            entry = self.old.get(key)
            if entry is None:
                new.append(key)
            else:
                self.young[key] = entry
        return new


#: A run that is a word of Latin-1 letters and then marks: two pre-tokens, with no apostrophe that
#: could open a contraction, and nothing that normal form C or a special token would join.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,!?;:#%&$*|\"-]*)").fullmatch


class ChunkCoder:
    """Encodes and decodes texts by reusing chunks, runs and words seen before.

    An encoding is a pair of bytes: ids in decimal joined by a space, and the decoded text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words, self.runs, self.chunks = Store(WORDS), Store(RUNS), Store(CHUNKS)
        self.idle: set[bytes] = set()
        self.letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        # Then a plain word is lower-cased, one pre-token, and a letter for each of its bytes.
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and [
            s["type"] for s in spec["pre_tokenizer"].get("pretokenizers", [])
        ] == ["Split", "ByteLevel"]

    def learn_words(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Encode plain words and marks that are new: the merges alone are left to do."""
        tokenize = self.tokenizer.model.tokenize
        letters = self.letters
        new = self.words.missing(words)
        young = self.words.young
        for word in new:
            tokens = tokenize(word if word.isascii() else "".join([letters[b] for b in word.encode()]))
            young[word] = (
                " ".join([str(t.id) for t in tokens]).encode(),
                " ".join([t.value for t in tokens]).encode("utf-8"),
            )
        return young

    def learn_runs(self, runs: set[bytes]) -> None:
        """Encode runs that are new: plain ones by word and marks, others as they are."""
        parts, others = [], []
        words: set[str] = set()
        for run in self.runs.missing(runs):
            text = run.decode("utf-8")
            plain = self.plain and _PLAIN(text)
            if plain:
                word, marks = plain[1].lower(), plain[2]
                parts.append((run, word, marks))
                words.add(word)
                words.add(marks)
            else:
                others.append((run, text))
        known = self.learn_words(words)
        young = self.runs.young
        for run, word, marks in parts:
            if not marks:
                entry = known[word]
            elif not word:
                entry = known[marks]
            else:
                (a, b), (c, d) = known[word], known[marks]
                entry = b"%b %b" % (a, c), b"%b %b" % (b, d)
            young[run] = entry
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)]
        texts = self.tokenizer.decode_batch(coded, skip_special_tokens=False)
        for (run, _), ids, text in zip(others, coded, texts, strict=True):
            young[run] = " ".join(map(str, ids)).encode(), text.encode("utf-8")
            if not ids:
                self.idle.add(run)
        if b"" in runs:
            young[b""] = b"", b""
            self.idle.add(b"")

    def together(self, runs: list[bytes]) -> tuple[bytes, bytes]:
        """The encoding of runs that follow each other."""
        if not self.idle.isdisjoint(runs):
            runs = [r for r in runs if r not in self.idle]
        known = [self.runs.young[r] for r in runs]
        return b" ".join([k[0] for k in known]), b" ".join([k[1] for k in known])

    def pieces(self, data: bytes) -> list[bytes]:
        array = np.frombuffer(data, np.uint8)
        at = cuts(array)[0].tolist()
        return [data[a:b] for a, b in zip([0, *at], [*at, len(data)], strict=True)]

    def code(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids as text, decoded text) of each text."""
        # The stores hold very many small objects and no cycles; scans for cycles cost a fifth.
        gc.disable()
        try:
            return self._code(texts)
        finally:
            gc.enable()

    def _code(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        cut = [self.pieces((t or "").encode("utf-8", "replace")) for t in texts]
        # A chunk: the part before its first white space, the runs between, the part after its last.
        opened = {c: open_chunk(c) for c in self.chunks.missing({c for chunks in cut for c in chunks})}
        needed: set[bytes] = {b""}
        for _, runs, _ in opened.values():
            needed.update(runs or ())
        joins = []
        for chunks in cut:
            own, loose = [], b""
            for chunk in chunks:
                head, middle, tail = opened.get(chunk) or self.chunks.young[chunk]
                if middle is None:
                    loose += head
                else:
                    own.append(loose + head)
                    loose = tail
            own.append(loose)
            needed.update(own)
            joins.append(own)
        self.learn_runs(needed)
        young = self.chunks.young
        for chunk, (head, runs, tail) in opened.items():
            young[chunk] = head, None if runs is None else self.together(runs), tail
        out = []
        known = self.runs.young
        for chunks, own in zip(cut, joins, strict=True):
            middles = [m for m in (young[c][1] for c in chunks) if m is not None]
            parts = [known[own[0]]]
            for middle, join in zip(middles, own[1:], strict=True):
                parts += middle, known[join]
            ids = b" ".join([p[0] for p in parts if p[0]])
            text = b" ".join([p[1] for p in parts if p[0]])
            out.append((ids.count(b" ") + 1 if ids else 0, ids, text))
        return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a printable
    Latin-1 byte is itself, the others take the letters from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def open_chunk(chunk: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
    """Parts of a chunk before its first and after its last white space, and the runs between;
    None for the runs when there is no white space."""
    white = np.flatnonzero(_WHITE[np.frombuffer(chunk, np.uint8)])
    if not len(white):
        return chunk, None, b""
    first, last = int(white[0]), int(white[-1])
    # bytes.split drops just the six ASCII white space characters.
    return chunk[:first], chunk[first : last + 1].split(), chunk[last + 1 :]


def encode(docs: DataFrame, path: str, *columns: str) -> DataFrame:
    """Each row's ``columns`` (default: doc_id) with ``n_tokens``, ``ids`` (decimal, joined by a
    space) and ``decoded``. ``path`` names the tokenizer's file on every machine."""
    columns = columns or ("doc_id",)
    if not splits_at_white_space(path):
        raise ValueError("chunk joins are repaired at white space; this tokenizer merges across it")
    own = docs.select(
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)],
        F.col("text").alias("__text"),
        F.col("doc_id").alias("__doc_id"),
    )
    key = F.pandas_udf(meeting_key, "long")
    met = (
        own.withColumn("__key", key("__text"))
        .repartitionByRange("__key", "__doc_id")
        .sortWithinPartitions("__key", "__doc_id")
        .drop("__key", "__doc_id")
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name != "__text")
    ddl = f"{kinds}, __n long, __ids string, __decoded string"
    schema = to_arrow(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or ChunkCoder(path)
            texts = batch["__text"].to_pylist()
            rest = batch.drop_columns(["__text"])
            for begin, end in stretches(texts):
                coded = coder.code(texts[begin:end])
                arrays = [
                    *rest.slice(begin, end - begin).columns,
                    pa.array([c[0] for c in coded], pa.int64()),
                    pa.array([c[1].decode() for c in coded], pa.string()),
                    pa.array([c[2].decode("utf-8") for c in coded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    coded = met.mapInArrow(run, ddl)
    return coded.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)],
        F.col("__n").alias("n_tokens"),
        F.col("__ids").alias("ids"),
        F.col("__decoded").alias("decoded"),
    )


def stretches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_BYTES`` characters together."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
