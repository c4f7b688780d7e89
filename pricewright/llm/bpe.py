"""Byte-level BPE: encoding with a queue of merge ranks over a linked list of symbols, decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import emptied, small_batches, sole

#: Words kept in a worker's cache at most; it is emptied when full.
CACHE = 200_000

#: White space and the word pattern of the byte-level vocabulary.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary: bytes that print stand for themselves, the rest follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The tokenizer of one vocabulary file; only byte-level BPE without normaliser is read."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("dropout"):
            raise ValueError("only byte-level BPE without prefix space, normaliser or dropout is read")
        letters = byte_letters()
        vocab = model["vocab"]
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word ends are not read")
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        ids = self.merge([self.first[b] for b in word.encode()])
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the lowest rank, leftmost first, until no pair merges.

        The queue holds (rank, place, left, right); an entry is stale, and skipped, when the symbols at its place
        have changed since. Symbols are linked both ways, so a merge costs the logarithm of the queue's length.
        """
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merges[left, right][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((symbols[i], symbols[k])):
                    heapq.heappush(queue, (found[0], i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], symbols[i]))):
                heapq.heappush(queue, (found[0], h, symbols[h], symbols[i]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; the strings of added tokens become their ids."""
        get, word = self.cache.get, self.word
        out = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            else:
                out += [get(w) or word(w) for w in self.words.findall(part)]
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids, skipping none; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(spec: str) -> ByteBpe:
    """One tokenizer for each vocabulary and Python worker."""
    return ByteBpe(spec)


def encode_decode(docs: DataFrame, vocabulary: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids or decoded on demand.

    ``vocabulary`` is the path of a tokenizer file on the driver. Its content (a few MB, at most 64, which is
    checked) is broadcast, so executors need no file. Narrow: no shuffle, memory bounded by a batch of rows.

    Null and empty texts: no tokens, hashes of empty strings. Very long texts and words: whole, in n log n steps.
    Repeated rows and null ids: one result row for each input row. Empty table: no rows. Other columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches):
        bpe = tokenizer(shared.value)
        sole(bpe.cache)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = []
                for text in part.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    numbers = np.frombuffer(ids, dtype="<u4")
                    decoded = bpe.decode(numbers.tolist())
                    row = [len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    rows.append(row + [numbers.astype("int32")] * keep_ids + [decoded] * keep_text)
                kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids + [pa.string()] * keep_text
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(emptied(run), schema)
