"""Token counts that follow edits: a tree of sums over each document's pre-tokens."""

from __future__ import annotations

import base64
import os
import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Environment variable with the path of the vocabulary file, and the path if it is not set.
SETTING = "LODESTONE_VOCABULARY"
VOCABULARY = os.environ.get(SETTING, "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how texts are split before pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens before an edit that are split anew: how they end may depend on what follows.
CONTEXT = 3
BLOCK = 64
REMEMBERED = 200_000


class Counter:
    """Tokens of a pre-token under a vocabulary, remembered for the last many."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # A pre-token is merged as it is: it is not split again, which a run of a million blanks would not survive.
        self.merge = self.encoding._core_bpe.encode_single_piece
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def of(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.merge(piece.encode("utf-8", "replace")))
        return n


class CountTree:
    """A text with the sums of characters and tokens over blocks of its pre-tokens, in a binary tree.

    An edit splits and counts anew from CONTEXT pre-tokens before it up to the first place after it where old and new
    pre-tokens end alike; from there on they are the same. Only the sums above the changed blocks are renewed.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter, self.recounted = counter, 0
        pieces = counter.split.findall(text)
        self._build(text, [len(p) for p in pieces], [counter.of(p) for p in pieces])

    def _build(self, text: str, chars: list[int], tokens: list[int]) -> None:
        self.text = text
        self.blocks = [(chars[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(chars), BLOCK)] or [([], [])]
        self._sums()

    def _sums(self) -> None:
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (c, t) in enumerate(self.blocks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(c), sum(t)
        for i in reversed(range(1, self.leaves)):
            self._add(i)

    def stored(self) -> bytes:
        """The tree without its text, to be kept beside it."""
        flat = [np.array([n for b in self.blocks for n in b[k]], np.int64) for k in (0, 1)]
        sizes = np.array([len(c) for c, _ in self.blocks], np.int64)
        return pickle.dumps([x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (sizes, *flat)], 5)

    @classmethod
    def of(cls, text: str, stored: bytes, counter: Counter) -> CountTree:
        """The tree that was stored beside text; nothing is counted again."""
        self = cls.__new__(cls)
        self.counter, self.recounted, self.text = counter, 0, text
        sizes, chars, tokens = pickle.loads(stored)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        chars, tokens = chars.tolist(), tokens.tolist()
        self.blocks = [(chars[a:b], tokens[a:b]) for a, b in zip([0, *ends], ends)]
        self._sums()
        return self

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, pre-token in it and its first character, for the pre-token that holds character `at`."""
        i, start = 1, 0
        while i < self.leaves:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        block = i - self.leaves
        chars = self.blocks[block][0]
        for k, n in enumerate(chars):
            if at < start + n:
                return block, k, start
            start += n
        return block, len(chars), start

    def _back(self, block: int, k: int, start: int) -> tuple[int, int, int]:
        for _ in range(CONTEXT):
            while k == 0:
                if block == 0:
                    return 0, 0, 0
                block -= 1
                k = len(self.blocks[block][0])
            k -= 1
            start -= self.blocks[block][0][k]
        return block, k, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new; limits outside the text are moved to its ends."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        b0, k0, begin = self._back(*self.find(start))
        b1, k1, old = self.find(end)
        chars, tokens, at, met = [], [], begin, False
        for m in self.counter.split.finditer(text, begin):
            while old + shift < at or old < end:
                while b1 < len(self.blocks) - 1 and k1 >= len(self.blocks[b1][0]):
                    b1, k1 = b1 + 1, 0
                if k1 >= len(self.blocks[b1][0]):
                    break
                old += self.blocks[b1][0][k1]
                k1 += 1
            if at >= start + len(new) and old >= end and old + shift == at:
                met = True
                break
            chars.append(m.end() - m.start())
            tokens.append(self.counter.of(m[0]))
            at = m.end()
        if not met:
            b1, k1 = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.recounted += len(chars)
        tail = self.blocks[b1][0][k1:], self.blocks[b1][1][k1:]
        head = self.blocks[b0][0][:k0], self.blocks[b0][1][:k0]
        self.text = text
        self.blocks[b0] = (head[0] + chars + tail[0], head[1] + tokens + tail[1])
        for b in range(b0 + 1, b1 + 1):
            self.blocks[b] = ([], [])
        if len(self.blocks[b0][0]) > 8 * BLOCK:
            self._build(text, [n for c, _ in self.blocks for n in c], [n for _, t in self.blocks for n in t])
            return
        changed = set()
        for b in range(b0, b1 + 1):
            i = self.leaves + b
            self.chars[i], self.tokens[i] = sum(self.blocks[b][0]), sum(self.blocks[b][1])
            changed.add(i // 2)
        while changed - {0}:
            for i in changed - {0}:
                self._add(i)
            changed = {i // 2 for i in changed}


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def vocabulary_of(vocabulary: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file on the driver; its size is fixed, whatever the documents."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"no vocabulary file {vocabulary}: give its path as `vocabulary`, or set {SETTING}")
    return ranks_of(vocabulary)


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns id, text, tree, n_tokens, for every row of docs: what is kept of each document, for edits to come.

    A null text is empty. Ids keep their type. Written as a table, it is what `edited` takes, now or later.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            made = [CountTree(t, counter) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.stored() for t in made], pa.binary()), pa.array([t.total for t in made], pa.int64())], ["id", "text", "tree", "n_tokens"])

    return own.mapInArrow(plant, f"id {own.schema['id'].dataType.simpleString()}, text string, tree binary, n_tokens long")


def edited(kept: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """kept (of `trees`, or of this) after edits: id, text, tree, n_tokens, and recounted, the pre-tokens counted anew.

    edits is an array of (start, end, text), applied one after the other to the text as it then stands; null means none.
    Only what an edit touches and its context is encoded; all other counts come from the stored tree.
    """
    shared = kept.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))
    own = kept.select("id", "text", "tree", edits.cast("array<struct<start:int,end:int,text:string>>").alias("edits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            made = []
            for text, stored, changes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                tree = CountTree.of(text, stored, counter)
                for e in changes or ():
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                made.append(tree)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.text for t in made], pa.string()), pa.array([t.stored() for t in made], pa.binary()), pa.array([t.total for t in made], pa.int64()), pa.array([t.recounted for t in made], pa.int64())], ["id", "text", "tree", "n_tokens", "recounted"])

    return own.mapInArrow(apply, f"id {own.schema['id'].dataType.simpleString()}, text string, tree binary, n_tokens long, recounted long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns id, n_tokens, edited_tokens, edited_chars, recounted, for every row of docs.

    edits_col holds edits as `edited` takes them. The trees are made, stored and edited within the tasks, row by row;
    to keep them for later edits, write what `trees` and `edited` return.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))
    kind = "array<struct<start:int,end:int,text:string>>"
    edits = F.col(f"`{edits_col}`").cast(kind) if edits_col else F.lit(None).cast(kind)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), edits.alias("edits"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept = CountTree(text, counter)
                tree = CountTree.of(text, kept.stored(), counter)
                for e in changes or ():
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((kept.total, tree.total, len(tree.text), tree.recounted))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], ["id", "n_tokens", "edited_tokens", "edited_chars", "recounted"])

    return own.mapInArrow(count, f"id {own.schema['id'].dataType.simpleString()}, n_tokens long, edited_tokens long, edited_chars long, recounted long")
