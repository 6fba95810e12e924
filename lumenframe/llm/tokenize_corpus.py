"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: corpus-level merge replay. A task takes its documents in blocks, cuts them into words, and replays the merges
over the distinct words that it has not met before: an inverted index leads from a token pair to the word positions
where it stands, pairs are taken in rank order, every occurrence is merged at once and only the two neighbours of a
merged place get new index entries. Each distinct word is thus encoded once a task, and each text is a look-up.
There is no shuffle: the words of a task's blocks stand for the corpus, as one index over the words of the whole
corpus would need every occurrence shuffled twice to save a few replays of rare words.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary files lie; never copied into this repository.
TOKENIZER_DIR = os.environ.get("LUMENFRAME_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.json"

#: Fixed values of the vocabulary: how it cuts text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for pure ASCII text, where the standard library's faster engine gives equal words.
ASCII_WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Documents whose words are replayed together, and distinct words that a task remembers before it starts afresh.
BLOCK_DOCUMENTS = 2000
REMEMBERED_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on, in order."""
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load_merges(path: str) -> dict:
    """Byte ids and, for each rank, the merged pair and its new id, from a ``tokenizers`` BPE file. Its size is that of
    the vocabulary file (50,000 merges: about 1 MB), whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {
        "bytes": [vocab[c] for c in byte_alphabet()],
        "left": [vocab[a] for a, _ in pairs],
        "right": [vocab[b] for _, b in pairs],
        "new": [vocab[a + b] for a, b in pairs],
    }


class MergeReplay:
    """Encodes sets of distinct words by replaying all merges over them in rank order."""

    def __init__(self, merges: dict):
        self.byte_ids, self.left, self.right, self.new = (merges[k] for k in ("bytes", "left", "right", "new"))
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each word. Lowest rank first, left to right among equal pairs, as the vocabulary defines it."""
        words = list(words)
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        places: dict[int, list[int]] = {}
        rank, byte_ids = self.rank, self.byte_ids
        for word in words:
            first = len(token)
            starts.append(first)
            token.extend([byte_ids[b] for b in word.encode("utf-8")])
            last = len(token) - 1
            before.append(-1)
            before.extend(range(first, last))
            after.extend(range(first + 1, last + 1))
            after.append(-1)
            for i in range(first, last):
                r = rank.get((token[i] << 20) | token[i + 1])
                if r is not None:
                    places.setdefault(r, []).append(i)
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b, c = self.left[r], self.right[r], self.new[r]
            found = places.pop(r)
            if a == b:
                found.sort()
            for i in found:
                j = after[i]
                if token[i] != a or j < 0 or token[j] != b:
                    continue  # an earlier merge took one of the two
                token[i], token[j] = c, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    s = rank.get((c << 20) | token[k])
                    if s is not None:
                        if s in places:
                            places[s].append(i)
                        else:
                            places[s] = [i]
                            heapq.heappush(queue, s)
                h = before[i]
                if h >= 0:
                    s = rank.get((token[h] << 20) | c)
                    if s is not None:
                        if s in places:
                            places[s].append(h)
                        else:
                            places[s] = [h]
                            heapq.heappush(queue, s)
        starts.append(len(token))
        return {w: [t for t in token[starts[n] : starts[n + 1]] if t >= 0] for n, w in enumerate(words)}


def cut_words(text: str, ascii_words, any_words) -> list[str]:
    return ascii_words(text) if text.isascii() else any_words(text)


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded like any other; the strings of special tokens are
    ordinary text; texts of any length are encoded whole. Repeated rows come out as often as they go in; other columns
    are ignored, whatever their names. A row whose id is null keeps its null id.
    """
    path = vocabulary or os.path.join(TOKENIZER_DIR, DEFAULT_VOCABULARY)
    merges = df.sparkSession.sparkContext.broadcast(load_merges(path))
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    block_rows, most_words = BLOCK_DOCUMENTS, REMEMBERED_WORDS
    patterns = ASCII_WORD_PATTERN, WORD_PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ascii_words, any_words = re.compile(patterns[0], re.ASCII).findall, regex.compile(patterns[1]).findall
        replay, known = MergeReplay(merges.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                block = batch.slice(at, block_rows)
                cut = [cut_words(t, ascii_words, any_words) if t else [] for t in block.column(1).to_pylist()]
                fresh = set(chain.from_iterable(cut)).difference(known)
                if len(known) + len(fresh) > most_words:
                    known = {}
                    fresh = set(chain.from_iterable(cut))
                known.update(replay.encode(fresh))
                look = known.__getitem__
                rows = [list(chain.from_iterable(map(look, words))) for words in cut]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
                flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([block.column(0), ids], names=[schema[0].name, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
