"""Problem 7: passages of held-out evaluation texts inside the training corpus.

Method: training suffix arrays. Each task turns its block of documents (a shard) into one array of word numbers, sorts
the shard's suffixes, and binary-searches every suffix of the test texts in it. Neighbouring hits on one diagonal join
to the longest verbatim match. Only the test texts travel: the corpus is neither shuffled nor collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a row that make a leak.
PASSAGE_WORDS = 12
#: Characters that show nothing: format characters, fillers, variation selectors. They are removed before words are cut.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff"
)
#: Characters of test text in one block, about: a block is gathered and broadcast at a time, larger test sets are searched
#: in several passes. (A single longer text is a block of its own.)
TEST_BLOCK_CHARS = 8_000_000


def word_cutter():
    """The function from a text to its words: runs of letters or digits, case folded, invisible characters removed."""
    invisible, anything = re.compile(f"[{INVISIBLE}]"), re.compile(r"[^\W_]+").findall
    plain = re.compile(r"[a-z0-9]+", re.ASCII).findall

    def cut(text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return plain(text.lower())
        return anything(invisible.sub("", text).casefold())

    return cut


def test_block(items: list[tuple], passage: int) -> dict | None:
    """A block's test texts as word numbers: vocabulary, and for each searched suffix its first ``passage`` words (0
    beyond a shorter text), their count, item and offset. Numbers take 16 bits where all words of the block fit, else 32."""
    cut, vocab = word_cutter(), {}
    rows = [(item_id, [vocab.setdefault(w, len(vocab) + 1) for w in cut(text)]) for item_id, text in items]
    kind = np.uint16 if len(vocab) < 65_535 else np.uint32
    keys, length, item, offset = [], [], [], []
    for item_id, ids in rows:
        if not ids:
            continue
        n = max(1, len(ids) - passage + 1)
        wide = np.zeros(n + passage - 1, kind)
        wide[: len(ids)] = ids
        keys.append(np.lib.stride_tricks.sliding_window_view(wide, passage))
        length.append(np.full(n, min(len(ids), passage)))
        item.extend([item_id] * n)
        offset.append(np.arange(n))
    if not keys:
        return None
    return {"vocab": vocab, "keys": np.concatenate(keys), "length": np.concatenate(length), "item": item, "offset": np.concatenate(offset)}


def packed(keys: np.ndarray) -> list[np.ndarray]:
    """Rows of word numbers as columns of as many numbers each as 64 bits hold, so that comparing columns in turn compares
    word by word."""
    out, bits = [], 8 * keys.dtype.itemsize
    for c in range(0, keys.shape[1], 64 // bits):
        part = np.zeros(len(keys), np.uint64)
        for k in range(64 // bits):
            part <<= np.uint64(bits)
            if c + k < keys.shape[1]:
                part |= keys[:, c + k].astype(np.uint64)
        out.append(part)
    return out


def suffix_array(text: np.ndarray, depth: int, shortest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the shard's suffixes in the order of their first ``depth`` words, and those words, packed. Suffixes
    with a word unknown to the test texts (number 0) among the first ``shortest`` can match nothing and are left out."""
    gap = np.flatnonzero(text == 0)
    starts = np.flatnonzero(text)
    following = gap[np.searchsorted(gap, starts)]
    starts = starts[following - starts >= shortest]
    wide = np.concatenate([text, np.zeros(depth, text.dtype)])
    columns = packed(np.stack([wide[starts + k] for k in range(depth)], axis=1)) if len(starts) else packed(np.zeros((0, depth), text.dtype))
    order = np.lexsort(columns[::-1])
    return starts[order], [c[order] for c in columns]


def search(columns: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once in the sorted columns: the first place not less than (or, with
    ``after``, greater than) each."""
    n = len(columns[0])
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = np.minimum((low + high) // 2, max(n - 1, 0))
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for own, want in zip(columns, wanted, strict=True):
            at = own[mid]
            less |= equal & (at < want)
            equal &= at == want
        right = open_ & (less | (equal if after else False))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)


def leaked_passages(
    corpus: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    test_text_col: str = "text",
    passage: int = PASSAGE_WORDS,
) -> DataFrame:
    """One row for each document and test item that share ``passage`` words in a row (or the item's whole text if it
    has fewer words): ``id_col``, ``item_col``, ``words`` (of the longest verbatim match), ``at_word`` (where it starts
    in the document, from 0) and ``item_word`` (where in the item).

    Null, empty and wordless texts on either side match nothing; an empty side gives no rows. A corpus row repeated in
    the input comes out repeated; ties between equally long matches go to the first place in the document, then in the
    item. Texts of any length are searched whole; other columns are ignored. The test items are dealt into blocks by a
    hash of theirs; one block at a time is gathered and broadcast, and the corpus is searched once a block.
    """
    spark = corpus.sparkSession
    tests = tests.where(F.length(test_text_col) > 0).select(item_col, test_text_col).distinct()
    blocks = -(-(tests.agg(F.sum(F.length(test_text_col))).first()[0] or 0) // TEST_BLOCK_CHARS)
    dealt = tests.withColumn("block", F.pmod(F.xxhash64(item_col, test_text_col), F.lit(max(blocks, 1))))
    id_field, item_field = corpus.schema[id_col], tests.schema[item_col]
    schema = T.StructType([id_field, item_field, *(T.StructField(c, T.IntegerType()) for c in ("words", "at_word", "item_word"))])
    found = None
    for number in range(blocks):
        # Ordered, so that ties are the same in every run.
        items = dealt.where(F.col("block") == number).orderBy(item_col, test_text_col).select(item_col, test_text_col).collect()
        block = test_block([tuple(r) for r in items], passage)
        if block is not None:
            part = one_pass(corpus.select(id_col, text_col), spark.sparkContext.broadcast(block), schema, passage)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def one_pass(corpus: DataFrame, shared, schema: T.StructType, passage: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, cut = shared.value, word_cutter()
        get, shortest = test["vocab"].get, int(test["length"].min())
        low_keys, high_keys = packed(test["keys"]), test["keys"].copy()
        for n in np.flatnonzero(test["length"] < passage):
            high_keys[n, test["length"][n] :] = np.iinfo(high_keys.dtype).max
        high_keys = packed(high_keys)
        for batch in batches:
            numbers, starts = [], []
            for text in batch.column(1).to_pylist():
                starts.append(len(numbers))
                numbers.extend([get(w, 0) for w in cut(text)])
                numbers.append(0)
            shard = np.array(numbers, test["keys"].dtype)
            del numbers
            order, columns = suffix_array(shard, passage, shortest)
            first, last = search(columns, low_keys, False), search(columns, high_keys, True)
            runs: dict[tuple, list[int]] = {}
            starts = np.array(starts)
            for n in np.flatnonzero(last > first):
                for at in order[first[n] : last[n]]:
                    doc = int(np.searchsorted(starts, at, side="right")) - 1
                    place = int(at - starts[doc])
                    runs.setdefault((doc, test["item"][n], place - int(test["offset"][n])), []).append((place, int(test["length"][n])))
            best: dict[tuple, tuple] = {}
            for (doc, item, diagonal), places in runs.items():
                places.sort()
                begin = reach = None
                for place, length in [*places, (None, 0)]:
                    if begin is not None and (place is None or place != previous + 1):
                        match = (begin - reach, begin, begin - diagonal)
                        best[doc, item] = min(best.get((doc, item), match), match)
                        begin = None
                    if place is not None:
                        begin = place if begin is None else begin
                        reach, previous = place + length, place
            hits = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([d for d, _ in hits], pa.int64())),
                    pa.array([i for _, i in hits], arrow.field(1).type),
                    *(pa.array([sign * best[h][k] for h in hits], pa.int32()) for k, sign in ((0, -1), (1, 1), (2, 1))),
                ],
                schema=arrow,
            )

    return corpus.mapInArrow(run, schema)


def without_leaks(corpus: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus without the documents that leak anything. Rows whose id is null are kept."""
    return corpus.join(leaks.select(id_col).distinct(), id_col, "left_anti")
