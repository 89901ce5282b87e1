"""Which documents hold passages of held-out items, by q-gram filtering in diagonal bands and banded alignment.

Texts are normalised (character references read, case folded, invisible characters dropped, everything that is neither
letter, mark nor digit a separator) and seen as words with one space before each. A match holds at least `min_words`
words in a row of an item, of which one in `per_edit` may be changed, added or missing. The q-gram lemma bounds from
below how many character q-grams such a passage and its copy share: each edited word destroys at most its length plus
q of them. So for every item the least number over all its passages is known beforehand. It is positive for the usual
q with all but very short words; an item whose bound isn't gets a shorter q, with which every bound is positive
(`gram_size`): even of words of one character a passage of 7 k words keeps 12 k characters in k + 1 runs.

Filter: the q-grams of a document are looked up in the items' index; documents without a stretch dense in known
q-grams go no further. The others count, for each item, the shared q-grams in overlapping diagonal bands. Diagonals are
measured in words: an edit moves them by one word at most, however long the word is that was added, so a band as wide as
a passage has edits holds all its hits. A band that meets the item's bound is verified by banded alignment of the words,
over all diagonals that a passage around its hits can reach. So nothing that aligns is lost.

The items are a fixed set; they are checked against a bound and go in blocks of at most `block_chars` characters, each
of which is broadcast and compared with all documents. No document is shuffled.

Results for special input: NULL or empty texts match nothing; an item with fewer than `min_words` words matches
nothing; repeated documents and items count once by their ids; extra columns are ignored; empty tables match nothing.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, PER_EDIT, Q = 20, 7, 12
BLOCK_CHARS = 20_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 0 dropped, 32 separator, or the character itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] not in "LMN":
            table[c] = 0 if kind in ("Cf", "Cs") else _SPACE
    table[0xFE00:0xFE10] = 0
    table[0x0] = _SPACE
    return table


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, start of each text and the end); every word has one space before it, none after."""
    folded = []
    for t in texts:
        t = t or ""
        if "&" in t:
            t = html.unescape(t)
        folded.append(t if t.isascii() else unicodedata.normalize("NFC", t))
    lengths = np.fromiter(map(len, folded), np.int64, len(folded))
    joined = "".join(folded).lower() if all(map(str.isascii, folded)) else None
    if joined is None:
        folded = [t.casefold() for t in folded]
        lengths = np.fromiter(map(len, folded), np.int64, len(folded))
        joined = "".join(folded)
    chars = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    # one separator in front of each text, then separators are squeezed to the last one before a word
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(len(chars) + len(texts), np.uint32)
    heads = starts[:-1] + np.arange(len(texts))
    body = np.ones(len(out), bool)
    body[heads] = False
    out[heads] = _SPACE
    out[body] = chars
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)
    kept = out != 0
    out, text_of = out[kept], text_of[kept]
    space = out == _SPACE
    last = np.ones(len(out), bool)
    last[:-1] = text_of[1:] != text_of[:-1]
    after = np.ones(len(out), bool)
    after[:-1] = space[1:]
    stay = ~(space & (after | last))
    out, text_of = out[stay], text_of[stay]
    return out, np.searchsorted(text_of, np.arange(len(texts) + 1)).astype(np.int64)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on (the last q - 1 places have none)."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, factor = chars.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    total, done = np.zeros(n, np.uint64), 0
    while True:
        if q & width:
            # total covers `done` characters; the next `width` are appended
            total = total * np.uint64(factor) + power[done : done + n]
            done += width
        if done == q:
            break
        power = power[:-width] * np.uint64(factor) + power[width:]
        factor = factor * factor % 2**64
        width *= 2
    total ^= total >> np.uint64(31)
    total *= _MIX
    return total ^ (total >> np.uint64(29))


def words_of(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word; a word starts at its space."""
    starts = np.flatnonzero(chars == _SPACE)
    if len(starts) == 0:
        return np.empty(0, np.uint64), starts
    place = np.arange(len(chars), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(chars)))).astype(np.uint64)
    mixed = (chars.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.add.reduceat(mixed, starts), starts


def _windows(min_words: int, per_edit: int) -> list[int]:
    """Sizes of passages, one of which lies within every match: a longer match has a part as good as itself."""
    return [min_words, *(k * per_edit for k in range(min_words // per_edit + 1, min_words // per_edit + 4))]


def bound(lengths: np.ndarray, q: int, min_words: int, per_edit: int) -> int:
    """The fewest q-grams that a passage of an item (word lengths with their space) shares with a copy of it.

    Taken over passages of the sizes of _windows, with the edits on their longest words; may be 0 or less.
    """
    least, n = None, len(lengths)
    for size in (s for s in _windows(min_words, per_edit) if s <= n):
        windows = np.lib.stride_tricks.sliding_window_view(lengths, size)
        longest = np.sort(windows, axis=1)[:, -(size // per_edit) :]
        shared = windows.sum(1) - q + 1 - (longest + q - 1).sum(1)
        least = int(shared.min()) if least is None else min(least, int(shared.min()))
    return 1 if least is None else least


def gram_size(lengths: np.ndarray, q: int, min_words: int, per_edit: int) -> tuple[int, int]:
    """(the largest size up to q whose bound is positive, that bound); one character each is always enough unless
    per_edit is 1."""
    for size in range(q, 0, -1):
        if (n := bound(lengths, size, min_words, per_edit)) > 0:
            return size, n
    raise ValueError("a passage need not share anything with its copy")


def aligned(a: np.ndarray, b: np.ndarray, low: int, high: int, min_words: int, per_edit: int) -> bool:
    """Do min_words or more words in a row of `a` occur in `b`, with an edit for at most one in per_edit of them?

    Alignments within the diagonals low..high (place in b minus place in a) are looked at. For each number of edits the
    most words of `a` are kept that an alignment ending at (place, diagonal) can hold; equal words extend it at once.
    """
    n, m = len(a), len(b)
    if n < min_words:
        return False
    diagonals = np.arange(low, high + 1)
    at = np.arange(n)[None, :] + diagonals[:, None]
    inside = (at >= 0) & (at < m)
    same = inside & (a[None, :] == b[np.clip(at, 0, max(0, m - 1))] if m else False)
    if same.sum() < min_words - n // per_edit - 1:
        return False
    # column i + 1 stands for alignments that end after i + 1 words of a; column 0 before any
    never = -(10**6)
    steps = np.arange(n + 1)
    breaks = np.concatenate([np.ones((len(diagonals), 1), bool), ~same], axis=1)
    segment = np.cumsum(breaks, axis=1) * (4 * (n + 1))
    start = np.zeros((len(diagonals), n + 1), np.int64)
    for edits in range(n // per_edit + 1):
        shifted = start - steps + segment
        held = np.maximum.accumulate(np.where(start < 0, never, shifted), axis=1) + steps - segment
        held[held < 0] = never
        if held.max() >= max(min_words, per_edit * edits):
            return True
        after = np.full_like(held, 0)
        after[:, 1:] = np.maximum(after[:, 1:], held[:, :-1] + 1)  # changed
        after[:-1, 1:] = np.maximum(after[:-1, 1:], held[1:, :-1] + 1)  # missing in b
        after[1:, :] = np.maximum(after[1:, :], held[:-1, :])  # added in b
        start = np.maximum(after, held)
    return False


@dataclass
class Grams:
    """The q-grams of the items that use this q: sorted hashes with the items and the words that have them."""

    q: int
    known: np.ndarray
    first: np.ndarray
    item: np.ndarray
    word: np.ndarray
    filter: np.ndarray
    least: int


@dataclass
class Index:
    """A block of items, and their q-grams by q."""

    ids: list
    words: list[np.ndarray]
    bounds: np.ndarray
    grams: list[Grams]

    @classmethod
    def of(cls, ids: list, texts: list[str], q: int, min_words: int, per_edit: int) -> Index:
        chars, cuts = normalise(texts)
        words, bounds, parts = [], np.ones(len(ids), np.int64), {}
        for i in range(len(ids)):
            own = chars[cuts[i] : cuts[i + 1]]
            w, s = words_of(own)
            words.append(w)
            if len(w) >= min_words:
                size, bounds[i] = gram_size(np.diff(np.append(s, len(own))), q, min_words, per_edit)
                h = grams(own, size)
                word = np.cumsum(own == _SPACE)[: len(h)] - 1
                parts.setdefault(size, []).append((h, np.full(len(h), i, np.int32), word.astype(np.int32)))
        made = []
        for size, part in sorted(parts.items()):
            hashes, items, word = (np.concatenate(x) for x in zip(*part, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, items, word = (x[order] for x in (hashes, items, word))
            known, first = np.unique(hashes, return_index=True)
            bits = np.zeros(1 << 24, bool)
            bits[(known >> np.uint64(40)).astype(np.int64)] = True
            made.append(Grams(size, known, np.append(first, len(hashes)), items, word, bits, int(bounds[np.unique(items)].min())))
        return cls(ids, words, bounds, made)


def _matches(index: Index, min_words: int, per_edit: int):
    most = _windows(min_words, per_edit)[-1]
    #: edits of the largest passage: as many words its diagonals and the document's stretch may differ by
    edits = most // per_edit

    def of_document(g: Grams, doc_words: np.ndarray, hit: np.ndarray, slot: np.ndarray, at_word: np.ndarray, done: set) -> None:
        """Adds the items with a passage in one document; hit: its places with a known q-gram, at_word: their words."""
        counts = g.first[slot + 1] - g.first[slot]
        total = int(counts.sum())
        which = np.repeat(g.first[slot] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        items, own_word = g.item[which].astype(np.int64), g.word[which].astype(np.int64)
        diagonal = np.repeat(at_word, counts) - own_word
        lowest, width = int(diagonal.min()), edits + 1
        band = (diagonal - lowest) // width
        span = int(band.max()) + 3
        # a band and the next one, so that all diagonals of a passage lie in one such pair
        keys, at, each = np.unique(np.concatenate([items * span + band + 1, items * span + band]), return_inverse=True, return_counts=True)
        chosen = np.flatnonzero((each >= index.bounds[keys // span])[at])
        if len(chosen) == 0:
            return
        # within a band, as many hits as the bound asks for must lie in the words of one passage
        word = own_word[chosen % total]
        order = np.lexsort((word, at[chosen]))
        at_, w_, d_, item_ = at[chosen][order], word[order], diagonal[chosen % total][order], items[chosen % total][order]
        end = np.arange(len(at_)) + index.bounds[item_] - 1
        ends = np.minimum(end, len(at_) - 1)
        dense = (end < len(at_)) & (at_[ends] == at_) & (w_[ends] - w_ < most)
        if not dense.any():
            return
        low_at = np.flatnonzero(dense)
        # neighbouring dense places of a band make one region
        new = np.concatenate([[True], (at_[low_at[1:]] != at_[low_at[:-1]]) | (w_[low_at[1:]] - w_[low_at[:-1]] > most)])
        cuts = np.append(np.flatnonzero(new), len(low_at))
        regions = [(int(low_at[x]), int(ends[low_at[y - 1]]) + 1) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for x, y in sorted(regions, key=lambda r: r[0] - r[1]):
            item = int(item_[x])
            if item in done:
                continue
            d, w, own = d_[x:y], w_[x:y], index.words[item]
            # the words that the region's hits and a passage around them cover
            v, u = max(0, int(w.min()) - most), int(w.max()) + most + 1
            a, b = max(0, int((d + w).min()) - most - edits), int((d + w).max()) + most + edits + 1
            low, high = int(d.min()) - a + v, int(d.max()) - a + v
            if aligned(own[v:u], doc_words[a:b], low - edits, high + edits, min_words, per_edit):
                done.add(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, cuts = normalise(batch.column(1).to_pylist())
            space = chars == _SPACE
            word_of = np.cumsum(space) - 1
            found: dict[int, set] = {}
            words = None
            for g in index.grams:
                hashes = grams(chars, g.q)
                hits = np.flatnonzero(g.filter[(hashes >> np.uint64(40)).astype(np.int64)])
                if len(hits) == 0:
                    continue
                slot = np.minimum(np.searchsorted(g.known, hashes[hits]), len(g.known) - 1)
                same = g.known[slot] == hashes[hits]
                hits, slot = hits[same], slot[same]
                doc = np.searchsorted(cuts, hits, side="right") - 1
                inside = hits + g.q <= cuts[doc + 1]
                hits, slot, doc = hits[inside], slot[inside], doc[inside]
                # the `least`th hit from each on must come within the words of a passage, or no band meets any bound
                if len(hits) < g.least:
                    continue
                word = word_of[hits]
                near = np.zeros(len(hits), bool)
                ahead = word[g.least - 1 :] - word[: len(hits) - g.least + 1]
                near[: len(ahead)] = (ahead < most + edits) & (doc[g.least - 1 :] == doc[: len(doc) - g.least + 1])
                for k in np.unique(doc[near]):
                    if words is None:
                        words = words_of(chars)[0]
                    lo, hi = np.searchsorted(doc, [k, k + 1])
                    first, last = word_of[cuts[k]], word_of[cuts[k + 1] - 1] + 1
                    of_document(g, words[first:last], hits[lo:hi] - cuts[k], slot[lo:hi], word[lo:hi] - first, found.setdefault(int(k), set()))
            rows = [k for k, of in found.items() for _ in of]
            items = [index.ids[i] for of in found.values() for i in of]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64())], ["id", "item_id"])

    return run


def leaked(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, per_edit: int = PER_EDIT, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id): the documents that hold a passage of an item, and the items whose passages they hold.

    item ids are bigints. The items' texts are gathered block by block: a block has at most block_chars characters, or
    one item; each block is compared with all documents.
    """
    once = items.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    schema = f"id {documents.schema[id_col].dataType.simpleString()}, item_id bigint"
    out, block, size = None, [], 0

    def compared() -> DataFrame:
        index = Index.of([i for i, _ in block], [t for _, t in block], q, min_words, per_edit)
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _matches(shared.value, min_words, per_edit)(batches)

        return texts.mapInArrow(run, schema)

    for row in once.toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            out = compared() if out is None else out.unionByName(compared())
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    out = compared() if out is None else out.unionByName(compared())
    return out.distinct()
