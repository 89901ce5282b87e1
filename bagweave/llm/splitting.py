"""Splitting oversized texts at natural boundaries, by byte ranges.

Every text, whatever its size, is read in byte ranges: a column's texts out of the Arrow buffer, giant files by offset,
so no worker needs a whole one. A worker detects the boundaries in its range and, in a halo behind it, so many more as a
piece can reach; a halo grows until it holds them. For each place of a range where a piece may begin (the first `limit`
tokens, since a piece from before can't reach further) the worker follows the pieces to the range's end: a table of
bounded size, however large the range is. The tables of a text are stitched in order, one at a time: the place where the
last range was left selects the pieces of the next one, and prefix sums of the ranges' characters and pieces give
offsets and numbers. The pieces are those of a cut of the whole text, whatever the size of the ranges.

A boundary is a place before which a word of the tokenizer's own word pattern ends, unless white space ends there: the
tokens left and right of such a place are the same whether or not the text is cut there, so token counts add up
exactly. A word of more than FINE tokens is divided further, between characters; a piece that ends inside one is counted
by itself. Ranges are read from the first place on that is a boundary in every text (`_SAFE`).

Results for special input: NULL and empty texts, and texts within the limit, yield no pieces; a row that occurs again
counts once, different texts of one id are cut each by itself; the pieces of a text cover it without gaps, and no piece
is above the limit; bytes that are no UTF-8 count as replacement characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.llm.tokens import DEFAULT_VOCABULARY, PATTERN, encoding, well_formed

LIMIT, OVERLAP = 1024, 64
#: Bytes of a range; a text has at most MOST_RANGES of them, then they are longer. Ranges of files are always larger.
RANGE_BYTES, FILE_RANGE, MOST_RANGES = 8192, 8 << 20, 4096
#: Where every text has a boundary: a run of letters or digits ends there, or white space begins.
_SAFE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")
#: Words of more tokens than this are divided between characters.
FINE = 32
#: Ranks of boundaries; a piece ends at the highest rank in its last half.
INSIDE, WORD, SPACE, SENTENCE, LINE = range(5)
_WORDS = regex.compile(PATTERN)
_CLOSERS = "\"'”’»)]}」』"
_ENDS = ".!?…。！？؟。"
_PIECES = "piece_no int, char_start bigint, char_end bigint, n_tokens int"
_RANGE = "name binary, no int, chars bigint, table binary"


class _Counter:
    """Tokens of one word, remembered for the words seen before."""

    def __init__(self, vocabulary: str):
        self.encode, self.known = encoding(vocabulary).encode_ordinary, {}

    def __call__(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.encode(word))
            if len(word) <= 32:
                if len(self.known) > 1_000_000:
                    self.known.clear()
                self.known[word] = n
        return n


def _parts(word: str, count: _Counter) -> Iterator[tuple[str, int]]:
    """A word in parts of at most FINE tokens each; bytes bound tokens, so short ones need no second look."""
    at = 0
    while at < len(word):
        size = FINE
        while size > 1 and len(word[at : at + size].encode()) > 4 * FINE:
            size //= 2
        while size > 1 and count(word[at : at + size]) > FINE:
            size //= 2
        yield word[at : at + size], count(word[at : at + size])
        at += size


def boundaries(text: str, count: _Counter, first: int = 0, last: int | None = None, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, tokens, rank) of the units of a text from `first` on; a unit's rank is that of the boundary at its end.

    White space belongs to the unit that follows it. The end of the text is a boundary, too. With `last`, units beyond
    that place are read only until they have `more` tokens.
    """
    ends, tokens, ranks = [], [], []
    at, held, beyond = first, 0, 0
    before = text[first - 1] if first else ""

    def close(rank: int) -> None:
        nonlocal held, beyond
        ends.append(at)
        tokens.append(held)
        ranks.append(rank)
        if last is not None and at > last:
            beyond += held
        held = 0

    for match in _WORDS.finditer(text, first):
        word = match.group()
        blank = word.isspace()
        if held and not before.isspace():
            rank = WORD
            if word[0].isspace():
                end = before
                if end in _CLOSERS and at > 1:
                    end = text[at - 2] if text[at - 2] in _ENDS else before
                rank = LINE if "\n" in word else SENTENCE if end in _ENDS else SPACE
            elif before in "。！？":
                rank = SENTENCE
            elif word[0] == "'" or before == "'":
                rank = INSIDE
            close(rank)
            if beyond > more:
                return np.array(ends, np.int64), np.array(tokens, np.int64), np.array(ranks, np.int8)
        n = count(word)
        if n > FINE and not blank:
            for part, k in _parts(word, count):
                if held + k > FINE and held:
                    close(INSIDE)
                at += len(part)
                held += k
        elif n > FINE:
            for part, k in _parts(word, count):
                if held:
                    close(LINE if "\n" in word else SPACE)
                at, held = at + len(part), k
        else:
            at += len(word)
            held += n
        before = text[at - 1]
    if held:
        close(LINE)
    return np.array(ends, np.int64), np.array(tokens, np.int64), np.array(ranks, np.int8)


class _Cutter:
    """Follows pieces of at most `limit` tokens over the units of a text, or of a range and what lies behind it.

    A piece ends at the last boundary of the highest rank in its last half. The next piece begins at the last unit
    boundary that leaves an overlap of at least `overlap` tokens. A piece that an overlong word was divided for is
    counted by itself, and ends one unit earlier while it is above the limit.
    """

    def __init__(self, text: str, first: int, table: tuple[np.ndarray, np.ndarray, np.ndarray], ends_here: bool, limit: int, overlap: int, count: _Counter):
        self.text, self.count, self.limit, self.overlap, self.ends_here = text, count, limit, overlap, ends_here
        self.ends, tokens, self.ranks = table
        self.starts = np.concatenate([[first], self.ends[:-1]]) if len(self.ends) else self.ends
        self.sums = np.concatenate([[0], np.cumsum(tokens)])
        self.divided = np.concatenate([[0], np.cumsum(self.ranks == INSIDE)])

    def _size(self, i: int, j: int) -> int:
        """Tokens of the units i..j-1 as one piece."""
        if self.divided[j] == self.divided[max(0, i - 1)]:
            return int(self.sums[j] - self.sums[i])
        return len(self.count.encode(self.text[self.starts[i] : self.ends[j - 1]]))

    def step(self, i: int) -> tuple[int, int, int]:
        """(unit after the piece's last one, its tokens, first unit of the next piece or the number of units)."""
        sums, n = self.sums, len(self.ends)
        left = int(sums[n] - sums[i])
        if self.ends_here and (left <= self.limit or left <= self.limit * 5 // 4 and self._size(i, n) <= self.limit) and (size := self._size(i, n)) <= self.limit:
            return n, size, n
        j = min(n, int(np.searchsorted(sums, sums[i] + self.limit, side="right")) - 1)
        low = max(int(np.searchsorted(sums, sums[i] + self.limit // 2, side="left")), i + 1)
        if low <= j:
            span = self.ranks[low - 1 : j]
            j -= int(np.argmax(span[::-1]))
        j = max(j, i + 1)
        while (size := self._size(i, j)) > self.limit and j > i + 1:
            j -= 1
        if j >= n and self.ends_here:
            return n, size, n
        back = int(np.searchsorted(sums, sums[j] - self.overlap, side="right")) - 1
        return j, size, back if back > i else j


def cut(text: str, count: _Counter, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a whole text, which ranges must reproduce."""
    cutter = _Cutter(text, 0, boundaries(text, count), True, limit, overlap, count)
    pieces, i = [], 0
    while i < len(cutter.ends):
        j, size, after = cutter.step(i)
        pieces.append((int(cutter.starts[i]), int(cutter.ends[j - 1]), size))
        i = after
    return pieces


def _decoded(data: bytes, at_start: bool, at_end: bool) -> tuple[int, str]:
    """(bytes skipped, text) of a part of a UTF-8 text; characters cut at its ends are left out."""
    skip = 0
    while not at_start and skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:
        skip += 1
    end = len(data)
    if not at_end:
        for back in range(1, min(4, end - skip) + 1):
            lead = data[end - back]
            if lead & 0xC0 != 0x80:
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                end -= back if width > back else 0
                break
    return skip, well_formed(data[skip:end].decode("utf-8", "surrogateescape"))


def _safe(text: str, at: int) -> int:
    """The first safe place from `at` on, or the end of what is there."""
    found = _SAFE.search(text, at)
    return found.start() if found else len(text)


def range_table(read: Callable[[int, int], bytes], total: int, start: int, end: int, limit: int, overlap: int, count: _Counter) -> tuple[int, np.ndarray] | None:
    """(characters of the bytes start..end, table of the pieces that may begin in this range).

    read(a, b): the bytes a..b of the text, which has `total`. The table has four rows: start and end of a piece and
    start of the next one, counted in characters from the range's first one, and tokens. None: the text is within the
    limit (known to the first range only).
    """
    halo = limit * 6
    while True:
        low, high = max(0, start - 16), min(total, end + halo)
        data = read(low, high)
        skip, text = _decoded(data, low == 0, high == total)
        # characters before the range's own first and beyond its last one
        heads = np.frombuffer(data, np.uint8)[skip:] & 0xC0 != 0x80
        own, stop = int(heads[: max(0, start - low - skip)].sum()), int(heads[: max(0, end - low - skip)].sum())
        own, stop = min(own, len(text)), min(stop, len(text))
        ends_here = high == total
        first = own if start == 0 else _safe(text, own)
        last = len(text) if end == total else _safe(text, stop)
        table = boundaries(text, count, first, last, limit * 5 // 4) if first < last else (np.zeros(0, np.int64),) * 3
        seen = bool(len(table[0])) and table[0][-1] < len(text)
        if ends_here or (last < len(text) and (first >= last or seen)):
            break
        halo *= 4
    cutter = _Cutter(text, first, table, ends_here and not seen, limit, overlap, count)
    mine = int(np.searchsorted(cutter.starts, last, side="left"))
    entries = [0] if start == 0 else range(min(mine, int(np.searchsorted(cutter.sums, limit, side="left")) + 1))
    made: dict[int, tuple[int, int, int]] = {}
    for i in entries:
        while i < mine and i not in made:
            made[i] = cutter.step(i)
            i = made[i][2]
    n = len(cutter.ends)
    if start == 0 and (mine == 0 or made[0][0] == n and cutter.ends_here):
        return None
    place = lambda i: int(cutter.starts[i]) if i < n else int(cutter.ends[-1])
    rows = [(place(i) - own, int(cutter.ends[j - 1]) - own, place(after) - own, size) for i, (j, size, after) in sorted(made.items())]
    return stop - own, np.array(rows, np.int64).reshape(-1, 4).T


def _size_of_ranges(total: int, least: int) -> int:
    return max(least, -(-total // MOST_RANGES))


def _column_ranges(limit: int, overlap: int, vocabulary: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tables of all ranges of the texts of a column, out of the Arrow buffer."""
        count = _Counter(vocabulary)
        for batch in batches:
            which, rows = [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                buffer = text.as_buffer()
                # a token has a byte or more: what has no more bytes than the limit is within it
                if buffer is None or buffer.size <= limit:
                    continue
                total, name = buffer.size, blake2b(buffer, digest_size=16).digest()
                size = _size_of_ranges(total, least)
                for no, start in enumerate(range(0, total, size)):
                    made = range_table(lambda a, b, buffer=buffer: buffer.slice(a, b - a).to_pybytes(), total, start, min(total, start + size), limit, overlap, count)
                    if made is None:
                        break
                    which.append(i)
                    rows.append((name, no, made[0], made[1].tobytes()))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["id", "name", "no", "chars", "table"])

    return run


def _file_ranges(limit: int, overlap: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tables of ranges (path, total, no, start, size) of files, each read by its offset."""
        count = _Counter(vocabulary)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(path) as file:

                    def read(a: int, b: int, file=file) -> bytes:
                        file.seek(a)
                        return file.read(b - a)

                    made = range_table(read, row["total"], row["start"], min(row["total"], row["start"] + row["size"]), limit, overlap, count)
                if made is not None:
                    out.append((row["path"], row["path"].encode(), row["no"], made[0], made[1].tobytes()))
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["id", "name", "no", "chars", "table"])

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of texts, whose ranges' tables come in order; holds one table at a time."""
    key, no, base, at, number = None, -1, 0, 0, 0
    for batch in batches:
        which, out = [], []
        columns = [batch.column(c).to_pylist() for c in ("id", "name", "no", "chars", "table")]
        for k, (id_, name, r, chars, packed) in enumerate(zip(*columns, strict=True)):
            if (id_, name) != key:
                key, no, base, at, number = (id_, name), -1, 0, 0, 0
            # a copy of a range, or a text whose first range found it to be within the limit
            if r <= no or (r > 0 and no < 0):
                continue
            starts, ends, afters, sizes = np.frombuffer(packed, np.int64).reshape(4, -1)
            while True:
                i = int(np.searchsorted(starts, at - base))
                if i == len(starts) or starts[i] != at - base:
                    break
                which.append(k)
                out.append((number, at, int(ends[i]) + base, int(sizes[i])))
                at, number = int(afters[i]) + base, number + 1
            no, base = r, base + chars
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which, pa.int64())), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], ["id", "piece_no", "char_start", "char_end", "n_tokens"])


def _pieces(tables: DataFrame, kind: str) -> DataFrame:
    return tables.repartition("name").sortWithinPartitions("name", "id", "no").mapInArrow(_stitch, f"id {kind}, {_PIECES}")


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, piece_no, char_start, char_end, n_tokens) for every text of more than `limit` tokens.

    char_start and char_end are offsets in the text, from 0, the end exclusive. Only the tables of the ranges are
    shuffled, by text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return _pieces(texts.mapInArrow(_column_ranges(limit, overlap, vocabulary, range_bytes), f"id {kind}, {_RANGE}"), kind)


def split_files(spark: SparkSession, paths: str | list[str], limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY, range_bytes: int = FILE_RANGE) -> DataFrame:
    """`split_texts` for files in UTF-8, whose id is their path; they are read by byte ranges, by as many workers as they
    have ranges, and never whole."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("total")).where("total > 0")
    size = F.greatest(F.lit(range_bytes), F.ceil(F.col("total") / MOST_RANGES)).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, size)
    ranges = files.select("path", "total", size.alias("size"), F.posexplode(starts).alias("no", "start"))
    return _pieces(ranges.repartition("path", "no").mapInArrow(_file_ranges(limit, overlap, vocabulary), f"id string, {_RANGE}"), "string")
