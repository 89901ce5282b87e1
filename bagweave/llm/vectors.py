"""The k most similar vectors for every vector, by score-aware quantisation, table scans and exact reranking.

Vectors are scaled to length 1, so the largest inner product is the smallest distance. Cells are trained on a bounded
sample (TRAIN_ROWS rows); every row is indexed, in its nearest cell, and searches its own and some neighbouring cells.
Once, where a row is read, its residual to the cell's centre is quantised in subspaces of SUB values with 16 codewords
each: two codes a byte. The quantisation is anisotropic: error parallel to the vector, which shifts the scores of its
nearest neighbours, costs ETA times as much as error across it. A query makes a table of its inner products with the 16
codewords of each subspace, in 16-bit steps; a scan adds up, for each member of a cell, the entries that its codes look
up. What passes the scan is reranked with the exact vectors.

With max_distance the scan's threshold loses nothing: for a query within r of x, the score of the quantised x' differs
from that of x by at most |x . (x - x')| + r |x - x'|, and both terms are known for each x; what the tables' steps may
take away is bounded too. A query then searches the cells whose boundary is within `slack` x max_distance of it (1:
nothing is lost; a smaller share only loses a neighbour whose difference points at one cell boundary with more than that
share of its length). Without max_distance a query searches its `probes` nearest cells and reranks the RERANK best of
each group of cells. Unless given, probes are set by measurement: some rows are compared with the whole table, and so many cells are
searched that these hold `recall` of their true nearest rows (`probes_for`).

Two levels: neighbouring cells form groups, the unit of the shuffle, to which a row goes once as a member and once for
all cells there that it searches. The sample bounds the number of cells, so with more rows they grow; a cell of more than
SPLIT_ROWS members is divided by a k-means of its own in the task that has it, and with max_distance a query searches
only the parts that it can reach. A group that is expected to have more than BLOCK_ROWS rows is divided into blocks of
members and of queries, which meet in all combinations; the partial results are merged.

Results for special input: rows without id, and vectors that are missing, of another length, not finite or all zero,
are left out; a row that occurs again whole counts once; of equally near vectors those with the smallest ids count; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample and of the index made from it.
TRAIN_ROWS, MAX_CELLS, CELL_ROWS = 40_000, 2048, 400
#: Rows of a group of cells, members of a cell that is divided, members or queries of one block of a group.
GROUP_ROWS, SPLIT_ROWS, BLOCK_ROWS = 16_384, 1600, 65_536
SUB, CODES, RERANK = 2, 16, 256
#: Threshold of the score-aware loss; it gives the weight of parallel error as (d - 1) T^2 / (1 - T^2).
THRESHOLD = 0.5
#: Rows whose true nearest rows set the number of searched cells, and the share of these that must lie in them.
ASKED, RECALL = 400, 0.95
EPS = 1e-6


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their values) of a column of lists of doubles."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    values = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return right[good], values[good]


def pack_values(values: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of bytes, floats and doubles that holds it exactly."""
    kind = next(t for t in ("u1", "<f4", "<f8") if t == "<f8" or ((values >= 0) & (values <= 255) if t == "u1" else np.abs(values) < 3e38).all() and (values.astype(t) == values).all())
    raw = np.ascontiguousarray(values.astype(kind))
    size = raw.shape[1] * raw.itemsize
    data = raw.tobytes()
    return [data[i : i + size] for i in range(0, len(data), size)]


def unpack_values(packed: list[bytes], dim: int) -> np.ndarray:
    kinds = {dim: "u1", 4 * dim: "<f4", 8 * dim: "<f8"}
    sizes = {len(p) for p in packed}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(packed), kinds[sizes.pop()]).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(p, kinds[len(p)]).astype(np.float64) for p in packed]) if packed else np.empty((0, dim))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest value is taken out first, so no square overflows."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 2048] @ centres.T - half, axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest_centre(x, centres)
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        centres[there] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def _codebooks(residual: np.ndarray, x: np.ndarray, eta: float, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """(subspaces, CODES, SUB) codewords, trained for the score-aware loss."""
    books = []
    for s in range(0, x.shape[1], SUB):
        r, own = residual[:, s : s + SUB].astype(np.float64), x[:, s : s + SUB].astype(np.float64)
        weight = np.eye(r.shape[1]) + (eta - 1) * own[:, :, None] * own[:, None, :]
        book = r[rng.choice(len(r), CODES, replace=len(r) < CODES)].copy()
        target = np.einsum("nij,nj->ni", weight, r)
        for _ in range(rounds):
            e = r[:, None, :] - book[None]
            code = np.argmin((e * e).sum(2) + (eta - 1) * np.einsum("nkj,nj->nk", e, own) ** 2, axis=1)
            left, right = np.zeros((CODES, *weight.shape[1:])), np.zeros((CODES, r.shape[1]))
            np.add.at(left, code, weight)
            np.add.at(right, code, target)
            used = np.bincount(code, minlength=CODES) > 0
            book[used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
        books.append(book)
    return np.stack(books).astype(np.float32)


@dataclass
class Index:
    """What all tasks share: cells, their groups, codewords, and the number of blocks of each group."""

    centres: np.ndarray
    group: np.ndarray
    apart: np.ndarray
    books: np.ndarray
    blocks: np.ndarray
    eta: float
    dim: int

    @classmethod
    def train(cls, sample: np.ndarray, rows: int, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        x = unit(sample).astype(np.float32)
        dim = x.shape[1]
        eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        k = int(max(1, min(MAX_CELLS, rows // CELL_ROWS, len(x) // 8)))
        centres = k_means(x, k, 5, rng)
        own = _nearest_centre(x, centres)
        part = rng.choice(len(x), min(len(x), 4096), replace=False)
        padded = np.zeros((len(part), -(-dim // SUB) * SUB), np.float32)
        padded_x = padded.copy()
        padded[:, :dim], padded_x[:, :dim] = x[part] - centres[own[part]], x[part]
        books = _codebooks(padded, padded_x, eta, 6, rng)
        apart = np.sqrt(np.maximum(0, (centres**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * centres @ centres.T))
        groups = min(k, max(16, -(-rows // GROUP_ROWS)))
        # fitted on rows, so that groups have like numbers of them
        group = np.unique(_nearest_centre(centres, k_means(x, groups, 8, rng)), return_inverse=True)[1]
        groups = int(group.max()) + 1
        share = np.bincount(group[own], minlength=groups) / max(1, len(x))
        blocks = np.maximum(1, np.ceil(share * rows / BLOCK_ROWS)).astype(np.int64)
        return cls(centres, group, apart.astype(np.float32), books, blocks, eta, dim)

    def encode(self, x: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """Four-bit codes of unit vectors: the best codeword of each subspace given those of all others."""
        n, m = len(x), len(self.books)
        width = m * SUB
        r, own = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
        r[:, : self.dim], own[:, : self.dim] = residual, x
        r, own = r.reshape(n, m, SUB), own.reshape(n, m, SUB)
        codes = np.zeros((n, m), np.uint8)
        parallel = np.zeros(n, np.float32)
        across = (self.books**2).sum(2)
        for j in range(m):
            # |r - c|^2 up to a constant, and the parallel error so far
            loss = across[j] - 2 * (r[:, j] @ self.books[j].T)
            shift = (parallel + (r[:, j] * own[:, j]).sum(1))[:, None] - own[:, j] @ self.books[j].T
            loss += np.float32(self.eta - 1) * shift * shift
            codes[:, j] = np.argmin(loss, axis=1)
            parallel = shift[np.arange(n), codes[:, j]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The codewords that the codes look up."""
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)[:, : self.dim]

    def cells(self, x: np.ndarray, margin: float | None, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row; row, cell of each search)."""
        half = (self.centres**2).sum(1) / 2
        homes, rows, cells = [], [], []
        for i in range(0, len(x), 1024):
            score = x[i : i + 1024] @ self.centres.T - half
            home = np.argmax(score, axis=1)
            if margin is None:
                near = np.argpartition(-score, min(probes, score.shape[1]) - 1, axis=1)[:, :probes]
                r, c = np.repeat(np.arange(len(score)), near.shape[1]), near.ravel()
            else:
                # the distance to a cell's boundary is (score of home - its score) / distance of the centres
                score += np.float32(margin + EPS) * self.apart[home]
                r, c = np.divmod(np.flatnonzero(score >= score[np.arange(len(score)), home][:, None]), score.shape[1])
            homes.append(home)
            rows.append(r + i)
            cells.append(c)
        return (np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)) if homes else (np.empty(0, int),) * 3


def _mix(ids: np.ndarray) -> np.ndarray:
    """A hash of ids, for the blocks."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack_codes(packed: np.ndarray, width: int) -> np.ndarray:
    """(subspaces, rows) of codes."""
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, :width].T.copy()


_ROW = pa.schema([("grp", pa.int32()), ("members", pa.int32()), ("queries", pa.int32()), ("role", pa.int8()), ("id", pa.int64()), ("home", pa.int32()), ("cells", pa.binary()), ("code", pa.binary()), ("least", pa.float32()), ("vec", pa.binary())])
_ROW_SQL = "grp int, members int, queries int, role tinyint, id bigint, home int, cells binary, code binary, least float, vec binary"


def _binaries(rows: np.ndarray) -> list[bytes]:
    data, size = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return [data[i : i + size] for i in range(0, len(data), size)]


def _spread(shared, max_distance: float | None, margin: float | None, probes: int, query_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row as a member of its cell's group (role 1), as a query of groups with cells it searches (2), or both (3)."""
        index: Index = shared.value
        for batch in batches:
            which, values = matrix(batch.column(1), index.dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[which].astype(np.int64)
            if len(ids) == 0:
                continue
            packed = pack_values(values)
            x = unit(values).astype(np.float32)
            home, row, cell = index.cells(x, margin, probes)
            if query_every > 1:
                asked = ids[row] % query_every == 0
                row, cell = row[asked], cell[asked]
            residual = x - index.centres[home]
            codes = index.encode(x, residual)
            error, r = residual - index.decode(codes), max_distance or 0.0
            least = (1 - r**2 / 2) - np.abs((x * error).sum(1)) - r * np.sqrt((error * error).sum(1)) - EPS
            codes = _binaries(pack_codes(codes))
            # one row for all cells of a group that a query searches
            order = np.lexsort((cell, index.group[cell], row))
            row, cell = row[order], cell[order].astype(np.int32)
            key = row * len(index.blocks) + index.group[cell]
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
            cells = {int(key[a]): cell[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
            mix, out = _mix(ids), []
            for i, (h, g) in enumerate(zip(home.tolist(), index.group[home].tolist(), strict=True)):
                b = int(index.blocks[g])
                asks = cells.pop(i * len(index.blocks) + g, None)
                if b == 1:
                    out.append((g, 0, 0, 1 if asks is None else 3, i, h, asks))
                    continue
                # a member meets every block of queries, a query every block of members
                own = int(mix[i] % np.uint64(b))
                out += [(g, own, q, 1, i, h, None) for q in range(b)]
                if asks is not None:
                    out += [(g, m, own, 2, i, -1, asks) for m in range(b)]
            for k, asks in cells.items():
                i, g = divmod(k, len(index.blocks))
                b = int(index.blocks[g])
                own = int(mix[i] % np.uint64(b))
                out += [(g, m, own, 2, i, -1, asks) for m in range(b)]
            grp, member, query, role, at, homes, asks = zip(*out, strict=True)
            inside = [r != 2 for r in role]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, t) for c, t in ((grp, pa.int32()), (member, pa.int32()), (query, pa.int32()), (role, pa.int8()))),
                    pa.array(ids[list(at)]), pa.array(homes, pa.int32()), pa.array(asks, pa.binary()),
                    pa.array([codes[i] if m else None for i, m in zip(at, inside, strict=True)], pa.binary()),
                    pa.array(least[list(at)], pa.float32()), pa.array([packed[i] for i in at], pa.binary()),
                ],
                schema=_ROW,
            )

    return run


_FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])


class _Tables:
    """A block of queries' inner products with all codewords, in whole steps from the least entry of each subspace on."""

    def __init__(self, q: np.ndarray, books: np.ndarray):
        n, (m, _, sub) = len(q), books.shape
        padded = np.zeros((n, m * sub), np.float32)
        padded[:, : q.shape[1]] = q
        entries = np.matmul(books, padded.reshape(n, m, sub).transpose(1, 2, 0))
        low = entries.min(axis=(1, 2), keepdims=True)
        # the largest sum fits into 16 bits
        self.step = float(max((entries - low).max(), 1e-12)) / (65_535 // m)
        self.base, self.slop = float(low.sum()), m * self.step
        self.entries = ((entries - low) / np.float32(self.step)).astype(np.uint16)

    def scan(self, codes: np.ndarray) -> np.ndarray:
        """(members, queries) sums of the entries that the codes (subspaces, members) look up. A score is base + step x
        sum, and at most slop more."""
        total = self.entries[0].take(codes[0], axis=0)
        part = np.empty_like(total)
        for table, code in zip(self.entries[1:], codes[1:], strict=True):
            table.take(code, axis=0, out=part, mode="clip")
            total += part
        return total


def _rerank(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact distances of pairs of unit vectors."""
    out = np.empty(len(row))
    for i in range(0, len(row), 65_536):
        d = q[row[i : i + 65_536]] - x[col[i : i + 65_536]]
        out[i : i + 65_536] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, part of each row) of a cell with more members than the sample foresaw."""
    rng = np.random.default_rng(len(x))
    sample = x if len(x) <= TRAIN_ROWS else x[rng.choice(len(x), TRAIN_ROWS, replace=False)]
    centres = k_means(sample, min(len(sample) // 8, -(-len(x) // CELL_ROWS)), 4, rng)
    return centres, _nearest_centre(x, centres)


def _search(shared, k: int, max_distance: float | None, margin: float | None):
    def leaves(index: Index, cell: int, xm: np.ndarray, xq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(members, queries) to be compared, as places in the cell's own."""
        if len(xm) <= SPLIT_ROWS or margin is None:
            yield np.arange(len(xm)), np.arange(len(xq))
            return
        centres, part = _parts(xm)
        half = (centres**2).sum(1) / 2
        score = xq @ centres.T - half
        best = np.argmax(score, axis=1)
        apart = np.sqrt(np.maximum(0, 2 * half[:, None] + 2 * half[None] - 2 * centres @ centres.T))
        reached = score + np.float32(margin + EPS) * apart[best] >= score[np.arange(len(xq)), best][:, None]
        for p in range(len(centres)):
            yield np.flatnonzero(part == p), np.flatnonzero(reached[:, p])

    def run(table: pa.Table) -> pa.Table:
        """One block of members and one of queries of a group of cells."""
        index: Index = shared.value
        role, ids, home = (table.column(c).to_numpy() for c in ("role", "id", "home"))
        packed = table.column("vec").to_pylist()
        # rows that occur again whole count once; equal vectors are compared once
        vectors: dict[bytes, int] = {}
        of = np.fromiter((vectors.setdefault(v, len(vectors)) for v in packed), np.int64, len(packed))
        x = unit(unpack_values(list(vectors), index.dim))
        x32 = x.astype(np.float32)
        members, queries = {}, {}
        for roles, into in ((1, members), (2, queries)):
            chosen = np.flatnonzero(role & roles)
            for i, v in sorted(set(zip(ids[chosen].tolist(), of[chosen].tolist(), strict=True))):
                into.setdefault(v, []).append(i)
        # members by cell, queries by each cell they search
        inside, first = np.flatnonzero(role & 1), {}
        for i in inside.tolist():
            first.setdefault(int(of[i]), i)
        m = np.fromiter(first.values(), np.int64, len(first))
        asks, seen = {}, set()
        cells_of = table.column("cells").to_pylist()
        for i in np.flatnonzero(role & 2).tolist():
            if (v := int(of[i])) not in seen:
                seen.add(v)
                for c in np.frombuffer(cells_of[i], np.int32).tolist():
                    asks.setdefault(c, []).append(v)
        if len(m) == 0 or not asks:
            return _FOUND.empty_table()
        codes = table.column("code").take(pa.array(m)).to_pylist()
        codes = unpack_codes(np.frombuffer(b"".join(codes), np.uint8).reshape(len(m), -1), len(index.books))
        least = table.column("least").to_numpy()[m]
        cell_of, made = home[m], []
        # the best of all cells so far: sums and members
        asking = np.array(sorted(seen))
        most = max(RERANK, 2 * k)
        top = (np.full((len(asking), most), -np.inf, np.float32), np.zeros((len(asking), most), np.int32)) if max_distance is None else None
        for cell in np.unique(cell_of).tolist():
            if cell not in asks:
                continue
            own, q = np.flatnonzero(cell_of == cell), np.array(asks[cell])
            for im, iq in leaves(index, cell, x32[of[m[own]]], x32[q]):
                for i in range(0, len(iq), 1024):
                    ask, mine = q[iq[i : i + 1024]], own[im]
                    if len(mine) == 0:
                        continue
                    tables = _Tables(x32[ask], index.books)
                    sums = tables.scan(codes[:, mine])
                    offset = x32[ask] @ index.centres[cell]
                    if max_distance is None:
                        at = np.searchsorted(asking, ask)
                        score = np.concatenate([top[0][at], sums.T * np.float32(tables.step) + (offset + np.float32(tables.base))[:, None]], axis=1)
                        member = np.concatenate([top[1][at], np.broadcast_to(mine, (len(ask), len(mine)))], axis=1)
                        best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                        top[0][at], top[1][at] = np.take_along_axis(score, best, 1), np.take_along_axis(member, best, 1)
                        continue
                    need = (least[mine][:, None] - (offset + np.float32(tables.base + tables.slop))[None]) * np.float32(1 / tables.step)
                    col, row = np.nonzero(sums >= need - 1)
                    a, b = ask[row], of[m[mine[col]]]
                    distance = _rerank(x, x, a, b)
                    near = distance <= max_distance + EPS
                    made.append((a[near], b[near], distance[near]))
        if top is not None:
            row, col = np.nonzero(top[0] > -np.inf)
            a, b = asking[row], of[m[top[1][row, col]]]
            made.append((a, b, _rerank(x, x, a, b)))
        if not made:
            return _FOUND.empty_table()
        a, b, distance = (np.concatenate(c) for c in zip(*made, strict=True))
        order = np.lexsort((distance, a))
        a, b, distance = a[order], b[order], distance[order]
        cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        out_a, out_b, out_d = [], [], []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            near = []
            for j in range(start, end):
                # with ties, one more than k since a query doesn't find itself
                near += [(other, distance[j]) for other in members[int(b[j])][: k + 1]]
                if len(near) > k and j + 1 < end and distance[j + 1] > distance[j]:
                    break
            near.sort(key=lambda p: (p[1], p[0]))
            for asker in queries[int(a[start])]:
                mine = [p for p in near if p[0] != asker][:k]
                out_a += [asker] * len(mine)
                out_b += [p[0] for p in mine]
                out_d += [p[1] for p in mine]
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_d, pa.float64())], schema=_FOUND)

    return run


def sample_of(df: DataFrame, id_col: str, vec_col: str, dim: int, seed: int) -> tuple[int, np.ndarray]:
    """(rows of df, usable vectors of a sample of at most about TRAIN_ROWS rows, chosen by a hash of their ids)."""
    rows = df.count()
    space = 1 << 20
    take = min(space, int(space * TRAIN_ROWS / max(1, rows)) + 1)
    chosen = df.where(F.col(id_col).isNotNull()).where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(space)) < take).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(pack_values(values) if len(values) else [], pa.binary())], ["vec"])

    return rows, unpack_values(sorted(chosen.mapInArrow(packed, "vec binary").limit(2 * TRAIN_ROWS).toArrow().column("vec").to_pylist()), dim)


def train_index(df: DataFrame, id_col: str, vec_col: str, dim: int, seed: int = 7) -> Index | None:
    """The index from a bounded sample; None without usable rows."""
    rows, sample = sample_of(df, id_col, vec_col, dim, seed)
    return Index.train(sample, rows, seed) if len(sample) else None


def probes_for(rows: DataFrame, shared, k: int, recall: float = RECALL, asked: int = ASKED, seed: int = 11) -> int:
    """The fewest nearest cells that hold `recall` of the k nearest rows of `asked` rows, found by comparing these with
    all rows. rows: id, vec array<double>."""
    spark, index = rows.sparkSession, shared.value
    order = F.xxhash64(F.col("id"), F.lit(seed))
    picked = _usable(rows, index.dim).orderBy(order, "id").limit(asked).toArrow()
    if picked.num_rows == 0:
        return 1
    own, at = np.unique(picked.column("id").to_numpy(), return_index=True)
    q = unit(unpack_values(picked.column("vec").to_pylist(), index.dim))[at]
    asks = spark.sparkContext.broadcast((own, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = asks.value
        for batch in batches:
            which, values = matrix(batch.column(1), index.dim)
            if len(which) == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[which].astype(np.int64)
            x = unit(values)
            cell = _nearest_centre(x.astype(np.float32), index.centres)
            score = q @ x.T
            score[own[:, None] == ids[None]] = -2
            # copies of a row may take up to its places, so more than k of each batch
            top = np.argpartition(-score, min(2 * k, len(ids)) - 1, axis=1)[:, : 2 * k]
            a = np.repeat(np.arange(len(own)), top.shape[1])
            b = top.ravel()
            some = score[a, b] > -2
            a, b = a[some], b[some]
            yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(ids[b]), pa.array(cell[b].astype(np.int32)), pa.array(score[a, b])], ["id", "other", "cell", "score"])

    true = rows.mapInArrow(run, "id bigint, other bigint, cell int, score double").groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "other", "cell"))), 1, k).alias("best"))
    found = true.select("id", F.explode("best.cell").alias("cell")).toArrow()
    if found.num_rows == 0:
        return 1
    score = q.astype(np.float32) @ index.centres.T - (index.centres**2).sum(1) / 2
    rank = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
    place = np.sort(rank[np.searchsorted(own, found.column("id").to_numpy()), found.column("cell").to_numpy()])
    return int(place[int(np.ceil(recall * len(place))) - 1]) + 1


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, values = matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(pack_values(values) if len(values) else [], pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, "id bigint, vec binary")


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, max_distance: float | None = None, slack: float = 0.25, probes: int | None = None, query_every: int = 1) -> DataFrame:
    """(id, other, distance, rank): for every usable row its k most similar other rows, or those within max_distance.

    query_every: only ids divisible by it ask; all rows are searched. probes: cells that a row searches without
    max_distance; None: as measured by `probes_for`.
    """
    spark = df.sparkSession
    index = train_index(df, id_col, vec_col, dim)
    if index is None:
        return spark.createDataFrame([], "id bigint, other bigint, distance double, rank int")
    shared = spark.sparkContext.broadcast(index)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    if max_distance is None and probes is None:
        probes = probes_for(rows, shared, k)
    margin = None if max_distance is None else slack * max_distance
    spread = rows.mapInArrow(_spread(shared, max_distance, margin, probes or 1, query_every), _ROW_SQL)
    found = spread.groupBy("grp", "members", "queries").applyInArrow(_search(shared, k, max_distance, margin), "id bigint, other bigint, distance double")
    # at most k rows of each group that a query searched
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "other"))), 1, k).alias("best"))
    return merged.select("id", F.posexplode("best").alias("rank", "best")).select("id", F.col("best.other").alias("other"), F.col("best.distance").alias("distance"), (F.col("rank") + 1).cast("int").alias("rank"))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, max_distance: float, slack: float = 0.25) -> DataFrame:
    """(a, b), a < b: pairs within max_distance of which one is among the other's k nearest."""
    found = nearest(df, id_col, vec_col, dim, k, max_distance, slack)
    return found.where(F.col("id") != F.col("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
