"""Repeated byte strings, by a column-wise collection BWT of what can repeat.

Wanted: every byte covered by a `LENGTH`-byte string that also starts in a document of a smaller id. The
Burrows-Wheeler transform (BWT) and the common prefixes (LCP) of a collection are built column by column, one
symbol of every piece each round; strings of LENGTH bytes that are equal are neighbours in the order, joined
by common prefixes of LENGTH or more, and their least document id is what each occurrence is held against.

A round passes over all that is inserted, so the rounds must be few and the collection split:

1. Anchors. Of each window of LENGTH bytes the GRAM-byte grams of least hash are anchors, so equal windows have
   equal anchors in equal places, and every window has one. Anchors' hashes meet in buckets, blocks of them at
   a time; those in one text only can be in no repeated window and go. A hash common within a block is known
   to repeat there and sends one witness, so a passage of a third of all documents sends a row a block.
2. Pieces. Around each anchor left, the bytes that windows with this anchor can span (PIECE at most) are a
   piece. Pieces meet by anchor, so a bucket's collection is complete in itself and takes PIECE rounds.
3. Answers. An occurrence's windows that start in a smaller document too go back to its text as bits.

Exact copies of a text are settled by their digest: all their windows start in the copy of least id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .scratch import Scratch, documents, join_groups, shuffle_partitions

LENGTH, GRAM = 50, 16
WINDOWS = LENGTH - GRAM + 1
PIECE = LENGTH + WINDOWS - 1
#: A piece as it is moved: its bytes, their number, and where in them its anchor begins.
ROW = PIECE + 2
#: Bytes of text that a task takes at once, and that a bucket of anchors or pieces gets of them on average.
BLOCK, ANCHORS_OF, PIECES_OF = 8 << 20, 24 << 20, 12 << 20
#: Pieces that a task cuts at once.
CUT_AT_ONCE = 1 << 19
#: Pieces that a collection holds on average at most; its arrays then stay near the processor.
COLLECTION = 2048
#: Kinds of windows: by the bytes that they hold left of their anchor, from each number to before the next.
KINDS = (0, 5, 9, 14, 18, 22, 26, 31, WINDOWS)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    n = len(data) - GRAM + 1
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    eight = np.ascontiguousarray(view).view(np.uint64).ravel()
    h = np.zeros(n, B.U64)
    for s in range(0, GRAM, 8):
        h = (h ^ eight[s : s + n]) * B.U64(0x9E3779B97F4A7C15)
        h ^= h >> B.U64(32)
    return h * B.U64(0xD6E8FEB86659FD93)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: span - width], x[width - span :]) if span < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    h = gram_hashes(data)
    least = sliding_min(h, WINDOWS)
    edge = np.zeros(WINDOWS - 1, B.U64)
    highest = ~sliding_min(~np.concatenate([edge, least, edge]), WINDOWS)
    at = np.flatnonzero(h == highest)
    return at, h[at]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about BLOCK bytes at a time with the bytes and offsets of the texts in column 1."""

    def block(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return rows, *B.buffers(rows.column(1))

    held, size = [], 0
    for batch in batches:
        _, at = B.buffers(batch.column(1))
        for i, j in B.blocks(at, BLOCK):
            if held and size + at[j] - at[i] > BLOCK:
                yield block(held)
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size += at[j] - at[i]
    if held:
        yield block(held)


_ANCHOR_ROWS = "bucket long, known boolean, docs binary, counts binary, pos binary, hash binary"


def _anchored(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in _blocks(batches):
            ids = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [anchors(data[at[k] : at[k + 1]]) for k in range(len(ids))]
            doc = np.repeat(np.arange(len(ids)), [len(p) for p, _ in found])
            pos = np.concatenate([p for p, _ in found]).astype(np.uint32)
            h = np.concatenate([x for _, x in found])
            if not len(h):
                continue
            # Hashes of more than one row of the block repeat for certain; one of each is a witness.
            order = np.argsort(h, kind="stable")
            starts = _runs(h[order])
            many = np.maximum.reduceat(doc[order], starts) > np.minimum.reduceat(doc[order], starts)
            size = np.diff(np.append(starts, len(h)))
            known = np.zeros(len(h), bool)
            known[order] = np.repeat(many, size)
            witness = np.zeros(len(h), bool)
            witness[order[starts[many]]] = True
            bucket = ((h >> B.U64(33)) % B.U64(buckets)).astype(np.int64)
            out = []
            for flag, some in ((True, known), (False, ~known | witness)):
                rows_of = np.flatnonzero(some)
                if not len(rows_of):
                    continue
                rows_of = rows_of[np.argsort(bucket[rows_of], kind="stable")]
                cuts = _runs(bucket[rows_of])
                for a, b in zip(cuts, np.append(cuts[1:], len(rows_of)), strict=True):
                    own = rows_of[a:b]
                    first = _runs(doc[own])
                    counts = np.diff(np.append(first, len(own))).astype(np.uint32)
                    hashes = b"" if flag else (h[own] & B.U64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                    out.append((int(bucket[own[0]]), flag, ids[doc[own[first]]].tobytes(), counts.tobytes(), pos[own].tobytes(), hashes))
            types = (pa.int64(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "known", "docs", "counts", "pos", "hash"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Runs of rows with one value in column 0, which the rows are sorted by."""
    from itertools import groupby

    rows = (r for batch in batches for k in range(0, batch.num_rows, 4) for r in batch.slice(k, 4).to_pylist())
    return groupby(rows, key=lambda r: r["bucket"])


def _grouped(keys: list[np.ndarray], values: list[np.ndarray], groups: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Values of documents, keys[0], in few rows: one for each group of documents by hash."""
    if not len(keys[0]):
        return
    group = (B.mix(keys[0].astype(B.U64)) % B.U64(groups)).astype(np.int64)
    order = np.lexsort((keys[0], group))
    starts = _runs(group[order])
    out = [(int(group[order[a]]), *(x[order[a:b]].tobytes() for x in keys + values)) for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True)]
    columns = [pa.array(x, pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out, strict=True))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *names])


def _gathered(types: list, names: list[str], keys: int):
    """Rows of _grouped, sorted by bucket, to a row a document (and further keys) with its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            parts = [[np.frombuffer(r[n], t) for n, t in zip(names, types, strict=True)] for r in rows]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.lexsort(columns[:keys][::-1])
            columns = [c[order] for c in columns]
            change = np.zeros(len(order), bool)
            change[:1] = True
            for c in columns[:keys]:
                change[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(change)
            ends = np.append(first[1:], len(order))
            for k in range(0, len(first), 1024):
                some = slice(k, k + 1024)
                lists = [pa.array([c[a:b].tobytes() for a, b in zip(first[some], ends[some], strict=True)], pa.binary()) for c in columns[keys:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[first[some]]) for c in columns[:keys]), *lists], names)

    return run


def _repeated(groups: int):
    """Positions of anchors whose hash is in two rows of blocks at least, or known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            docs, pos, h = [], [], []
            for r in rows:
                own = np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32))
                if r["known"]:
                    yield from _grouped([own], [np.frombuffer(r["pos"], np.uint32)], groups, ["doc_id", "pos"])
                else:
                    docs.append(own)
                    pos.append(np.frombuffer(r["pos"], np.uint32))
                    h.append(np.frombuffer(r["hash"], np.uint32))
            if h:
                # Within a block a hash is in one row only, so another block's is another row's.
                block = np.repeat(np.arange(len(h)), [len(x) for x in h])
                docs, pos, h = np.concatenate(docs), np.concatenate(pos), np.concatenate(h)
                order = np.argsort(h, kind="stable")
                starts = _runs(h[order])
                many = np.maximum.reduceat(block[order], starts) > np.minimum.reduceat(block[order], starts)
                keep = np.zeros(len(h), bool)
                keep[order] = np.repeat(many, np.diff(np.append(starts, len(h))))
                yield from _grouped([docs[keep]], [pos[keep]], groups, ["doc_id", "pos"])

    return run


_PIECE_ROWS = "bucket long, docs binary, tids binary, counts binary, pos binary, piece binary, pieces binary"


def _cut(buckets: int):
    """Rows (doc_id, text, tid, pos) to blocks of pieces by bucket; equal pieces of a block go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in _blocks(batches):
            ids, tids = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
            doc, pos = [], []
            for k, x in enumerate(rows.column(3).to_pylist()):
                own = np.unique(np.frombuffer(x, np.uint32))
                own = own[own.astype(np.int64) + GRAM <= at[k + 1] - at[k]]
                doc.append(np.full(len(own), k))
                pos.append(own)
            doc, pos = np.concatenate(doc), np.concatenate(pos).astype(np.int64)
            # A block has an anchor in some 17 bytes, but one of a single repeated byte has one at each.
            for k in range(0, len(doc), CUT_AT_ONCE):
                yield cut(ids, tids, data, at, doc[k : k + CUT_AT_ONCE], pos[k : k + CUT_AT_ONCE])

    def cut(ids: np.ndarray, tids: np.ndarray, data: np.ndarray, at: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        padded = np.concatenate([data, np.zeros(PIECE, np.uint8)])
        begin, end = at[doc], at[doc + 1]
        lo = np.maximum(begin + pos - (WINDOWS - 1), begin)
        size = np.minimum(begin + pos + LENGTH, end) - lo
        cells = np.arange(PIECE)
        whole = np.empty((len(doc), ROW), np.uint8)
        for k in range(0, len(doc), 1 << 16):
            part = slice(k, k + (1 << 16))
            whole[part, :PIECE] = padded[np.minimum(lo[part, None] + cells, len(padded) - 1)] * (cells < size[part, None])
        whole[:, PIECE], whole[:, PIECE + 1] = size, begin + pos - lo
        eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))).view(B.U64).ravel()
        a = begin + pos
        bucket = (B.mix(eight[a] * B.U64(0x9E3779B97F4A7C15) + eight[a + 8]) % B.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = _runs(bucket[order])
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[a:b]
            pieces, which = np.unique(whole[own].view(f"V{ROW}").ravel(), return_inverse=True)
            first = _runs(doc[own])
            heads = doc[own[first]]
            counts = np.diff(np.append(first, len(own))).astype(np.uint32)
            start = (lo - begin)[own].astype(np.uint32)
            out.append((int(bucket[own[0]]), ids[heads].tobytes(), tids[heads].tobytes(), counts.tobytes(), start.tobytes(), which.astype(np.uint32).tobytes(), pa.compress(pieces.tobytes(), "zstd", asbytes=True)))
        types = (pa.int64(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _PIECE_ROWS.split(", ")])

    return run


def collection_bwt(pieces: np.ndarray, sizes: np.ndarray, cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The BWT of a collection with, for each suffix in order, its piece, its start and the length of its
    common prefix with the one before (of at most `cap`).

    pieces has a row a piece, UTF-8 bytes left-aligned. Round j inserts, for each piece of at least j symbols,
    its suffix of length j: what stands before a suffix, sorted stably, gives the order of the suffixes one
    longer, and a common prefix is one more than the least between the two shorter suffixes. A piece's end
    sorts first, ends among themselves by piece. Symbol 0 stands for a piece's beginning. Which piece and start
    a place belongs to follows in the end from the BWT, by walking each piece back from its end.
    """
    n = len(sizes)
    symbols = np.zeros((n, pieces.shape[1] + 1), np.uint8)
    symbols[:, 1:] = pieces + 1  # no byte of UTF-8 is 255
    sizes = sizes.astype(np.int64)
    bwt, lcp = symbols[np.arange(n), sizes], np.zeros(n, np.uint8)
    at, live = np.arange(n), np.arange(n)  # positions of the last round's suffixes, ascending, and their pieces

    def sorted_places(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of what does not begin a piece, by symbol, and where each of all places comes among them."""
        order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        return order, rank

    for length in range(1, int(sizes.max(initial=0)) + 1):
        grown = sizes[live] >= length
        at, live = at[grown], live[grown]
        order, rank = sorted_places(bwt)
        r = rank[at]
        # Least common prefixes from the last suffix before of the same symbol, and to the next behind.
        guarded = np.append(lcp, np.uint8(0))

        def least(lo: np.ndarray, hi: np.ndarray, by: np.ndarray, same: np.ndarray, guarded: np.ndarray = guarded) -> np.ndarray:
            """1 + min(guarded[lo:hi]) where `same`, else 0; `by` orders spans so that none reaches a later one's."""
            out = np.zeros(len(lo), np.uint8)
            k = np.flatnonzero(same)
            k = k[np.argsort(-by[k], kind="stable")]
            if len(k):
                pairs = np.stack([lo[k], hi[k]], 1).ravel()
                out[k] = np.minimum(np.minimum.reduceat(guarded, pairs)[::2], cap - 1) + 1
            return out

        before = order[np.maximum(r - 1, 0)]
        own = least(before + 1, at + 1, at, (r > 0) & (bwt[before] == bwt[at]))
        behind = order[np.minimum(r + 1, len(order) - 1)]
        next_same = (r + 1 < len(order)) & (bwt[behind] == bwt[at])
        after = least(at + 1, behind + 1, at, next_same)
        # Insert: new places in the list of all, those of the old in the same order between.
        place = r + n
        sorter = np.argsort(place, kind="stable")
        place, live = place[sorter], live[sorter]
        old = np.ones(len(bwt) + len(place), bool)
        old[place] = False

        def merged(was: np.ndarray, fresh: np.ndarray, old: np.ndarray = old, place: np.ndarray = place) -> np.ndarray:
            out = np.empty(len(old), was.dtype)
            out[old], out[place] = was, fresh
            return out

        bwt = merged(bwt, symbols[live, sizes[live] - length])
        lcp = merged(lcp, own[sorter])
        follows = np.flatnonzero(place + 1 < len(old))
        next_old = follows[old[place[follows] + 1]]
        lcp[place[next_old] + 1] = after[sorter][next_old]
        at = place
    piece, start = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.uint8)
    _, rank = sorted_places(bwt)
    here, live = np.arange(n), np.arange(n)
    for length in range(int(sizes.max(initial=0)) + 1):
        grown = sizes[live] >= length
        live, here = live[grown], here[grown] if not length else rank[here[grown]] + n
        piece[here], start[here] = live, sizes[live] - length
    return bwt, piece, start, lcp


def eights(pieces: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of `size` bytes, eight at least, of each piece from its own place on; nothing after them counts."""
    flat = np.ascontiguousarray(pieces).ravel()
    words = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    begin = np.arange(len(pieces)) * pieces.shape[1] + at
    value = np.zeros(len(pieces), B.U64)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        value = B.mix((value ^ words[begin + k].view(B.U64).ravel()) * B.U64(0x9E3779B97F4A7C15))
    return value


def related(pieces: np.ndarray) -> np.ndarray:
    """Which pieces may share a window with another. A window holds its anchor and, of what it holds besides, a
    part left and the rest right of it; by the size of the left part the windows are of a few kinds, and two
    pieces that share a window of a kind share what all windows of that kind hold around the anchor."""
    anchor, end = pieces[:, PIECE + 1].astype(np.int64), pieces[:, PIECE].astype(np.int64)
    out = np.zeros(len(pieces), bool)
    for first, last in zip(KINDS, KINDS[1:], strict=False):
        size = first + GRAM + LENGTH - GRAM - (last - 1)
        own = np.flatnonzero((anchor >= first) & (anchor - first + size <= end))
        if not len(own):
            continue
        value = eights(pieces[own], anchor[own] - first, size)
        order = np.argsort(value, kind="stable")
        starts = _runs(value[order])
        counts = np.diff(np.append(starts, len(order)))
        out[own[order]] |= np.repeat(counts > 1, counts)
    return out


def by_anchor(pieces: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """Some pieces in collections of about COLLECTION, each complete: pieces of one anchor stay together."""
    value = eights(pieces[own], pieces[own, PIECE + 1].astype(np.int64), GRAM)
    part = value % B.U64(max(1, len(own) // COLLECTION))
    order = np.argsort(part, kind="stable")
    cuts = _runs(part[order])
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield own[order[a:b]]


def first_starts(pieces: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each piece and window start in it, the least of `docs` (one a piece) over all pieces that hold
    the window's bytes; the greatest integer where no window starts."""
    out = np.full((len(sizes), WINDOWS), np.iinfo(np.int64).max)
    _, piece, start, lcp = collection_bwt(pieces, sizes)
    groups = np.flatnonzero(lcp < LENGTH)
    least = np.minimum.reduceat(docs[piece], groups) if len(groups) else docs[:0]
    least = np.repeat(least, np.diff(np.append(groups, len(piece))))
    long = sizes[piece].astype(np.int64) - start >= LENGTH
    out[piece[long], start[long]] = least[long]
    return out


@contextmanager
def spooled(root: str) -> Iterator[tuple]:
    """A sequential file of a task's own in the shared folder, to be written and then read from its beginning."""
    store, base = fs.FileSystem.from_uri(root)
    path = f"{base}/{uuid.uuid4().hex}"
    store.create_dir(base, recursive=True)
    try:
        yield (lambda: store.open_output_stream(path)), (lambda: store.open_input_stream(path))
    finally:
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)


def _answered(groups: int, root: str):
    """For each document of a bucket's pieces, the pieces of which some window starts in a smaller one: their
    places, and a bit for each window. Occurrences wait in a sequential file below `root`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            known: dict[bytes, int] = {}
            least: list[int] = []
            with spooled(root) as (write, read):
                lengths = []
                spool = write()
                for r in rows:
                    docs, counts = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)
                    piece = np.frombuffer(r["piece"], np.uint32)
                    raw = pa.decompress(r["pieces"], (int(piece.max()) + 1) * ROW, "zstd", asbytes=True)
                    names = [known.setdefault(raw[k : k + ROW], len(known)) for k in range(0, len(raw), ROW)]
                    least += [np.iinfo(np.int64).max] * (len(known) - len(least))
                    lowest = np.full(len(names), np.iinfo(np.int64).max)
                    np.minimum.at(lowest, piece, np.repeat(docs, counts))
                    for k, d in zip(names, lowest.tolist(), strict=True):
                        least[k] = min(least[k], d)
                    parts = [r["docs"], r["tids"], r["counts"], r["pos"], np.array(names, np.uint32)[piece].tobytes()]
                    lengths.append([len(x) for x in parts])
                    spool.write(b"".join(parts))
                spool.close()
                whole = np.frombuffer(b"".join(known), np.uint8).reshape(-1, ROW)
                least = np.array(least, np.int64)
                # Windows of a piece that shares none with another start in the piece's own documents only.
                size = whole[:, PIECE].astype(np.int64)
                own_bits = (B.U64(1) << np.clip(size - LENGTH + 1, 0, WINDOWS).astype(B.U64)) - B.U64(1)
                some = np.flatnonzero(related(whole))
                row = np.full(len(whole), -1)
                row[some] = np.arange(len(some))
                starts = np.empty((len(some), WINDOWS), np.int64)
                for part in by_anchor(whole, some):
                    starts[row[part]] = first_starts(whole[part, :PIECE], whole[part, PIECE], least[part])
                spool = read()
                answers = []
                for sizes in lengths:
                    docs, tids, counts, pos, piece = (np.frombuffer(spool.read(n), t) for n, t in zip(sizes, (np.int64, np.int64, np.uint32, np.uint32, np.uint32), strict=True))
                    own = np.repeat(np.arange(len(docs)), counts)
                    bits = np.where(least[piece] < docs[own], own_bits[piece], B.U64(0))
                    again = np.flatnonzero(row[piece] >= 0)
                    at, doc, found = row[piece[again]], docs[own[again]], np.zeros(len(again), B.U64)
                    for w in range(WINDOWS):
                        found |= (starts[at, w] < doc).astype(B.U64) << B.U64(w)
                    bits[again] = found
                    hit = np.flatnonzero(bits)
                    answers.append([docs[own[hit]], tids[own[hit]], pos[hit], bits[hit]])
                    if sum(len(x[0]) for x in answers) > 1 << 19:
                        columns = [np.concatenate(x) for x in zip(*answers, strict=True)]
                        answers = []
                        yield from _grouped(columns[:2], columns[2:], groups, ["doc_id", "tid", "pos", "bits"])
                spool.close()
                if answers:
                    columns = [np.concatenate(x) for x in zip(*answers, strict=True)]
                    yield from _grouped(columns[:2], columns[2:], groups, ["doc_id", "tid", "pos", "bits"])

    return run


def covered(size: int, pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes are covered by windows that start at pos + w where bit w is set; in memory as the text is long."""
    begins = np.zeros(size + LENGTH, np.int32)
    for w in range(WINDOWS):
        begins[pos[(bits >> B.U64(w)) & B.U64(1) == 1] + w] = 1
    total = np.concatenate([np.zeros(LENGTH, np.int32), np.cumsum(begins[:size], dtype=np.int32)])
    return total[LENGTH:] > total[:size]


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, copy, hits) to the texts without what repeats."""
    import hashlib

    for rows, data, at in _blocks(batches):
        out = []
        for k, (copy, hits) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
            text = data[at[k] : at[k + 1]]
            gone = np.full(len(text), bool(copy) and len(text) >= LENGTH)
            if hits and not copy:
                pos, bits = np.frombuffer(hits["pos"], np.uint32).astype(np.int64), np.frombuffer(hits["bits"], B.U64)
                gone = covered(len(text), pos, bits)
            spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
            kept = text[~gone].tobytes()
            out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        types = (*[pa.int64()] * 3, pa.string(), pa.binary())
        columns = [rows.column(0), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def strip_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text).

    A byte goes if a LENGTH-byte string that covers it also starts in a row of a smaller doc_id; strings are
    judged on the input and end with their text. kept is what is left, as bytes: cuts may fall inside a
    character. A null text counts as empty. Rows of one doc_id are not held against each other; a row
    without doc_id is held against nothing and nothing is held against it. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("tid", F.xxhash64("text"))
    long = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    marks = scratch.table(long.select("doc_id", "tid", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n")), "marks")
    reps = marks.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    reps = scratch.table(reps.where("last > rep").select("sha", "rep", "rows"), "reps")
    copies = scratch.table(join_groups(marks, reps, "sha", "rows", "doc_id").where("doc_id > rep").select("doc_id", "tid").distinct(), "copies")
    size = marks.agg(F.sum("n")).first()[0] or 0
    parts = shuffle_partitions(spark)

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")

    found = bucketed(long.select("doc_id", "text").mapInArrow(B.trimmed(_anchored(max(4, size // ANCHORS_OF))), _ANCHOR_ROWS))
    found = bucketed(found.mapInArrow(B.trimmed(_repeated(parts)), "bucket long, doc_id binary, pos binary"))
    found = scratch.table(found.mapInArrow(B.trimmed(_gathered([np.int64, np.uint32], ["doc_id", "pos"], 1)), "doc_id long, pos binary"), "anchors")
    scratch.drop(marks)
    scratch.release()
    # Copies meet by doc_id alone, as anchors do, so that the texts are dealt out once.
    settled = copies.groupBy("doc_id").agg(F.collect_set("tid").alias("settled"))
    held = long.join(found, "doc_id").join(settled, "doc_id", "left")
    held = held.where(~F.coalesce(F.array_contains("settled", F.col("tid")), F.lit(False))).select("doc_id", "text", "tid", "pos")
    hits = bucketed(held.mapInArrow(B.trimmed(_cut(max(4, size // PIECES_OF))), _PIECE_ROWS)).mapInArrow(B.trimmed(_answered(parts, scratch.path("spool"))), "bucket long, doc_id binary, tid binary, pos binary, bits binary")
    hits = bucketed(hits).mapInArrow(B.trimmed(_gathered([np.int64, np.int64, np.uint32, B.U64], ["doc_id", "tid", "pos", "bits"], 2)), "doc_id long, tid long, pos binary, bits binary")
    hits = scratch.table(hits.select("doc_id", "tid", F.struct("pos", "bits").alias("hits")), "hits")
    del held
    scratch.drop(found)
    scratch.release()
    out = docs.join(hits, ["doc_id", "tid"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "tid"], "left")
    return out.select("doc_id", "text", "copy", "hits").mapInArrow(B.trimmed(_stripped), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(documents(spark, sf_dir)).drop("kept")
