"""Packing of token sequences into windows: combinations of lengths by non-negative least squares.

Each task packs its own stream of documents in blocks of about BLOCK windows of tokens, so nothing is shuffled or
collected. In a block, full windows are cut off first. What remains of the documents is binned by length; all
combinations of up to DEPTH bins that fill a window on average are enumerated, and repeat counts that explain the histogram
are solved by non-negative least squares and rounded down. A planned window takes whole documents of its bins, the last two such that
they fill it exactly where there are such. What the plan leaves fills slack, and windows of its own, largest first; only
there are documents cut, where a window ends. A block's last, short window moves on to the next block; a task's last
one is split at powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import give_back, prepare, text_bytes

WINDOW, END_ID = 2048, 1
#: Token ids a document's text may need per block, in windows; and the bins of a window.
BLOCK, BINS, DEPTH = 1024, 32, 4
#: Times that the plan is solved for what the last one left.
ROUNDS = 4
VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces that a worker remembers the ids of.
_CACHE = 500_000
#: Sequences of one task; its number is above these bits of sequence_id.
_TASK_BITS = 36


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters of plain texts: ASCII and Latin-1's letters from A-grave on, which normalise to their lower case alone.
_LETTERS = bytes([*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_PLAIN = bytes(range(0x80)) + _LETTERS
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
#: The vocabulary's own pre-tokeniser, over lower-cased plain texts in Latin-1.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


def plain_pieces(text: bytes) -> list[bytes] | None:
    """What the pre-tokeniser makes of a UTF-8 text, in Latin-1; None where that needs its Unicode rules."""
    if b"<|" in text:  # special tokens are matched before all else
        return None
    if not text.isascii():
        try:
            text = text.decode().encode("latin-1")
        except UnicodeEncodeError:
            return None
        if text.translate(None, _PLAIN):
            return None
    return _PIECE.findall(text.translate(_LOWER))


class WordIds:
    """Token ids of texts, by way of their pieces.

    The vocabulary's rules never join characters across white space, nor across the pieces of its pre-tokeniser,
    so a text's ids are those of its pieces in turn. Plain texts are cut by the pre-tokeniser's rule, others at ASCII
    white space alone. Unseen pieces are encoded together, and what comes out is dealt to them by its offsets.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain: dict[bytes, bytes] = {}
        self.other: dict[bytes, bytes] = {}

    def _learn(self, known: dict[bytes, bytes], pieces: list[bytes], charset: str) -> None:
        texts = [p.decode(charset) for p in pieces]
        ends = np.cumsum([len(t) + 1 for t in texts])
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.asarray(got.ids, "<u4")
        starts = np.asarray([o[0] for o in got.offsets], np.int64)
        cuts = np.searchsorted(starts, ends, "left")
        done = 0
        for piece, cut in zip(pieces, cuts.tolist(), strict=True):
            known[piece] = ids[done:cut].tobytes()
            done = cut

    def _look_up(self, known: dict[bytes, bytes], texts: list[list[bytes]], charset: str) -> list[bytes]:
        if len(known) > _CACHE:
            known.clear()
        unseen = list(set().union(*texts).difference(known)) if texts else []
        for at in range(0, len(unseen), 4096):
            self._learn(known, unseen[at : at + 4096], charset)
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in texts]

    def forget(self) -> None:
        self.plain.clear()
        self.other.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        cut = [plain_pieces(t) for t in texts]
        plain = iter(self._look_up(self.plain, [c for c in cut if c is not None], "latin-1"))
        other = iter(self._look_up(self.other, [t.split() for t, c in zip(texts, cut, strict=True) if c is None], "utf-8"))
        return [next(other if c is None else plain) for c in cut]


@lru_cache(4)
def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Rows of bin counts: every multiset of at most `depth` bins whose middles add up to about `bins` units.

    Bin b holds lengths over b-1 and up to b units, so m pieces of bins that add up to bins + m/2 fill a window on average.
    """
    out: list[list[int]] = []

    def extend(left: int, most: int, chosen: list[int], size: int) -> None:
        if len(chosen) == size:
            if not left:
                out.append(chosen)
            return
        for b in range(min(left, most), 0, -1):
            if b * (size - len(chosen)) < left:
                break
            extend(left - b, b, [*chosen, b], size)

    for size in range(1, depth + 1):
        for total in {bins + size // 2, bins + (size + 1) // 2} if size > 1 else {bins}:
            extend(total, bins, [], size)
    table = np.zeros((len(out), bins), np.int64)
    for row, chosen in zip(table, out, strict=True):
        for b in chosen:
            row[b - 1] += 1
    return table


@lru_cache(4)
def _gram(bins: int, depth: int) -> np.ndarray:
    table = combinations(bins, depth).astype(float)
    return table @ table.T


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300, gram: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson. gram: a.T a, where it is known."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a if gram is None else gram, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        gradient = right - gram @ x
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if passive.all() or gradient[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            trial = np.zeros(n)
            trial[at] = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (trial[at] > 0).all():
                x = trial
                break
            bad = at[trial[at] <= 0]
            step = min(float(x[i] / (x[i] - trial[i])) if x[i] > trial[i] else 0.0 for i in bad)
            x = x + step * (trial - x)
            x[bad[x[bad] <= 1e-12]] = 0
            passive &= x > 0
            passive[j] &= trial[j] > 0
            if not passive.any():
                return np.maximum(x, 0)
    return np.maximum(x, 0)


#: A piece: which document of the block, its first token there, its length.
Piece = tuple[int, int, int]
#: Pieces that are placed together, and their tokens.
Item = tuple[int, tuple[Piece, ...]]


class _Shelves:
    """Items by bin, and within a bin by length."""

    def __init__(self, items: list[Item], bins: int, unit: int):
        self.unit = unit
        self.by_length: list[dict[int, list[Item]]] = [{} for _ in range(bins)]
        self.sizes = np.zeros(bins, np.int64)
        for item in items:
            self.by_length[(item[0] - 1) // unit].setdefault(item[0], []).append(item)
            self.sizes[(item[0] - 1) // unit] += 1

    def take(self, length: int) -> Item:
        b = (length - 1) // self.unit
        held = self.by_length[b][length]
        item = held.pop()
        if not held:
            del self.by_length[b][length]
        self.sizes[b] -= 1
        return item

    def has(self, length: int, besides: int = 0) -> bool:
        """Whether there is an item of the length, one of the length `besides` not counted."""
        b = (length - 1) // self.unit
        return 0 <= b < len(self.by_length) and len(self.by_length[b].get(length, ())) > (length == besides)

    def exact(self, b: int, room: int) -> list[Item] | None:
        """Two items, the first of bin b, that fill the room; or one that does."""
        if room > 0 and self.has(room):
            return [self.take(room)]
        for x in self.by_length[b]:
            if room > x and self.has(room - x, x):
                return [self.take(x), self.take(room - x)]
        return None

    def below(self, b: int, room: int) -> Item | None:
        """The longest item of bin b that fits."""
        fitting = [x for x in self.by_length[b] if x <= room]
        return self.take(max(fitting)) if fitting else None

    def rest(self) -> list[Item]:
        return [item for shelf in self.by_length for held in shelf.values() for item in held]


def _window_of(shelves: _Shelves, chosen: list[int], window: int) -> list[Item]:
    """Items of the chosen bins (longest first), the last two so that the window is filled exactly where there are such."""
    got: list[Item] = []
    room = window
    for b in chosen[:-2]:
        if (item := shelves.below(b, room)) is None:
            return got
        got.append(item)
        room -= item[0]
    last = chosen[-2:]
    if found := shelves.exact(last[0], room):
        return got + found
    for b in last:
        if (item := shelves.below(b, room)) is not None:
            got.append(item)
            room -= item[0]
    return got


def _chained(rest: list[Piece], window: int) -> list[Item]:
    """Pieces as items. Short ones join chains of about a quarter window, so that shallow combinations reach them, but
    for some that stay to fill slack: two for each window, or half of them."""
    shorts = sorted((p for p in rest if p[2] * 16 < window), key=lambda p: (p[2], p[0]))
    items = [(p[2], (p,)) for p in rest if p[2] * 16 >= window]
    loose = min(len(shorts) // 2, 2 * sum(p[2] for p in rest) // window)
    step = len(shorts) / loose if loose else 0
    stay = {int(k * step) for k in range(loose)}
    chain: list[Piece] = []
    length = 0
    for k, piece in enumerate(shorts):
        if k in stay:
            items.append((piece[2], (piece,)))
            continue
        chain.append(piece)
        length += piece[2]
        if length * 16 >= window * (3 + len(items) % 3):
            items.append((length, tuple(chain)))
            chain, length = [], 0
    return items + [(p[2], (p,)) for p in chain]


def _planned(shelves: _Shelves, window: int, bins: int, solve: Callable = nnls) -> list[list[Item]]:
    """Windows of whole items, by repeat counts that explain the histogram; what a round leaves is solved for again."""
    table, out = combinations(bins, DEPTH), []
    for _ in range(ROUNDS):
        repeats = solve(table.T.astype(float), shelves.sizes.astype(float), gram=_gram(bins, DEPTH))
        repeats = np.floor(np.asarray(repeats) + 1e-6).astype(int)
        before = len(out)
        for k in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
            chosen = [b for b in range(bins - 1, -1, -1) for _ in range(table[k][b])]
            for _ in range(repeats[k]):
                if (shelves.sizes < table[k]).any():
                    break
                out.append(_window_of(shelves, chosen, window))
        if len(out) - before < 4:
            break
    return out


def pack_block(lengths: list[int], window: int = WINDOW, bins: int = BINS, solve: Callable = nnls) -> list[list[Piece]]:
    """Documents' lengths -> sequences of pieces; all but the last are full."""
    sequences, rest = [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            sequences.append([(doc, start, window)])
        if n % window:
            rest.append((doc, n - n % window, n % window))
    bins = min(bins, window)
    unit = -(-window // bins)
    shelves = _Shelves(_chained(rest, window), bins, unit)
    planned = _planned(shelves, window, bins, solve)
    spare = sum(n for n, _ in shelves.rest())
    slack = [window - sum(n for n, _ in items) for items in planned]
    order = sorted(range(len(planned)), key=lambda k: slack[k])
    missing, apart = sum(slack), []
    while order and spare < missing:  # too little is left to fill the slack: take the worst windows apart again
        k = order.pop()
        missing -= slack[k]
        spare += window - slack[k]
        apart += planned[k]
    left = _Shelves([(p[2], (p,)) for _, pieces in shelves.rest() + apart for p in pieces], bins, unit)
    open_windows: list[tuple[list[Piece], int]] = []
    for k in sorted(order):
        pieces, room = [p for _, ps in planned[k] for p in ps], slack[k]
        # a whole piece, or two of the shortest, rather than a part of one
        while room and (found := left.exact(min((room - 1) // (2 * unit), bins - 1), room)):
            pieces += [p for _, ps in found for p in ps]
            room = 0
        if room:
            open_windows.append((pieces, room))
        else:
            sequences.append(pieces)
    residual = sorted((p for _, ps in left.rest() for p in ps), key=lambda p: (p[2], p[0]))  # the last, longest, goes first

    def fill(sequence: list[Piece], room: int) -> None:
        while room and residual:
            doc, start, n = residual.pop()
            sequence.append((doc, start, min(n, room)))
            if n > room:
                residual.append((doc, start + room, n - room))
            room -= min(n, room)

    for pieces, room in open_windows:
        fill(pieces, room)
        sequences.append(pieces)
    while residual:
        sequences.append([])
        fill(sequences[-1], window)
    return sequences


def _split_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """A short sequence as sequences whose lengths are powers of two."""
    total, todo, out = sum(p[2] for p in pieces), pieces[::-1], []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            doc, start, n = todo.pop()
            out[-1].append((doc, start, min(n, room)))
            if n > room:
                todo.append((doc, start + room, n - room))
            room -= min(n, room)
    return out


def _packer(path: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << _TASK_BITS
        #: doc_id, ids, first token that isn't placed yet, end of those to place, all tokens
        waiting: list[tuple[int | None, bytes, int, int, int]] = []
        held = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting, held
            docs, waiting, held = waiting, [], 0
            sequences = pack_block([end - first for _, _, first, end, _ in docs], window)
            if sequences and sum(p[2] for p in sequences[-1]) < window:
                short = sequences.pop()
                if final:
                    sequences += _split_powers(short)
                else:
                    for doc, start, n in short:  # a later block places them
                        doc_id, ids, first, _, total = docs[doc]
                        waiting.append((doc_id, ids, first + start, first + start + n, total))
                        held += n
            out = []
            for sequence in sequences:
                offset = 0
                for doc, start, n in sequence:
                    doc_id, ids, first, _, total = docs[doc]
                    at = first + start
                    out.append((doc_id, at, n, ids[4 * at : 4 * (at + n)], total, number, offset))
                    offset += n
                number += 1
                if len(out) >= 4096:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

        for batch in batches:
            texts = batch.column("body").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                ids += END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                waiting.append((doc_id, ids, 0, n, n))
                held += n
                if held >= BLOCK * window:
                    yield from flush(False)
        if waiting:
            yield from flush(True)
        words.forget()
        give_back()

    return pack


@lru_cache(2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> a row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids holds the piece's token ids as little-endian unsigned 32-bit integers. Null and empty texts consist of the end id alone; repeated
    rows and null ids are packed like any others. An empty table gives no rows. The vocabulary's file must exist
    at `path` on every executor.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(_packer(path or vocabulary_path(), window), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
