"""Problem 10: cutting oversized texts at natural boundaries, by agglomerative merging."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.llm.encode import TOKENIZERS, VOCABULARY, encoder
from panelforge.plans.workers import ship

#: Strength of the places to cut at; a place inside a character can't be one.
BROKEN, INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = -1, 0, 1, 2, 3, 4

#: Characters worked on at once.
CHUNK = 300_000

_SPACE, _STOP, _WIDE, _CLOSER, _MORE, _END = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for bit, signs in (
        (_SPACE, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]),
        (_STOP, map(ord, ".!?…")),
        (_WIDE, [0x3002, 0xFF01, 0xFF1F]),
        (_CLOSER, map(ord, "\"')]}`»”’")),
        (_MORE, map(ord, "abcdefghijklmnopqrstuvwxyz0123456789")),
        (_END, [10, 13, 0x2028, 0x2029, 0x85]),
    ):
        table[list(signs)] |= bit
    return table


_CLASS = _classes()


class Chunk:
    """Several texts, end to end: of each end of a token its place in characters and its strength.

    White space between two words is a boundary at the last token end within it: PARAGRAPH if it holds two line ends (CR
    LF is one), LINE with one, SENTENCE if a full stop, with a closing sign, stands before and no small letter or digit
    after, else WORD. Full stops of Chinese and Japanese need no white space.
    """

    def __init__(self, texts: list[str], widths: list[np.ndarray]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.text_at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.token_at = np.concatenate(([0], np.cumsum([len(w) for w in widths])))
        token_end = np.concatenate(([0], np.cumsum(np.concatenate(widths))))
        if codes.max(initial=0) < 0x80:
            place = token_end
            whole = np.ones(len(place), bool)
        else:
            char_end = np.concatenate(([0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))))
            place = np.searchsorted(char_end, token_end)
            whole = char_end[place] == token_end
        self.place = place
        strength = np.where(whole, INSIDE, BROKEN).astype(np.int8)
        kind = _CLASS[np.minimum(codes, 0xFFFF)]
        space = (kind & _SPACE) != 0
        first = np.zeros(len(codes), bool)
        first[self.text_at[:-1]] = True  # white space of two texts isn't one run
        starts = space.copy()
        starts[1:] &= ~space[:-1] | first[1:]
        stops = space.copy()
        stops[:-1] &= ~space[1:] | first[1:]
        ws, we = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        ends = np.flatnonzero(kind & _END)
        ends = ends[~((codes[ends] == 10) & (ends > 0) & (codes[np.maximum(ends - 1, 0)] == 13))]
        lines = np.searchsorted(ends, we) - np.searchsorted(ends, ws)
        before, follow = kind[np.maximum(ws - 1, 0)], kind[np.minimum(we, len(kind) - 1)]
        before = np.where(before & _CLOSER, kind[np.maximum(ws - 2, 0)], before)
        level = np.where((before & _STOP != 0) & (follow & _MORE == 0), SENTENCE, WORD).astype(np.int8)
        level[lines == 1] = LINE
        level[lines >= 2] = PARAGRAPH
        wide = np.flatnonzero(kind & _WIDE) + 1
        if len(wide):
            ws, we, level = np.concatenate((ws, wide)), np.concatenate((we, wide)), np.concatenate((level, np.full(len(wide), SENTENCE, np.int8)))
        if whole.all():
            k = np.searchsorted(place, we, "right") - 1
            good = place[k] >= ws
        else:
            index = np.flatnonzero(whole)
            k = np.searchsorted(place[index], we, "right") - 1
            good = place[index[k]] >= ws
            k = index[k]
        np.maximum.at(strength, k[good], level[good])
        strength[self.token_at] = PARAGRAPH + 1  # ends of texts
        self.strength = strength
        self.by_level = {s: np.flatnonzero(strength >= s) for s in range(INSIDE, PARAGRAPH + 2)}
        self.broken = not whole.all()
        self.broken_before = np.cumsum(~whole) if self.broken else None
        # the last whole place at or before each end of a token
        self.back = np.maximum.accumulate(np.where(whole, np.arange(len(whole)), 0)) if self.broken else None

    def begins(self, starts: np.ndarray, overlap: int, text: np.ndarray) -> np.ndarray:
        """Where pieces with these starts begin, with the overlap: never before their text or inside a character."""
        first = np.maximum(self.token_at[text], starts - overlap)
        return self.back[first] if self.broken else first

    def atoms(self, limit: int, overlap: int) -> np.ndarray:
        """Ends of the segments that merging begins with: the longest that fit as a whole, else tokens.

        In a stretch without a natural place all boundaries are alike, so the smallest pairs go first, from the left:
        tokens become twos, fours and so on, and what is left over at the end joins the last before anything larger is
        merged. So where every token ends between characters it may begin with blocks of a power of two, a quarter of the
        room, with the same result; elsewhere it begins with single tokens.
        """
        points = self.by_level[PARAGRAPH]
        block = 1 << max(0, ((limit - overlap - 3) // 4).bit_length() - 1)
        for level in (LINE, SENTENCE, WORD, INSIDE):
            a, b = points[:-1], points[1:]
            text = np.searchsorted(self.token_at, a, "right") - 1
            long = b - self.begins(a, overlap, text) > limit
            if not long.any():
                break
            inner = self.by_level[level]
            if level == INSIDE:
                plain = long & (self.broken_before[b] == self.broken_before[a]) if self.broken else long
                count = (b[plain] - a[plain] - 1) // block
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
                points = np.union1d(points, np.repeat(a[plain], count) + nth * block)
                if (plain == long).all():
                    break
                a, b, long = a[long & ~plain], b[long & ~plain], None
                at = np.searchsorted(a, inner, "right") - 1
                fresh = inner[(at >= 0) & (inner < b[np.maximum(at, 0)])]
            else:
                segment = np.searchsorted(points, inner, "right") - 1
                fresh = inner[long[np.minimum(segment, len(long) - 1)]]
            points = np.union1d(points, fresh)
        return points


def merge(starts: list[int], begins: list[int], strengths: list[int], end: int, limit: int) -> list[int]:
    """Indices of the segments that remain when neighbours are merged, weakest boundary first, while they fit.

    Segment i runs from starts[i] to the next; with its overlap it begins at begins[i]. Pairs that fit are held in a
    heap by strength, then size together, then place. A pair that doesn't fit never will, as both only grow.
    """
    n = len(starts)
    if n < 2:
        return [0]
    ends = [*starts[1:], end]
    width = max(end, n).bit_length()  # of the parts of a key: strength, size, place
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    heap = [(strengths[i] << 2 * width) | ((ends[i] - starts[i - 1]) << width) | i for i in range(1, n) if ends[i] - begins[i - 1] <= limit]
    heapify(heap)
    low = (1 << width) - 1
    while heap:
        key = heappop(heap)
        i = key & low
        if not alive[i]:
            continue
        left = before[i]
        stop = ends[i]
        if stop - starts[left] != (key >> width) & low:
            continue  # one of the two has grown; their entry of today is in the heap, if they fit
        alive[i] = 0
        ends[left] = stop
        right = after[left] = after[i]
        if right < n:
            before[right] = left
            if ends[right] - begins[left] <= limit:
                heappush(heap, (strengths[right] << 2 * width) | ((ends[right] - starts[left]) << width) | right)
        if left:
            far = before[left]
            if stop - begins[far] <= limit:
                heappush(heap, (strengths[left] << 2 * width) | ((stop - starts[far]) << width) | left)
    return [i for i in range(n) if alive[i]]


def split_chunk(chunk: Chunk, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin with overlap, start, end) of the pieces of the texts longer than ``limit``, in tokens of the chunk.

    A segment that fits as a whole is never parted: its inner boundaries are weaker than those around it, so they would
    be merged first. Hence merging may begin with the longest such segments, and goes to sentences, words or tokens
    only inside what is too long.
    """
    points = chunk.atoms(limit, overlap)
    starts = points[:-1]
    text = np.searchsorted(chunk.token_at, starts, "right") - 1
    begins = chunk.begins(starts, overlap, text)
    strengths = chunk.strength[starts]
    sizes = np.diff(chunk.token_at)
    cuts = np.searchsorted(starts, chunk.token_at)
    keep: list[np.ndarray] = []
    for t in np.flatnonzero(sizes > limit).tolist():
        a, b = int(cuts[t]), int(cuts[t + 1])
        base = int(chunk.token_at[t])
        kept = merge((starts[a:b] - base).tolist(), (begins[a:b] - base).tolist(), strengths[a:b].tolist(), int(sizes[t]), limit)
        keep.append(np.asarray(kept, np.int64) + a)
    at = np.concatenate(keep) if keep else np.empty(0, np.int64)
    owner = text[at]
    end = np.concatenate((starts[at][1:], [0])) if len(at) else at
    last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(at) else at.astype(bool)
    end = np.where(last, chunk.token_at[owner + 1], end)
    return owner, begins[at], starts[at], end


def split_texts(df: DataFrame, item: str, text: str, budgets: list[tuple[int, int, int]], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of each text longer than a budget; ``budgets``: (budget_id, max_tokens, overlap_tokens).

    Sizes are in tokens of the whole text's encoding. piece is text[start_char:end_char]; it begins with overlap_tokens
    of the piece before (more where that place lies inside a character, back to the last end of a token that is the end of
    one; fewer only where the text has fewer before it) and has n_tokens, at most max_tokens, with them. boundary names the place the piece ends at.
    Null, empty and short texts give no rows; repeated rows give their pieces again; null items are kept. Each text is
    encoded once for all budgets, where it was read, without a shuffle.
    """
    for _, limit, overlap in budgets:
        if overlap < 0 or limit < overlap + 8:
            raise ValueError("max_tokens must be at least overlap_tokens + 8, overlap_tokens not negative")
    field = df.schema[item]
    names = ["budget_id", item, "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary", "piece"]
    kinds = [T.IntegerType(), field.dataType, *[T.IntegerType()] * 2, *[T.LongType()] * 2, *[T.IntegerType()] * 2, *[T.StringType()] * 2]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    smallest = min((b[1] for b in budgets), default=1 << 40)

    def rows(source: pa.RecordBatch, took: list[int], texts: list[str], ids: list[np.ndarray], enc) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(texts, [enc.widths[x] for x in ids])
        row = np.asarray(took)
        for budget, limit, overlap in budgets:
            owner, begin, start, end = split_chunk(chunk, limit, overlap)
            if not len(owner):
                continue
            base = chunk.text_at[owner]
            a, b = chunk.place[begin] - base, chunk.place[end] - base
            counts = np.bincount(owner, minlength=len(texts))
            first = np.concatenate(([0], np.cumsum(counts)))[owner]
            strength = chunk.strength[end]
            pieces = [texts[o][x:y] for o, x, y in zip(owner.tolist(), a.tolist(), b.tolist())]
            n = len(owner)
            boundary = pa.DictionaryArray.from_arrays(pa.array(strength.astype(np.int32)), pa.array(["inside", "word", "sentence", "line", "paragraph", "end"])).cast(pa.string())
            columns = [
                pa.array(np.full(n, budget, np.int32)), source.column(0).take(pa.array(row[owner])), pa.array((np.arange(n) - first + 1).astype(np.int32)), pa.array(counts[owner].astype(np.int32)),
                pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array((end - begin).astype(np.int32)), pa.array((start - begin).astype(np.int32)), boundary, pa.array(pieces, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for batch in batches:
            took, texts, ids, size = [], [], [], 0
            for i, cell in enumerate(batch.column(1)):
                value = cell.as_py()
                if not value or 4 * len(value) <= smallest:  # a token has at least one byte, a character at most four
                    continue
                encoded = enc.encode(value)
                if len(encoded) <= smallest:
                    continue
                took.append(i)
                texts.append(value)
                ids.append(encoded)
                size += len(value)
                if size > CHUNK:
                    yield from rows(batch, took, texts, ids, enc)
                    took, texts, ids, size = [], [], [], 0
            if took:
                yield from rows(batch, took, texts, ids, enc)

    ship(df.sparkSession)
    return df.select(item, text).mapInArrow(run, schema)


def split_documents(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """Pieces of the documents for each budget of purpose split (a table of a few rows, at any scale)."""
    rows = budgets.filter("lower(purpose) = 'split'").orderBy("budget_id").collect()
    return split_texts(documents, "doc_id", "text", [(r["budget_id"], r["max_tokens"], r["overlap_tokens"] or 0) for r in rows])
