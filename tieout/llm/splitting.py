"""Cutting oversized texts at natural boundaries with an overlap: successor tables and pointer doubling."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tieout.llm.tokens import DEFAULT, encoding

#: Tokens that one step of the work holds at once, unless one text has more.
STRIP = 250_000
#: A piece starts at most so many tokens before its overlap, to start at a word.
BACK = 48
#: Kinds of boundary before a token, best last.
INSIDE, ANY, WORD, SENTENCE, LINE, PARAGRAPH = range(-1, 5)
_TABLES: dict[str, tuple[np.ndarray, ...]] = {}


def _tables(path: str) -> tuple[np.ndarray, ...]:
    """Per token of the vocabulary: bytes; starts with white space; starts within a character; ends with a line feed;
    is line feeds alone; ends a sentence; ends with white space."""
    if path not in _TABLES:
        enc = encoding(path)
        raw = [b""] * (enc.max_token_value + 1)
        for b in enc.token_byte_values():
            raw[enc.encode_single_token(b)] = b
        flag = lambda f: np.array([bool(b) and f(b) for b in raw])
        _TABLES[path] = (
            np.array([len(b) for b in raw], np.int64),
            flag(lambda b: b[:1] in b" \n\r\t"),
            flag(lambda b: b[0] & 0xC0 == 0x80),
            flag(lambda b: b[-1:] == b"\n"),
            flag(lambda b: b.endswith(b"\n\n")),
            flag(lambda b: b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b";", b":") or b in (b'."', b'?"', b'!"')),
            flag(lambda b: b[-1:] in b" \n\r\t"),
        )
    return _TABLES[path]


def boundary_levels(tokens: np.ndarray, path: str = DEFAULT) -> np.ndarray:
    """The kind of boundary before each token, and after the last (PARAGRAPH)."""
    _, space, within, feed, feeds, stop, white = _tables(path)
    n = len(tokens)
    out = np.full(n + 1, ANY, np.int8)
    out[0] = out[n] = PARAGRAPH
    if n > 1:
        before, here = tokens[:-1], tokens[1:]
        level = np.where(space[here] & ~white[before] | white[before] & ~space[here], WORD, ANY)
        level = np.where(stop[before] & space[here], SENTENCE, level)
        level = np.where(feed[before] & ~space[here], LINE, level)
        level = np.where((feeds[before] | feed[before] & np.concatenate([[False], feed[before][:-1]])) & ~space[here], PARAGRAPH, level)
        out[1:n] = np.where(within[here], INSIDE, level)
    return out


def successors(levels: np.ndarray, capacity: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a piece that starts at each boundary of one text: where it ends, and where the next starts.

    It ends at the farthest boundary of the best kind in the second half of its capacity, else at the farthest legal one.
    The next starts ``overlap`` tokens earlier, or at the nearest word up to BACK tokens before. The text's end leads
    only to itself."""
    n = len(levels) - 1
    at = np.arange(n + 1)
    last = [np.maximum.accumulate(np.where(levels >= k, at, -1)) for k in (ANY, WORD, SENTENCE, LINE, PARAGRAPH)]
    reach = np.minimum(at + capacity, n)
    least = at + max(capacity // 2, overlap + 1)
    end = last[0][reach]
    for known in last[1:]:
        end = np.where(known[reach] >= least, known[reach], end)
    end = np.where(reach == n, n, end)
    stuck = end <= at + overlap
    end = np.where(stuck, np.minimum(at + capacity, n), end)
    back = np.maximum(end - overlap, 0)
    word = last[1][back]
    # Half the capacity holds the overlap and the way back, so that every piece ends beyond the one before.
    step = max(0, min(BACK, capacity // 2 - overlap - 4))
    start = np.where((word >= back - step) & (word > at), word, last[0][back])
    start = np.where(start <= at, np.maximum(back, at + 1), start)
    return end, np.where(end == n, n, start)


def starts(follow: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All boundaries that the chains from ``first`` visit, by pointer doubling: with the successor table squared each
    round, what is visited doubles its depth, so rounds are the logarithm of the longest chain."""
    seen = np.zeros(len(follow), bool)
    seen[first] = True
    while True:
        found = np.zeros_like(seen)
        found[follow[seen]] = True
        if not (found & ~seen).any():
            return np.flatnonzero(seen)
        seen |= found
        follow = follow[follow]


PIECES = "limit_name string, doc_id long, piece int, token_start long, token_end long, n_tokens long, char_start long, char_end long, text string"
_PIECES = pa.schema([("limit_name", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("n_tokens", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("text", pa.string())])


def cut_texts(docs: Sequence[tuple[int, bytes, np.ndarray]], limit: tuple[str, int, int], path: str = DEFAULT) -> Iterator[tuple]:
    """PIECES of (doc_id, UTF-8 text, tokens) under one limit; texts within the capacity give none. The texts' successor
    tables are laid end to end, and all chains followed at once."""
    name, capacity, overlap = limit
    long = [d for d in docs if len(d[2]) > capacity]
    if not long:
        return
    width = _tables(path)[0]
    ends, follows, base, firsts = [], [], 0, []
    for _, _, tokens in long:
        end, follow = successors(boundary_levels(tokens, path), capacity, overlap)
        ends.append(end)
        follows.append(follow + base)
        firsts.append(base)
        base += len(follow)
    visited = starts(np.concatenate(follows), np.array(firsts))
    bounds = np.searchsorted(visited, np.array(firsts + [base]))
    for k, (doc_id, raw, tokens) in enumerate(long):
        begin = visited[bounds[k] : bounds[k + 1]] - firsts[k]
        begin = begin[begin < len(tokens)]
        stop = ends[k][begin]
        offset = np.concatenate([[0], np.cumsum(width[tokens])])
        ascii_only = raw.isascii()
        chars = 0
        last_byte = 0
        for i, (s, e) in enumerate(zip(begin.tolist(), stop.tolist())):
            a, b = int(offset[s]), int(offset[e])
            text = raw[a:b].decode("utf-8", "replace")
            if ascii_only:
                c = a
            else:
                chars += len(raw[last_byte:a].decode("utf-8", "replace"))
                last_byte = a
                c = chars
            yield name, doc_id, i, s, e, e - s, c, c + len(text), text


def pieces(docs: DataFrame, limits: DataFrame, path: str = DEFAULT) -> DataFrame:
    """PIECES of (doc_id, text) for each of ``limits`` (limit_name, capacity_tokens, overlap_tokens): every text with more
    tokens than the capacity, cut into pieces of at most the capacity that together hold every character, each sharing
    at least ``overlap_tokens`` tokens with the one before (as many more as take it back to the start of a word).

    Cuts are at paragraphs, else lines, sentences, words, else between characters; a character is never cut. Null,
    empty and short texts give no pieces. An overlap of half the capacity or more, a null or a non-positive capacity is
    an error. A text is one task's work from end to end; nothing is shuffled."""
    known = [(r.limit_name, r.capacity_tokens, r.overlap_tokens or 0) for r in limits.select("limit_name", "capacity_tokens", "overlap_tokens").collect()]
    if any(c is None or c <= 0 or o < 0 or 2 * o >= c for _, c, o in known):
        raise ValueError("capacities must be positive, overlaps under half of them")
    least = min((c for _, c, _ in known), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_to_numpy

        def emit(held: list) -> pa.RecordBatch:
            rows = [r for limit in known for r in cut_texts(held, limit, path)]
            cols = list(zip(*rows)) if rows else [[] for _ in _PIECES]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                if len(raw) <= least:
                    continue
                tokens = encode(text, disallowed_special=())
                if len(tokens) > least:
                    held.append((doc_id, raw, tokens.astype(np.int64)))
                    size += len(tokens)
                if size > STRIP:
                    yield emit(held)
                    held, size = [], 0
            if held:
                yield emit(held)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
