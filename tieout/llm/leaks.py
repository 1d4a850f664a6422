"""Evaluation passages in training texts: template windows, slots checked, alignment in at most two stretches."""

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a template window.
WINDOW = 5
#: Share of an item's words that a leak holds at least.
SHARE = 0.4
#: Words between two matched places of one stretch, at most, on either side.
GAP = 8
#: Share of a stretch's words that must be found.
DENSE = 0.6
#: Template windows that a leak of a long item has in one band of diagonals and in all such bands; share of the item under
#: them. A leak of the least size with every fifth word changed has about ten windows over a fifth of the item, five to a
#: stretch. Of shorter items fewer are needed: no more than a bare SHARE of their words has (``Items.needed``).
BAND, NEEDED, NEEDED_SHARE = 4, 7, 0.15
#: Items that are searched at once.
ITEMS = 5000
#: Characters of items that one pass over the texts takes, held ready in every task: about a gigabyte. Only beyond it are
#: the texts read again.
ITEM_CHARS = 50_000_000
#: Words that one step of the work holds at once, unless one text has more.
STRIP = 400_000
#: Words for units and times, which a re-parameterised question may change.
UNITS = frozenset(
    "dollars dollar cents cent percent pct usd january february march april may june july august september october november december "
    "hours hour days day weeks week months month years year".split()
)
_TAG = re.compile(r"<[^<>]{1,200}>")
_ESCAPE = re.compile(r"\\+[nrt]")
_BREAK = re.compile(r"(?<=[A-Za-z])-[ \t]*\r?\n[ \t>*|#]*(?=[a-z])")
_SIGNS = re.compile("[\u00a0-\u00bf\u02b0-\u02ff\u2000-\u2bff\ufe00-\uffff]+")
#: Letters in lower case, digits as they are, all else blank.
_SPACED = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))
NUM, UNIT, NAME = 1, 2, 3
_FIRST = 10


def words(text: str) -> list[str]:
    """The words of a text in lower case without accents, however it is laid out: tags, entities, escaped breaks and
    breaks within words are taken away. A number is the words between its separators."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = _BREAK.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _SIGNS.sub(" ", text)).encode("ascii", "ignore").decode()
    return text.translate(_SPACED).split()


#: Stands between texts that are searched together; no text has it as a word.
BREAK = " "


class _Kinds(dict):
    """Words to template kinds; any other word is a number or a name."""

    def __missing__(self, w: str) -> int:
        return NUM if w[0] <= "9" else NAME


class Items:
    """Evaluation items made ready for the search: their words, template windows, and a table that finds misspelt words.
    Bounded by ITEMS, whatever the texts are."""

    def __init__(self, items: Sequence[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words(t or "") for _, t in items]
        lower = {w for _, t in items for w in re.findall(r"(?<![A-Za-z])[a-z]+(?![A-Za-z])", t or "")}
        known = sorted({w for ws in self.words for w in ws if w in lower} - UNITS)
        self.kind = _Kinds({w: _FIRST + i for i, w in enumerate(known)} | dict.fromkeys(UNITS, UNIT) | {BREAK: 0})
        # Of a number in several words the first alone counts.
        self.counts = [np.concatenate([[0], np.cumsum([not (w[0] <= "9" and i and ws[i - 1][0] <= "9") for i, w in enumerate(ws)])]).astype(int) for ws in self.words]
        self.base = np.uint64(1_000_003)
        hashes, at = [], []
        for k, ws in enumerate(self.words):
            ids, places = self.template(ws)
            for j, h in enumerate(self.windows(ids).tolist()):
                if (ids[j : j + WINDOW] >= _FIRST).sum() >= 2:
                    hashes.append(h)
                    at.append((k, int(places[j]), int(places[j + WINDOW - 1])))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.at = np.array(at, np.int64).reshape(-1, 3)[order]
        windows = np.bincount(self.at[:, 0], minlength=len(self.words))
        self.needed = np.clip((SHARE * (windows + WINDOW - 1)).astype(np.int64) - WINDOW + 1, 1, NEEDED)
        self.band = np.minimum(self.needed, BAND)
        self.vocabulary = {w for ws in self.words for w in ws}
        self.near: dict[str, set[str]] = {}
        for w in self.vocabulary:
            if len(w) >= 4 and not w[0].isdigit():
                for i in range(len(w)):
                    self.near.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        self.places: list[dict[str, tuple[int, ...]]] = []
        for ws in self.words:
            own: dict[str, tuple[int, ...]] = {}
            for i, w in enumerate(ws):
                own[w] = (*own.get(w, ()), i)
            # Words of other items are no words of this one.
            self.places.append(own | {w: () for w in self.vocabulary - own.keys()})
        self._meant: dict[str, frozenset[str]] = {}

    def template(self, ws: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of the words, names and numbers that follow each other as one, and the place of each kind's word."""
        ids = np.fromiter(map(self.kind.__getitem__, ws), np.int64, len(ws))
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != ids[:-1]) | ((ids[1:] != NAME) & (ids[1:] != NUM))
        return ids[keep], np.flatnonzero(keep)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """A hash of every WINDOW kinds."""
        n = len(ids) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            out = out * self.base + ids[j : j + n].astype(np.uint64)
        return out

    def meant(self, w: str) -> frozenset[str]:
        """The items' words that a text's word may stand for: itself, or those one edit away."""
        found = self._meant.get(w)
        if found is None:
            out = {w} if w in self.vocabulary else set()
            if not out and len(w) >= 4 and not w[0].isdigit():
                for i in range(len(w)):
                    cut = w[:i] + w[i + 1 :]
                    out |= self.near.get(cut, set())
                    if cut in self.vocabulary:
                        out.add(cut)
                out |= self.near.get(w, set())
            found = frozenset(out)
            if len(self._meant) < 100_000:
                self._meant[w] = found
        return found


#: item from, item to, text from, text to, and the places (text, item) of the words found.
Stretch = tuple[int, int, int, int, list[tuple[int, int]]]


def stretches(items: Items, k: int, doc: list[str], anchors: list[tuple[int, int]]) -> list[Stretch]:
    """The stretches of item ``k`` in a text, grown from anchors (place in text, place in item) at which template windows
    meet. Anchors are taken in the text's order; from each not yet covered, matching words are followed both ways, over
    at most GAP words on either side that don't match."""
    own, mine, size = items.places[k], items.words[k], len(doc)

    def places(w: str) -> tuple[int, ...]:
        """Where the item has a word, or one that it may be a misspelling of."""
        found = own.get(w)
        if found is None:
            found = tuple(i for m in items.meant(w) for i in own.get(m, ()))
        return found

    def follow(d: int, i: int, step: int) -> list[tuple[int, int]]:
        """The places matched on the way from a matched place: each the nearest by steps in text and item together; one
        farther than a word put in or left out must have another right after it, or face placeholders alone till there."""
        path: list[tuple[int, int]] = []
        while True:
            best, least = None, GAP + 2
            for a in range(1, GAP + 1):
                dd = d + step * a
                if a + 1 >= least or not 0 <= dd < size:
                    break
                for ii in places(doc[dd]):
                    b = (ii - i) * step
                    if 1 <= b and a + b < least and (a + b <= 3 or again(dd, ii, step) or faced(d, i, step, a, b)):
                        best, least = (dd, ii), a + b
            if best is None:
                return path
            d, i = best
            path.append(best)

    def again(d: int, i: int, step: int) -> bool:
        for x in (1, 2):
            if 0 <= d + step * x < size and any(1 <= (ii - i) * step <= 2 for ii in places(doc[d + step * x])):
                return True
        return False

    def faced(d: int, i: int, step: int, a: int, b: int) -> bool:
        return a == b and all(items.kind[mine[i + step * x]] == items.kind[doc[d + step * x]] < _FIRST for x in range(1, a))

    out: list[Stretch] = []
    for d, i in anchors:
        if any(a <= i <= b and c <= d <= e for a, b, c, e, _ in out):
            continue
        if i not in places(doc[d]):
            continue
        path = [*reversed(follow(d, i, -1)), (d, i), *follow(d, i, 1)]
        out.append((path[0][1], path[-1][1], path[0][0], path[-1][0], path))
    return out


def slots(items: Items, k: int, doc: list[str], found: list[Stretch]) -> tuple[set[int], set[int], set[int]]:
    """The places of item ``k`` in its stretches whose number, unit or name stands there as it is, with another value, and
    with clashing values. Between two words found next to each other, placeholders of the item face the text's words of
    the same kinds; a value must face the same value wherever it stands, and no other value of the item the same one,
    else all its places clash: then the words around are alike by chance, not a question with new parameters."""
    ws = items.words[k]
    is_slot = lambda w: items.kind[w] < _FIRST
    same: set[int] = set()
    faced: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    back: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    at: list[tuple[tuple[str, ...], tuple[str, ...], range]] = []
    for *_, path in found:
        same.update(i for _, i in path if is_slot(ws[i]))
        for (d0, i0), (d1, i1) in zip(path, path[1:]):
            mine, theirs = tuple(ws[i0 + 1 : i1]), tuple(doc[d0 + 1 : d1])
            if mine and theirs and all(map(is_slot, mine)) and {items.kind[w] for w in mine} == {items.kind[w] for w in theirs}:
                faced.setdefault(mine, set()).add(theirs)
                back.setdefault(theirs, set()).add(mine)
                at.append((mine, theirs, range(i0 + 1, i1)))
    changed, clashing = set(), set()
    for mine, theirs, places in at:
        (changed if len(faced[mine]) == 1 and len(back[theirs]) == 1 else clashing).update(places)
    return same, changed - same, clashing - same - changed


def held(found: list[Stretch], counts: np.ndarray, changed: set[int] = frozenset()) -> int:
    """The most words of an item that one stretch, or two in the item's order, hold. A stretch counts from its first to
    its last word if at least DENSE of them are found, consistently ``changed`` ones among them. ``counts``: words before
    each place of the item."""
    size = lambda a, b: int(counts[b + 1] - counts[a]) if b >= a else 0
    good = [(a, b, c, d) for a, b, c, d, path in found if len(path) >= 4 and len(path) + sum(a <= i <= b for i in changed) >= DENSE * (b - a + 1)]
    best = max((size(a, b) for a, b, _, _ in good), default=0)
    for x in range(len(good)):
        a0, b0, c0, d0 = good[x]
        for y in range(len(good)):
            a1, b1, c1, d1 = good[y]
            if x != y and d0 < c1 and a0 < a1 and b1 > b0:
                best = max(best, size(a0, b0) + size(max(a1, b0 + 1), b1))
    return best


LEAKS = "doc_id long, item_id long, held int, words int, same_slots int, changed_slots int, clashing_slots int, slots int"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("held", "words", "same_slots", "changed_slots", "clashing_slots", "slots"))])


def _search(items: Items, docs: list[tuple[int, list[str]]], share: float) -> Iterator[tuple]:
    """LEAKS of some texts: their template windows are looked up among the items' in one go."""
    if not docs or not len(items.hashes):
        return
    every: list[str] = []
    begins = []
    for _, ws in docs:
        begins.append(len(every))
        every += ws
        every.append(BREAK)
    all_ids, at = items.template(every)
    h = items.windows(all_ids)
    low = np.searchsorted(items.hashes, h, "left")
    hit = np.flatnonzero(items.hashes[np.minimum(low, len(items.hashes) - 1)] == h)
    if not len(hit):
        return
    low = low[hit]
    n = np.searchsorted(items.hashes, h[hit], "right") - low
    which = np.repeat(hit, n)
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    k, i0 = items.at[entry, 0], items.at[entry, 1]
    first = np.array(begins, np.int64)
    o = np.searchsorted(first, at[which], "right") - 1
    d = at[which] - first[o]
    # A leak has windows side by side: at least BAND of one diagonal band, NEEDED in all such bands together.
    band = (d - i0 + 1_000_000) >> 4
    pair = o * len(items.words) + k
    order = np.argsort(pair * (1 << 24) + band)
    pair, band = pair[order], band[order]
    # In this order a band and the next lie side by side; a place has enough company if they together have.
    run = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]))
    number = np.diff(run, append=len(pair))
    beside = (pair[run][1:] == pair[run][:-1]) & (band[run][1:] == band[run][:-1] + 1)
    both = np.maximum(number + np.append(number[1:] * beside, 0), number + np.insert(number[:-1] * beside, 0, 0))
    near = np.repeat(both >= items.band[pair[run] % len(items.words)], number)
    order, pair = order[near], pair[near]
    if not len(order):
        return
    run = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    number = np.diff(run, append=len(pair))
    order = order[np.repeat(number >= items.needed[pair[run] % len(items.words)], number)]
    order = order[np.lexsort((d[order], k[order], o[order]))]
    o, k, d, i0 = o[order], k[order], d[order], i0[order]
    if not len(o):
        return
    edge = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1]), [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        item = int(k[a])
        length = int(items.counts[item][-1])
        spots = np.unique(i0[a:b])
        if np.minimum(np.diff(spots, append=spots[-1] + WINDOW), WINDOW).sum() < NEEDED_SHARE * len(items.words[item]):
            continue
        doc_id, ws = docs[int(o[a])]
        found = stretches(items, item, ws, list(zip(d[a:b].tolist(), i0[a:b].tolist())))
        same, changed, clashing = slots(items, item, ws, found)
        most = held(found, items.counts[item], changed)
        if most < share * length or len(clashing) > len(same) + len(changed):
            continue
        yield doc_id, items.ids[item], most, length, len(same), len(changed), len(clashing), sum(items.kind[w] < _FIRST for w in items.words[item])


def leaks(docs: DataFrame, evaluation: DataFrame, share: float = SHARE) -> DataFrame:
    """LEAKS (doc_id, item_id, held, words, same_slots, changed_slots, clashing_slots, slots) of (doc_id, text) and
    (item_id, text): the items that leaked into each document, one row for each pair.

    Both are reduced to templates: numbers, units and names become typed placeholders. Windows of WINDOW template words
    are hashed and joined; where one item's windows meet a text often enough, its own words are followed through the
    text from those places. A pair is a leak if at least ``share`` of the item's words stand there in its order in at
    most two stretches, with words put in, left out or misspelt, or numbers, units and names changed consistently
    (``slots``): a question with new parameters leaks, a text of like wording in which one value faces several doesn't
    by that, and a pair of which more placeholders clash than agree is no leak. The last columns count the item's placeholders as they stand, consistently changed, clashing, and all.

    Items are the stated query set: they are sent to every task and searched in blocks of ITEMS, whose texts are cut into
    words once, in one pass over the documents for every ITEM_CHARS of items; the documents are never shuffled. Repeated
    documents and items count each; null and empty texts have no leaks, nor items of under WINDOW = 5 template words two
    of which are no placeholders. A document may hold many items, an item stand in many documents."""
    listed = [(r.item_id, r.text) for r in evaluation.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator()]
    out = None
    passes, chars = [[]], 0
    for item in listed:
        if chars > ITEM_CHARS:
            passes.append([])
            chars = 0
        passes[-1].append(item)
        chars += len(item[1] or "")
    for taken in passes:

        def run(batches: Iterator[pa.RecordBatch], taken=taken) -> Iterator[pa.RecordBatch]:
            blocks = [Items(taken[k : k + ITEMS]) for k in range(0, len(taken), ITEMS)]
            for batch in batches:
                held_, size, rows = [], 0, []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ws = words(text) if text else []
                    held_.append((doc_id, ws))
                    size += len(ws)
                    if size > STRIP:
                        rows += (row for items in blocks for row in _search(items, held_, share))
                        held_, size = [], 0
                rows += (row for items in blocks for row in _search(items, held_, share))
                cols = list(zip(*rows)) if rows else [[] for _ in _LEAKS]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LEAKS)], schema=_LEAKS)

        part = docs.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out
