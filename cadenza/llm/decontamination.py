"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Items too long for the LSH to reach its recall are compared wherever enough of their grams are found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import per_text, table

SIMILARITY = 0.8
#: Chance, at each length of items, that the LSH finds a passage with as many edits as are allowed.
RECALL = 0.97
#: Items a task holds at once; larger benchmarks are searched in parts.
PART_ITEMS = 20_000
SAMPLED = 4
SAMPLES_PER_WALK = 6
MOST_WALKS = 64
#: Longer items are not tried with walks, of which they need too many.
WALKED_WORDS = 1000
#: Copies with random edits for each number of edits, to count the walks by.
TRIALS = 400
#: Numbers a task keeps at once of embedded windows or of pairs of grams and items.
CELLS = 1 << 22
#: Texts a task searches at once.
TEXT_ROWS = 1000

_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Known(dict):
    def __missing__(self, word: str) -> int:
        return 0


def allowed_edits(words: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * words + 1e-9)


def _gram_size(n: int, k: int) -> tuple[int, int]:
    """Longest grams of which some must survive ``k`` edits of ``n`` words, and how many do: each edit spoils ``q`` at most."""
    for q in (3, 2):
        if n - q + 1 - q * k >= 1:
            return q, n - q + 1 - q * k
    return 1, max(1, n - k)


def _gram_codes(ids: np.ndarray, q: int) -> np.ndarray:
    """Code of the ``q`` words from each position on; 0 where one is unknown."""
    if len(ids) < q:
        return np.zeros(0, np.uint64)
    m = len(ids) - q + 1
    code, known = np.full(m, q, np.uint64), np.ones(m, bool)
    for i in range(q):
        part = ids[i : i + m]
        known &= part > 0
        code = code * _MIX[0] + part.astype(np.uint64)
    return np.where(known, _mix(code) | np.uint64(1), np.uint64(0))


def _walk_keys(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int, share: np.ndarray) -> np.ndarray:
    """Sampled symbols of the CGK embeddings of windows, one key for each sample and window.

    The embedding writes the word under the cursor at every step and moves on if a random bit of
    (walk, step, word) says so; past the window it writes nothing.  The cursor is through a window after about
    twice its length; ``share`` (samples, symbols) tells where in these steps the sampled symbols lie.
    """
    at, ends, last = starts.copy(), starts + sizes, len(ids) - 1
    length = int(2 * sizes.max())
    written = np.empty((length, len(starts)), np.int64)
    for j in range(length):
        inside = at < ends
        word = np.where(inside, ids[np.minimum(at, last)], -1)
        written[j] = word
        bit = _mix((word + 2).astype(np.uint64) * _MIX[0] + np.uint64((walk << 16) + j)) & np.uint64(1)
        at += bit.astype(bool) & inside
    column, keys = np.arange(len(starts)), []
    for s, places in enumerate(share):
        key = (sizes.astype(np.uint64) << np.uint64(20)) + np.uint64((walk << 8) + s)
        for place in places:
            key = _mix(key * _MIX[0] + (written[(place * 2 * sizes).astype(np.int64), column] + 2).astype(np.uint64))
        keys.append(key)
    return np.array(keys)


def _pairs(keys: np.ndarray, owner: np.ndarray, wanted: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners of the sorted ``keys`` equal to a wanted one, each with the place of that one."""
    low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
    some = np.flatnonzero(high > low)
    low, many = low[some], (high - low)[some]
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return owner[np.repeat(low, many) + offset], np.repeat(place[some], many)


class Index:
    """Items of one part, their grams and their LSH buckets."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float, recall: float, seed: int = 17):
        self.names = [name for name, _ in items]
        self.vocabulary = _Known()
        self.items = []
        for _, words in items:
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.sizes = sorted({len(i) for i in self.items})
        self.edits = {n: allowed_edits(n, similarity) for n in self.sizes}
        self.grams = {n: _gram_size(n, self.edits[n]) for n in self.sizes}
        self.gap = max(self.edits.values(), default=0) + 1
        self.slot = {n: np.uint64(1 << (i % 64)) for i, n in enumerate(self.sizes)}
        #: for each gram length the sorted codes and, as bits, the sizes of the items that have them
        self.codes = {}
        for q in {q for q, _ in self.grams.values()}:
            of = [i for i in self.items if self.grams[len(i)][0] == q]
            codes, back = np.unique(np.concatenate([_gram_codes(i, q) for i in of]), return_inverse=True)
            slots = np.zeros(len(codes), np.uint64)
            np.bitwise_or.at(slots, back, np.concatenate([np.full(len(i) - q + 1, self.slot[len(i)]) for i in of]))
            rough = np.zeros(1 << 20, bool)
            rough[codes >> np.uint64(44)] = True
            self.codes[q] = (codes, slots, rough)
        rng = np.random.default_rng(seed)
        self.share = rng.uniform(0, 1, (MOST_WALKS, SAMPLES_PER_WALK, SAMPLED))
        #: walks for each size; no walk where items are compared without LSH
        self.walks = self._calibrated(recall, rng)
        #: sorted gram codes of the items without walks, and their items, by size
        self.grams_of = {n: self._grams_of(n) for n in self.sizes if not self.walks[n]}
        laid = np.concatenate(self.items)
        sizes = np.array([len(i) for i in self.items])
        order = np.argsort(sizes, kind="stable")
        keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for walk, some, mine in self._walked(laid, (np.cumsum(sizes) - sizes)[order], sizes[order]):
            keys.append(mine.ravel())
            owner.append(np.tile(order[some], SAMPLES_PER_WALK))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def _grams_of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        q = self.grams[n][0]
        owner = [i for i, item in enumerate(self.items) if len(item) == n]
        codes = [np.unique(_gram_codes(self.items[i], q)) for i in owner]
        owner, codes = np.repeat(owner, [len(c) for c in codes]), np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        return codes[order], owner[order]

    def _walked(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(walk, places of windows, their keys) for all walks of the windows' sizes; sizes ascend."""
        walks = np.array([self.walks[n] for n in sizes.tolist()], np.int64)
        at = 0
        while at < len(sizes):
            end = min(len(sizes), at + max(1, CELLS // int(2 * sizes[at])))
            end = min(end, at + max(1, CELLS // int(2 * sizes[end - 1])))
            for walk in range(int(walks[at:end].max())):
                some = at + np.flatnonzero(walks[at:end] > walk)
                yield walk, some, self._keys(ids, starts[some], sizes[some], walk)
            at = end

    def _keys(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
        return _walk_keys(ids, starts, sizes, walk, self.share[walk])

    def _calibrated(self, recall: float, rng: np.random.Generator) -> dict[int, int]:
        """Walks of each size after which nearly all items with as many random edits as allowed share a bucket with the original.

        Of the sizes that allow the same edits the smallest is tried, where these spoil most.  Need grows with length:
        from the first size on that ``MOST_WALKS`` do not reach, items have no walks.
        """
        walks, of, tried = {}, {}, {}
        for item in self.items:
            of.setdefault(len(item), []).append(item)
        for n in self.sizes:
            k = self.edits[n]
            if k not in tried:
                reached = n <= WALKED_WORDS and 0 not in tried.values()
                tried[k] = self._walks_needed(of[n], k, recall, rng) if reached else 0
            walks[n] = tried[k]
        return walks

    def _walks_needed(self, items: list[np.ndarray], k: int, recall: float, rng: np.random.Generator) -> int:
        n, edited = len(items[0]), []
        whole = [items[i] for i in np.resize(rng.permutation(len(items)), TRIALS)]
        for item in whole:
            copy = item.tolist()
            for _ in range(k):
                at, kind = int(rng.integers(0, max(1, len(copy)))), rng.integers(3)
                if kind == 0 and copy:
                    copy[at] = 0
                elif kind == 1:
                    copy.insert(at, 0)
                elif copy:
                    del copy[at]
            edited.append(np.array((copy + [0] * n)[:n], np.int64))
        a, b, left = np.concatenate(whole), np.concatenate(edited), np.arange(TRIALS)
        for walk in range(MOST_WALKS):
            sizes = np.full(len(left), n)
            left = left[~(self._keys(a, left * n, sizes, walk) == self._keys(b, left * n, sizes, walk)).any(axis=0)]
            if len(left) <= (1 - recall) * TRIALS:
                return walk + 1
        return 0

    def _hits(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of the benchmark's grams of each length, the sizes of the items that have them, and their codes."""
        found = {}
        for q, (codes, slots, rough) in self.codes.items():
            code = _gram_codes(ids, q)
            hit = np.flatnonzero(rough[code >> np.uint64(44)] & (code > 0))
            place = np.minimum(np.searchsorted(codes, code[hit]), len(codes) - 1)
            right = codes[place] == code[hit]
            found[q] = (hit[right], slots[place[right]], code[hit[right]])
        return found

    def _close(self, n: int, hits: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of size ``n``, their codes, and at which hits so many begin within the reach of a passage as it must have."""
        q, need = self.grams[n]
        hit, slots, code = hits[q]
        mine = (slots & self.slot[n]) > 0
        hit = hit[mine]
        near = np.flatnonzero(hit[need - 1 :] - hit[: max(0, len(hit) - need + 1)] <= n + self.edits[n] - q) if len(hit) >= need else np.zeros(0, np.int64)
        return hit, code[mine], near

    def _windows(self, ids: np.ndarray, hits: dict) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the windows to embed.

        A window is embedded only if so many grams of items of its size lie in its reach as any passage within the
        allowed edits must have, and if it starts no farther before any of them than edits can spoil, be that amid
        grams of other items or not; this loses none.
        """
        starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.sizes:
            if not self.walks[n]:
                continue
            k, (q, need) = self.edits[n], self.grams[n]
            hit, _, close = self._close(n, hits)
            reach = n + k - q
            if not len(close):
                continue
            edge = np.zeros(len(ids) + 1, np.int32)
            np.add.at(edge, np.maximum(0, hit[close + need - 1] - reach), 1)
            np.add.at(edge, hit[close] + 1, -1)
            chosen = np.flatnonzero(np.cumsum(edge) > 0)
            chosen = chosen[hit[np.searchsorted(hit, chosen)] - chosen <= q * k]
            starts.append(chosen)
            sizes.append(np.full(len(chosen), n))
        return np.concatenate(starts), np.concatenate(sizes)

    def _counted(self, n: int, hits: dict) -> Iterator[np.ndarray]:
        """(item, low, high) of all places with as many grams of one item of size ``n`` as any passage must have; loses none."""
        k, (q, need) = self.edits[n], self.grams[n]
        hit, code, close = self._close(n, hits)
        inside = np.zeros(len(hit) + 1, np.int32)
        np.add.at(inside, close, 1)
        np.add.at(inside, close + need, -1)
        inside = np.cumsum(inside)[:-1] > 0
        hit, code = hit[inside], code[inside]
        codes, owner = self.grams_of[n]
        pairs = (np.searchsorted(codes, code, side="right") - np.searchsorted(codes, code)).sum()
        groups = -(-int(pairs) // CELLS)
        for group in range(groups):
            mine = owner % groups == group
            item, at = _pairs(codes[mine], owner[mine], code, hit)
            order = np.lexsort((at, item))
            item, at = item[order], at[order]
            many = max(0, len(at) - need + 1)
            first = np.flatnonzero((item[need - 1 :] == item[:many]) & (at[need - 1 :] - at[:many] <= n + k - q)) if many else order[:0]
            yield np.column_stack([item[first], at[first + need - 1] - (n + k - q), at[first] + n + k])

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high) of places where a passage of an item may lie, by item and place.

        For sizes with walks they are around windows that share a bucket with the item.
        """
        hits = self._hits(ids)
        starts, sizes = self._windows(ids, hits)
        seen: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for _, some, mine in self._walked(ids, starts, sizes):
            item, window = _pairs(self.keys, self.owner, mine.ravel(), np.tile(some, len(mine)))
            n = sizes[window]
            k = np.array([self.edits[i] for i in n.tolist()], np.int64)
            seen.append(np.column_stack([item, starts[window] - k, starts[window] + n + k]))
        for n in self.grams_of:
            seen += self._counted(n, hits)
        return [tuple(c) for c in np.unique(np.concatenate(seen), axis=0).tolist()]

    def matches(self, ids: np.ndarray, begins: list[int], ends: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of verified passages; overlapping ones of an item in one text as the best of them.

        Texts lie in ``ids`` from ``begins`` to ``ends``; a candidate region is cut at the ends of the texts it touches.
        """
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for item, first, last in self.candidates(ids):
            n = len(self.items[item])
            text = bisect_right(ends, first)
            while text < len(begins) and begins[text] < last:
                low, high = max(begins[text], first), min(ends[text], last)
                if high - low >= n - self.edits[n]:
                    kept = regions.setdefault((text, item), [])
                    if kept and low <= kept[-1][1] and high - kept[-1][0] <= 4 * n + 4:
                        kept[-1][1] = max(high, kept[-1][1])
                    else:
                        kept.append([low, high])
                text += 1
        out = []
        for (text, item), spans in regions.items():
            words = self.items[item]
            for low, high in spans:
                edits, end = _least_edits(words, ids[low:high])
                if edits <= self.edits[len(words)]:
                    back, length = _least_edits(words[::-1], ids[low : low + end][::-1], anchored=True)
                    out.append((text, item, edits, low + end - length, low + end))
        return out


def _least_edits(words: np.ndarray, region: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits between ``words`` and a passage of ``region``, and where that ends first.

    ``anchored`` passages begin at the start of the region.
    """
    along = np.arange(len(region) + 1)
    row = along.copy() if anchored else np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(words):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (region != word))
        step[0] = i + 1
        row = np.minimum.accumulate(step - along) + along
    end = int(row.argmin())
    return int(row[end]), end


def leaks(text: Column, items: DataFrame, key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
          recall: float = RECALL, part_items: int = PART_ITEMS) -> Column:
    """Array of ``struct(item, edits, words, start, end)``: benchmark items of which a whole text holds a passage.

    Words are lower-cased runs of letters and digits.  A passage counts if its word edit distance to the item is
    at most a share ``1 - similarity`` of the item's words.  ``start`` and ``end`` are word positions of
    the best passage (fewest edits, then first).  Items without a word and null items are never found; null
    and empty texts hold nothing; rows that repeat get the same result.  The benchmark goes to the tasks in parts of
    bounded size, each with all of its buckets; a benchmark of any size is searched in full.
    """
    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(item_text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL")
    parts = max(1, -(-rows.count() // part_items))
    found = []
    for part in range(parts):
        chosen = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == part).distinct().collect()
        named = sorted((r.k, words_of(r.t)) for r in chosen)
        named = [(k, w) for k, w in named if w]
        if named:
            found.append(_search(text, Index(named, similarity, recall)))
    empty = F.array().cast("array<struct<item:bigint,edits:int,words:int,start:int,end:int>>")
    return F.concat(*found, empty) if found else empty


def _search(text: Column, index: Index) -> Column:
    def run(texts: list) -> list:
        get = index.vocabulary.__getitem__
        each = [np.fromiter(map(get, w), np.int64, len(w)) for w in map(words_of, texts)]
        # texts are laid out with more unknown words between them than edits are allowed
        begins = np.cumsum([0] + [len(w) + index.gap for w in each]).tolist()
        ends = [b + len(w) for b, w in zip(begins, each)]
        laid = np.zeros(begins.pop() + 1, np.int64)
        for b, e, w in zip(begins, ends, each):
            laid[b:e] = w
        best: list[dict] = [{} for _ in texts]
        for row, item, edits, start, end in index.matches(laid, begins, ends):
            here = (edits, start - begins[row], end - begins[row])
            best[row][item] = min(best[row].get(item, here), here)
        return [([{"item": index.names[i], "edits": e, "words": len(index.items[i]), "start": s, "end": t}
                  for i, (e, s, t) in sorted(found.items())],) for found in best]

    return per_text("found array<struct<item:bigint,edits:int,words:int,start:int,end:int>>", run, text, rows=TEXT_ROWS, chars=1 << 22).found


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it holds."""
    found = leaks(F.col("text"), table(spark, sf_dir, "benchmark"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("m")).select(
        "doc_id", F.col("m.item").alias("item_id"), F.col("m.edits").alias("edits"),
        (1 - F.col("m.edits") / F.col("m.words")).alias("similarity"), F.col("m.start").alias("start_word"), F.col("m.end").alias("end_word"))
