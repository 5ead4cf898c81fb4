"""Merge training over the distinct words of a corpus.

Counting words is distributed; choosing merges is one decision after another. While the
distinct words fit one task (a documented parameter) the loop runs there over flat arrays,
and a merge visits only the places of its pair and changes the counts beside them.
Larger tables stay distributed, with one aggregate and one rewrite for each merge.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise
from threadloom.subword import words as W

#: Letters of the distinct words, a mark for each included, up to which the merge loop runs in one task.
TASK_LETTERS = 40_000_000
#: Merges between two lineage cuts of the distributed loop.
CUT_EVERY = 10


class _Corpus:
    """The symbols of all words in flat arrays, the counts of their pairs and where each pair stands.

    A symbol lies at its first place; its width stands at its first and last place, so both
    neighbours are found without links. The places of a pair only grow while it lives;
    those that no longer hold it are skipped. Long lists of places are merged by array
    operations, short ones one by one.
    """

    #: Places of a pair from which array operations are faster.
    MANY = 48
    #: Places indexed at once when the index is built.
    STRETCH = 1 << 21

    def __init__(self, words: list[str] | pa.Array, freqs: list[int] | np.ndarray, kind: str) -> None:
        words = pa.array(words, pa.large_string()) if isinstance(words, list) else words
        self.kind = kind
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        marks = ends - 1 if kind == "bpe" else ends - sizes
        total = int(ends[-1]) if len(ends) else 0
        codes = np.frombuffer(_joined(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.zeros(0x110000, np.int32)
        number[codes] = 1
        alphabet = np.flatnonzero(number)
        number[alphabet] = np.arange(len(alphabet))
        self.names = [*map(chr, alphabet.tolist()), W.BPE_END if kind == "bpe" else W.PIECE_START]
        self.number = {name: k for k, name in enumerate(self.names)}
        letters = np.ones(total + 1, bool)
        letters[marks] = letters[total] = False
        self.symbol = np.full(total + 1, len(alphabet), np.int32)
        self.symbol[letters] = number[codes]
        self.symbol[total] = -1
        del codes, letters
        self.word = np.repeat(np.arange(len(sizes) + 1, dtype=np.int32), np.r_[sizes, 1])
        self.freq = np.r_[np.asarray(freqs, np.int64), 0]
        self.width = np.ones(total + 1, np.uint16 if not len(sizes) or sizes.max() < 1 << 16 else np.uint32)
        single = np.zeros(len(self.names))
        self.count: dict[int, int] = {}
        self.places: dict[int, array] = {}
        for k in range(0, total, self.STRETCH):
            i = np.arange(k, min(k + self.STRETCH, total), dtype=np.int32)
            single += np.bincount(self.symbol[i], self.freq[self.word[i]], len(self.names))
            i = i[self.word[i] == self.word[i + 1]]
            pairs, sums, places, cuts = self._grouped(self.symbol[i], self.symbol[i + 1], self.freq[self.word[i]], i)
            for x, pair in enumerate(pairs):
                self.count[pair] = self.count.get(pair, 0) + sums[x]
                self.places.setdefault(pair, array("i")).frombytes(places[cuts[x] : cuts[x + 1]].tobytes())
        self.single: list[int] = [int(n) for n in single]
        self.queue: _ByCount | _ByScore = (_ByCount if kind == "bpe" else _ByScore)(self)
        self.queue.update(self.count, ())

    @staticmethod
    def _grouped(left: np.ndarray, right: np.ndarray, n: np.ndarray, places: np.ndarray) -> tuple[list[int], list[int], np.ndarray, list[int]]:
        """Pairs, their sums of ``n``, the places by pair in rising order and where each pair's begin."""
        if not len(left):
            return [], [], places, [0]
        keys = left.astype(np.int64) << 32 | right
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate((_TRUE, keys[1:] != keys[:-1])))
        return keys[starts].tolist(), np.add.reduceat(n[order], starts).tolist(), places[order], [*starts.tolist(), len(keys)]

    def best(self) -> tuple[str, str] | None:
        """The pair with the best score; of ties the smallest in code point order."""
        pair = self.queue.best()
        return None if pair is None else (self.names[pair >> 32], self.names[pair & _RIGHT])

    def merge(self, pair: tuple[str, str]) -> None:
        """Replace the pair from left to right; occurrences do not overlap.

        Between two neighbouring occurrences the second changes the pair that joins them.
        """
        a, b = self.number[pair[0]], self.number[pair[1]]
        name = pair[0] + pair[1]
        new = self.number.setdefault(name, len(self.names))
        if new == len(self.names):
            self.names.append(name)
            self.single.append(0)
        key = a << 32 | b
        at = self.places.pop(key)
        delta: dict[int, int] = {}
        merged = (self._many if len(at) >= self.MANY else self._few)(at, a, b, new, delta)
        delta.pop(key, None)
        del self.count[key]
        self.single[a] -= merged
        self.single[b] -= merged
        self.single[new] += merged
        for p, n in delta.items():
            if left := self.count.get(p, 0) + n:
                self.count[p] = left
            elif p in self.count:
                del self.count[p], self.places[p]
        delta[key] = 0
        self.queue.update(delta, (a, b, new))

    def _few(self, at: array, a: int, b: int, new: int, delta: dict[int, int]) -> int:
        symbol, width, word, freq = (memoryview(x) for x in (self.symbol, self.width, self.word, self.freq))
        places, merged = self.places, 0
        from_a, from_b, from_new = a, b << 32, new << 32
        for i in sorted(at) if a == b else at:
            if symbol[i] != a:
                continue
            j = i + width[i]
            if symbol[j] != b or word[j] != (k := word[i]):
                continue
            n = freq[k]
            q = j + width[j]
            if i and word[i - 1] == k:
                p = i - width[i - 1]
                s = symbol[p] << 32
                delta[s | from_a] = delta.get(s | from_a, 0) - n
                s |= new
                delta[s] = delta.get(s, 0) + n
                if s in places:
                    places[s].append(p)
                else:
                    places[s] = array("i", (p,))
            if word[q] == k:
                t = symbol[q]
                delta[from_b | t] = delta.get(from_b | t, 0) - n
                t |= from_new
                delta[t] = delta.get(t, 0) + n
                if t in places:
                    places[t].append(i)
                else:
                    places[t] = array("i", (i,))
            symbol[i], symbol[j] = new, -1
            width[i] = width[q - 1] = q - i
            merged += n
        for p in delta:
            if p in places and p not in self.count and not delta[p]:
                del places[p]
        return merged

    def _many(self, at: array, a: int, b: int, new: int, delta: dict[int, int]) -> int:
        symbol, width, word = self.symbol, self.width, self.word
        i = np.sort(np.frombuffer(at, np.int32))
        held = symbol[i] == a
        held[1:] &= i[1:] != i[:-1]
        i = i[held]
        j = i + width[i]
        held = (symbol[j] == b) & (word[j] == word[i])
        i, j = i[held], j[held]
        if a == b and len(i):  # of a run every second place
            nth = np.arange(len(i))
            start = np.concatenate((_TRUE, i[1:] != j[:-1]))
            held = (nth - np.maximum.accumulate(np.where(start, nth, 0))) % 2 == 0
            i, j = i[held], j[held]
        if not len(i):
            return 0
        k = word[i]
        n, q = self.freq[k], j + width[j]
        followed = word[q] == k
        joined = np.concatenate((i[1:] == q[:-1], _FALSE)) & followed  # another occurrence follows
        after = np.concatenate((_FALSE, joined[:-1]))
        before = (i > 0) & (word[i - 1] == k)
        p = np.where(before, i - width[i - 1], 0)
        s, t = symbol[p], symbol[q]
        alone = followed & ~joined
        b_alone, new_alone = (np.full(np.count_nonzero(alone), x, np.int32) for x in (b, new))
        a_before, new_before = (np.full(np.count_nonzero(before), x, np.int32) for x in (a, new))
        right = t[alone]
        counts = np.concatenate((n[before], n[alone]))
        pairs, sums, _, _ = self._grouped(np.concatenate((s[before], b_alone)), np.concatenate((a_before, right)), counts, counts)
        delta.update(zip(pairs, (-x for x in sums), strict=True))
        previous = np.concatenate((i[:1], i[:-1]))
        made_left, made_right = np.concatenate((np.where(after, new, s)[before], new_alone)), np.concatenate((new_before, right))
        at_left = np.where(after, previous, p)[before]
        pairs, sums, where, cuts = self._grouped(made_left, made_right, counts, np.concatenate((at_left, i[alone])).astype(np.int32, copy=False))
        symbol[i], symbol[j] = new, -1
        width[i] = width[q - 1] = q - i
        for x, pair in enumerate(pairs):
            delta[pair] = delta.get(pair, 0) + sums[x]
            self.places.setdefault(pair, array("i")).frombytes(where[cuts[x] : cuts[x + 1]].tobytes())
        return int(n.sum())


_RIGHT = (1 << 32) - 1
_TRUE, _FALSE = np.array([True]), np.array([False])


class _ByCount:
    """Pairs by count, in buckets; only the bucket in use is ordered by the names.

    A pair whose count fell is moved when its bucket comes up; one whose count grew gets a
    second entry, and the entry that is no longer true is dropped.
    """

    def __init__(self, corpus: _Corpus) -> None:
        self.count, self.names = corpus.count, corpus.names
        self.buckets: dict[int, array] = {}
        self.levels: list[int] = []
        self.level = 0
        self.heap: list[tuple[str, str, int]] = []

    def _put(self, pair: int, n: int) -> None:
        if n == self.level:
            heapq.heappush(self.heap, (self.names[pair >> 32], self.names[pair & _RIGHT], pair))
        elif n in self.buckets:
            self.buckets[n].append(pair)
        else:
            self.buckets[n] = array("q", (pair,))
            heapq.heappush(self.levels, -n)

    def update(self, delta: dict[int, int], symbols: tuple[int, ...]) -> None:
        for pair, n in delta.items():
            if n > 0:
                self._put(pair, self.count[pair])

    def best(self) -> int | None:
        while True:
            if self.levels and -self.levels[0] > self.level:
                old, level, self.heap, self.level = self.heap, self.level, [], -heapq.heappop(self.levels)
                for _, _, pair in old:
                    self._put(pair, level)
                for pair in set(self.buckets.pop(self.level)):
                    if 0 < (n := self.count.get(pair, 0)) <= self.level:
                        if n == self.level:
                            self.heap.append((self.names[pair >> 32], self.names[pair & _RIGHT], pair))
                        else:
                            self._put(pair, n)
                heapq.heapify(self.heap)
            elif self.heap:
                pair = self.heap[0][2]
                n = self.count.get(pair, 0)
                if n == self.level:
                    return pair
                heapq.heappop(self.heap)
                if 0 < n < self.level:
                    self._put(pair, n)
            elif self.levels:
                self.level = 0
            else:
                return None


class _ByScore:
    """Pairs by count over the product of the counts of both symbols.

    A pair lies with that of its symbols that was the more frequent when it was made, in a
    heap by count over the count of the other one, so the order stays when the first one's
    count changes. A heap over the first pairs of all symbols gives the best one. The order
    is that of upper bounds: a count that fell is put right when the pair comes up, and the
    other symbol's count is replaced by a lower bound, so that a frequent symbol's pairs are
    not entered again for each merge; a bound that comes up first is set to the count.
    """

    #: The lower bound of a count is this share below it, so exact for smaller counts.
    SLACK = 8

    def __init__(self, corpus: _Corpus) -> None:
        self.count, self.names, self.single = corpus.count, corpus.names, corpus.single
        self.low = list(corpus.single)
        self.entered: dict[int, tuple[float, str, str, int, int]] = {}
        self.of: dict[int, set[int]] = {}
        self.heaps: dict[int, list[tuple[float, str, str, int, int]]] = {}
        self.most: dict[int, int] = {}
        self.first: dict[int, tuple[float, int]] = {}
        self.heap: list[tuple[float, str, str, int, int]] = []

    def update(self, delta: dict[int, int], symbols: tuple[int, ...]) -> None:
        count, names, single, low, entered, of, heaps = self.count, self.names, self.single, self.low, self.entered, self.of, self.heaps
        risen = set()
        for pair, n in delta.items():
            if n > 0:
                risen.add(pair)
            elif pair not in count and (old := entered.pop(pair, None)):
                (mates := of[old[4]]).discard(pair)
                if not mates:
                    del of[old[4]]
        for s in symbols:
            if s == len(low):
                low.append(single[s])
            elif single[s] < low[s]:
                low[s] = single[s] - single[s] // self.SLACK
                risen |= of.get(s, _NONE)
        touched = set(symbols)
        for pair in risen:
            left, right = pair >> 32, pair & _RIGHT
            if old := entered.get(pair):
                small = old[4]
            else:
                small = left if single[left] < single[right] else right
                if small in of:
                    of[small].add(pair)
                else:
                    of[small] = {pair}
            key = -count[pair] / low[small]
            if old and old[0] == key:
                continue
            entered[pair] = entry = (key, names[left], names[right], pair, small)
            owner = right if small == left else left
            if owner in heaps:
                heap = heaps[owner]
                heapq.heappush(heap, entry)
                if heap[0] is entry:
                    touched.add(owner)
            else:
                heaps[owner] = [entry]
                touched.add(owner)
        for owner in touched:
            self._refresh(owner)

    def _refresh(self, owner: int) -> None:
        heap, entered = self.heaps.get(owner), self.entered
        if not heap:
            return
        if len(heap) > self.most.get(owner, 64):
            heap = self.heaps[owner] = [e for e in heap if entered.get(e[3]) is e]
            heapq.heapify(heap)
            self.most[owner] = 64 + 3 * len(heap)
        while heap:
            entry = key, left, right, pair, small = heap[0]
            if entered.get(pair) is not entry:
                heapq.heappop(heap)
                continue
            now = -self.count[pair] / self.low[small]
            if now == key:
                score = self.count[pair] / (float(self.low[small]) * float(self.single[owner]))
                if self.first.get(owner) != (score, pair):
                    self.first[owner] = score, pair
                    heapq.heappush(self.heap, (-score, left, right, pair, owner))
                return
            entered[pair] = entry = now, left, right, pair, small
            heapq.heapreplace(heap, entry)
        del self.heaps[owner]
        self.first.pop(owner, None)
        self.most.pop(owner, None)

    def best(self) -> int | None:
        while self.heap:
            score, _, _, pair, owner = self.heap[0]
            if self.first.get(owner) != (-score, pair):
                heapq.heappop(self.heap)
                continue
            if entry := self.entered.get(pair):
                self.low[entry[4]] = self.single[entry[4]]
            self._refresh(owner)
            if self.first.get(owner) == (-score, pair):
                return pair
        return None


_NONE: frozenset[int] = frozenset()


def _joined(words: pa.Array) -> str:
    """All words as one text, without a Python object for each."""
    if not len(words):
        return ""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return str(memoryview(data)[offsets[0] : offsets[-1]], "utf-8") if data is not None else ""


def _in_one_task(words: DataFrame, budget: int, kind: str) -> list[tuple[str, str]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [(b["word"].cast(pa.large_string()), b["freq"].to_numpy()) for b in batches if len(b)]
        if not chunks:
            return
        corpus = _Corpus(pa.concat_arrays([w for w, _ in chunks]), np.concatenate([n for _, n in chunks]), kind)
        del chunks
        merges: list[tuple[str, str]] = []
        while len(merges) < budget and (pair := corpus.best()) is not None:
            corpus.merge(pair)
            merges.append(pair)
        for k in range(0, len(merges), 1 << 16):
            part = merges[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part)), pa.int32()), pa.array([a for a, _ in part]), pa.array([b for _, b in part])], names=["rank", "l", "r"])

    found = words.select("word", "freq").repartition(1).mapInArrow(run, "rank int, l string, r string").toArrow().sort_by("rank")
    return list(zip(found["l"].to_pylist(), found["r"].to_pylist(), strict=True))


def _merged(symbols, left: str, right: str):
    """The array with every adjacent (left, right) joined, from left to right."""
    empty = F.array().cast("array<string>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    join = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.lit(left), F.lit(right))))
    step = lambda acc, s: F.when((s == right) & (F.coalesce(last(acc), F.lit("")) == left), join(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(symbols, empty, step)


def _distributed(words: DataFrame, budget: int, kind: str) -> list[tuple[str, str]]:
    symbols = W.bpe_symbols if kind == "bpe" else W.piece_symbols
    state = materialise(words.select(symbols(F.col("word")).alias("word"), "freq"))
    same = lambda c: c
    merges: list[tuple[str, str]] = []
    while len(merges) < budget:
        scored = W.pair_counts(state, same)
        if kind == "piece":
            single = W.symbol_counts(state, same)
            scored = scored.join(single.select(F.col("symbol").alias("l"), F.col("n").alias("n_l")), "l").join(single.select(F.col("symbol").alias("r"), F.col("n").alias("n_r")), "r")
            scored = scored.select("l", "r", (F.col("n") / (F.col("n_l") * F.col("n_r")).cast("double")).alias("score"))
        best = W.best_pair(scored, "n" if kind == "bpe" else "score").first()
        if best is None:
            break
        merges.append((best["l"], best["r"]))
        state = state.withColumn("word", _merged(F.col("word"), best["l"], best["r"]))
        if len(merges) % CUT_EVERY == 0:
            state = materialise(state)
    return merges


def train_merges(words: DataFrame, merges: float = 0.35, kind: str = "bpe", driver_words: int | None = None) -> list[tuple[str, str]]:
    """Merges in order over (word, freq): `bpe` by count, `piece` by count over the product of singles.

    Ties go to the smallest pair in code point order. Training stops early when no pair is
    left. There is no least frequency. Both loops give the same merges; ``driver_words`` is
    the number of distinct words up to which the loop stays in one task, without it
    `TASK_LETTERS` decides.
    """
    budget = W.merge_budget(words, merges)
    words = words.where("word IS NOT NULL")
    n, letters = words.agg(F.count("word"), F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()
    small = letters <= TASK_LETTERS if driver_words is None else n <= driver_words
    return (_in_one_task if small else _distributed)(words, budget, kind)
