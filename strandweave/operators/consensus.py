"""Consensus of noisy sequences of one place, by alignment to a draft and votes, in bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.skew import join_unique
from strandweave.session import settled, ship

#: Distinct sequences of a group, on average.
FAN = 48
_MATCH, _MISMATCH, _GAP, _OVER = 2, -2, -6, -3
#: Rounds of votes at most, and steps of alignments that are held at once.
_ROUNDS, _CELLS = 8, 1 << 24
#: Letters of the groups that a task takes together.
_LETTERS = 1 << 20


def _aligned(drafts: np.ndarray, texts: np.ndarray, long: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text's letters the letter of its draft that each stands at, or -1, as a row, and the score; drafts and texts are columns.

    All begin at one place; a draft that goes on costs nothing, a text that
    hangs over a little more than letters that differ. Cells of a diagonal are
    free of each other, so all pairs take one diagonal after another.
    """
    (rows, n), m = drafts.shape, len(texts)
    kind = np.int16 if -_GAP * (rows + m) < 30_000 else np.int32
    back = texts[::-1]
    before, last, step = np.zeros((rows + 1, n), kind), np.zeros((rows + 1, n), kind), np.zeros((rows + m + 1, rows + 1, n), np.uint8)
    last[:2] = _GAP
    low = np.iinfo(kind).min
    # the best end at the last letter of the text, and that of a text that hangs over
    top, where = np.full(n, low, np.int32), np.zeros(n, np.int64)
    over, hung = (long * _GAP + size * _OVER).astype(np.int32), np.zeros(n, np.int64)
    for d in range(1, rows + m + 1):
        if d > 1:
            now = np.empty((rows + 1, n), kind)
            a, b = max(1, d - m), min(rows, d - 1)
            now[0], now[min(d, rows)] = d * _GAP, d * _GAP
            straight = np.multiply((drafts[a - 1 : b] == back[m - d + a : m - d + b + 1]).view(np.int8), kind(_MATCH - _MISMATCH), dtype=kind)
            straight += before[a - 1 : b]
            straight += kind(_MISMATCH)
            best = now[a : b + 1]
            np.maximum(last[a - 1 : b], last[a : b + 1], out=best)
            best += kind(_GAP)
            np.maximum(best, straight, out=best)
            # 1 if not straight, 2 if the draft's letter isn't left out either
            gap = (best != straight).view(np.uint8)
            np.add(gap, gap & (best != last[a - 1 : b] + kind(_GAP)).view(np.uint8), out=step[d, a : b + 1])
            before, last = last, now
        i = d - size
        k = np.flatnonzero((i >= 1) & (i <= long))
        k = k[last[i[k], k] > top[k]]
        top[k], where[k] = last[i[k], k], i[k]
        j = d - long
        k = np.flatnonzero((j >= 0) & (j <= size))
        value = last[long[k], k] + _OVER * (size[k] - j[k])
        k, value = k[value > over[k]], value[value > over[k]]
        over[k], hung[k] = value, j[k]
    i, j = np.where(over > top, long, where), np.where(over > top, hung, size)
    # where no gap is as good as the best, none is taken
    same = (drafts[: min(rows, m)] == texts[: min(rows, m)]).sum(axis=0)
    plain = (i == size) & (j == size) & ((_MATCH - _MISMATCH) * same + _MISMATCH * size == np.maximum(top, over))
    out = np.where(plain[:, None] & (np.arange(m) < size[:, None]), np.arange(m), -1).astype(np.int32)
    at = np.flatnonzero(~plain)
    while len(at):
        at = at[(i[at] > 0) & (j[at] > 0)]
        came = step[i[at] + j[at], i[at], at]
        met = at[came == 0]
        out[met, j[met] - 1] = i[met] - 1
        i[at] -= came != 2
        j[at] -= came != 1
    return out, np.maximum(top, over)


def _columns(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((max(map(len, rows)), len(rows)), fill, np.uint32)
    for k, row in enumerate(rows):
        out[: len(row), k] = row
    return out


def _voted(draft: np.ndarray, texts: list[np.ndarray], weights: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The draft that aligned texts vote for, and the weight of the letters at each letter of the one given.

    No letter is a vote too, of those that go on: a letter of the draft stays
    unless more leave it out than have the best one, and one is put in if more
    have it than pass without; at the end, if ``least`` go on. Of equal votes
    the draft's own letter counts, then the smaller one.
    """
    n = len(draft)
    letters, own = np.unique(np.concatenate([draft, *texts]), return_inverse=True)
    own, text = own[:n], own[n:]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    place = np.concatenate([a[: len(t)] for a, t in zip(at, texts, strict=True)]).astype(np.int64)
    weight, met = weights[owner], place >= 0
    votes = np.bincount(place[met] * len(letters) + text[met], weight[met], n * len(letters)).reshape(n, len(letters))
    reach = at.max(axis=1) + 1  # letters of the draft up to the last that each meets
    spans = np.cumsum(np.bincount(reach, weights, n + 1)[::-1])[::-1]  # weight of those that reach so far
    held = votes.sum(axis=1)
    votes[np.arange(n), own] += 0.5
    best, kept = votes.argmax(axis=1), votes.max(axis=1) >= spans[1:] - held
    put: dict[tuple[int, int], dict[int, float]] = {}
    if not met.all():
        inside = np.flatnonzero(~met)
        slot = np.maximum.accumulate(np.where(met, place + 1, 0) + owner * (n + 1)) - owner * (n + 1)
        for k in inside.tolist():
            s = int(slot[k])
            if s == n or s < reach[owner[k]]:
                nth = k - int(np.searchsorted(owner, owner[k])) if s == 0 else 0
                while s and not met[k - nth - 1]:
                    nth += 1
                one = put.setdefault((s, nth), {})
                one[int(text[k])] = one.get(int(text[k]), 0) + float(weight[k])
    more: dict[int, list[int]] = {}
    for (s, nth), one in sorted(put.items()):
        total = sum(one.values())
        letter = max(one, key=lambda x: (one[x], -x))
        if (total >= least if s == n else one[letter] > spans[s + 1] - total) and nth == len(more.get(s, [])):
            more.setdefault(s, []).append(letter)
    if kept.all() and not more:
        return letters[best], held
    made: list[int] = []
    for i in range(n + 1):
        made += more.get(i, [])
        if i < n and kept[i]:
            made.append(int(best[i]))
    return letters[np.array(made, np.int64)], held


def _stacked(texts: list[np.ndarray], weights: np.ndarray, least: int) -> np.ndarray:
    """The letters that the texts vote for at each place from the begin, as far as ``least`` reach."""
    letters, own = np.unique(np.concatenate(texts), return_inverse=True)
    size = np.array([len(t) for t in texts])
    place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    n = int(size.max())
    votes = np.bincount(place * len(letters) + own, np.repeat(weights, size), n * len(letters)).reshape(n, len(letters))
    return letters[votes.argmax(axis=1)[votes.sum(axis=1) >= least]]


def consensuses(groups: list[tuple[list[str], list[int]]]) -> list[str]:
    """The consensus of each group of weighted sequences; of fewer than three, the longest.

    The heaviest sequence (then the longest, then by letters) and the letters
    that most have at each place, without gaps, are the first drafts; that to
    which all align better counts. All vote, letter by letter, for the next
    draft, until it stays as it is; so the result doesn't depend on the order
    given, and a few that align elsewhere in a run of equal letters change
    nothing. Ends that fewer than a quarter reach are cut. Pairs of all groups
    are aligned together, a bounded number of cells at once.
    """
    out, open_ = [""] * len(groups), []
    for g, (seqs, weights) in enumerate(groups):
        order = sorted(zip(seqs, weights, strict=True), key=lambda s: (-s[1], -len(s[0]), s[0]))
        if sum(weights) < 3 or len(order) == 1:
            out[g] = max(order, key=lambda s: (len(s[0]), s[1], s[0]))[0]
        else:
            codes, weight = [_codes(s) for s, _ in order], np.array([w for _, w in order], np.int64)
            drafts = [d for d in (codes[0], _stacked(codes, weight, _least(weight))) if len(d)]
            open_.append((g, drafts, codes, weight))
    for left in range(_ROUNDS - 1, -1, -1):
        going = []
        for block in _blocks(open_):
            pairs = [(d, t) for _, drafts, texts, _ in block for d in drafts for t in texts]
            longest = max(len(x) for pair in pairs for x in pair) + 1
            at, score = np.full((len(pairs), longest), -1, np.int32), np.empty(len(pairs), np.int64)
            # a group of long sequences takes more than one turn
            turn = max(1, _CELLS // (2 * longest * longest))
            for k in range(0, len(pairs), turn):
                some = pairs[k : k + turn]
                found, score[k : k + turn] = _aligned(_columns([d for d, _ in some], 0), _columns([t for _, t in some], 1 << 31), *np.array([[len(d), len(t)] for d, t in some]).T)
                at[k : k + turn, : found.shape[1]] = found
            begin = 0
            for g, drafts, texts, weights in block:
                parts = [slice(begin + k * len(texts), begin + (k + 1) * len(texts)) for k in range(len(drafts))]
                begin = parts[-1].stop
                k = max(range(len(drafts)), key=lambda k: (int(score[parts[k]] @ weights), k))
                draft = drafts[k]
                made, held = _voted(draft, texts, weights, at[parts[k]], _least(weights))
                if left and len(made) and not np.array_equal(made, draft):
                    going.append((g, [made], texts, weights))
                    continue
                heavy = np.flatnonzero(held >= _least(weights))
                chosen = draft[heavy[0] : heavy[-1] + 1] if len(heavy) else texts[0]
                out[g] = chosen.tobytes().decode("utf-32-le", "surrogatepass")
        open_ = going
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least(weights: np.ndarray) -> int:
    return max(2, int(weights.sum()) // 4)


def _blocks(groups: list[tuple]) -> Iterator[list[tuple]]:
    """Groups of like lengths together, as many as keep the cells of their alignments bounded."""
    size = lambda g: max(len(x) for x in (*g[1], *g[2]))
    block: list[tuple] = []
    pairs = 0
    for g in sorted(groups, key=size):
        n, more = size(g) + 1, len(g[1]) * len(g[2])
        if block and (pairs + more) * 2 * n * n > _CELLS:
            yield block
            block, pairs = [], 0
        block.append(g)
        pairs += more
    if block:
        yield block


def consensus(seqs: list[str], weights: list[int]) -> str:
    """The consensus of one group; see :func:`consensuses`."""
    return consensuses([(seqs, weights)])[0]


def assembled(rows: DataFrame, key: str, seq: str = "seq", fan: int = FAN) -> DataFrame:
    """(key, seq): the consensus of each key's sequences, which begin at one place.

    Equal sequences are counted first. The rest is dealt by hash to groups of
    about ``fan``, each becomes one sequence with the weight of its members,
    and these are dealt again until a key has one; so a task holds no more than
    a few hundred groups at once, however many sequences a key has. Null and
    empty sequences are left out, and a key without others too.
    """
    ship(rows.sparkSession)
    kind, number = rows.schema[key].dataType.simpleString(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        groups: list[tuple[list[str], list[int]]] = []
        place, letters, typed = None, 0, None

        def told() -> pa.RecordBatch:
            columns = [pa.array(keys, typed), pa.array(consensuses(groups), pa.string()), pa.array([sum(w) for _, w in groups], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[key, "seq", "weight"])

        for rb in it:
            typed = rb.column(0).type
            for k, part, text, weight in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if not groups or place != (k, part):
                    if letters > _LETTERS:
                        yield told()
                        keys, groups, letters = [], [], 0
                    place = (k, part)
                    keys.append(k)
                    groups.append(([], []))
                groups[-1][0].append(text)
                groups[-1][1].append(weight)
                letters += len(text)
        if groups:
            yield told()

    now = rows.where(F.length(seq) > 0).groupBy(key, F.col(seq).alias("seq")).agg(F.count("*").alias("weight"))
    while True:
        now = settled(now)
        sizes = settled(now.groupBy(key).agg(F.count("*").alias("__n")))
        most = sizes.agg(F.max("__n")).first()[0] or 0
        if most <= 1:
            return now.select(key, "seq")
        dealt = join_unique(now, sizes, [key], "__n", now.count()).withColumn("__part", F.pmod(F.xxhash64("seq"), F.ceil(F.col("__n") / fan)).cast("int"))
        # by number: few bytes are much work, so adaptive execution must not put these partitions together
        dealt = dealt.select(key, "__part", "seq", "weight").repartition(number, key, "__part").sortWithinPartitions(key, "__part")
        now = dealt.mapInArrow(made, f"`{key}` {kind}, seq string, weight long")
