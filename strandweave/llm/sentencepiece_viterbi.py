"""SentencePiece encoding and decoding by a streaming Viterbi search.

Every boundary keeps one surviving path. Boundaries further back than the
longest piece can't start a piece any more, so only a window of that width is
live; as soon as the back pointers of the whole window meet in one boundary,
the ids up to it are final and are committed.

Two kinds of model: ``unigram`` keeps the path with the largest sum of piece
scores; ``merges`` (a byte-pair model) keeps, at each boundary, the one path
whose neighbouring pieces the merge order would leave side by side. A sequence
is what merging gives exactly if every neighbouring pair of it is, so this is
the library's own segmentation.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandweave.llm.common import batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Stands for a space within pieces.
GAP = "▁"
_UNITS = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")
#: A memo of unit encodings has two generations of at most so many entries.
MEMO = 250_000


class Pieces:
    """A model's pieces, read on the driver; a vocabulary is of fixed size and travels with the task."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], kind: str):
        self.ids, self.byte_ids, self.kind = ids, byte_ids, kind
        self.longest = max(map(len, ids), default=1)
        self.scores = scores
        self.floor = min(scores.values(), default=0.0) - 10.0
        self.rank = {p: -s for p, s in scores.items() if len(p) > 1} if kind == "merges" else {}
        self.tails = {p[k:] for p in ids for k in range(len(p))}
        self.bridges = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        self._split: dict[str, tuple[str, str]] = {}
        self._side: dict[int, bool] = {}
        self.spelling = {i: piece for piece, i in ids.items()}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a model file on the driver. A model whose scores are whole numbers down from zero is one of merges."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in usual}
        scores = {p: sp.get_score(i) for p, i in ids.items()}
        kind = "merges" if all(float(s).is_integer() and s <= 0 for s in scores.values()) else "unigram"
        return cls(scores, ids, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], kind)

    def __getstate__(self):
        return self.__dict__ | {"_split": {}, "_side": {}}

    def merged(self, text: str) -> list[str]:
        """Merge by rank, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1)))
            if best[0] == np.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge made this one last."""
        found = self._split.get(piece)
        if found is None:
            parts = list(piece)
            while len(parts) > 2:
                i = min((self.rank.get(parts[i] + parts[i + 1], np.inf), i) for i in range(len(parts) - 1))[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self._split[piece] = (parts[0], parts[1])
        return found

    def stay_apart(self, left: int, right: int) -> bool:
        """True if merging the two pieces' text ends with just these two."""
        key = left << 32 | right
        found = self._side.get(key)
        if found is None:
            if len(self._side) > 4 * MEMO:
                self._side.clear()
            found = self._side[key] = self._apart(self.spelling[left], self.spelling[right])
        return found

    def _apart(self, left: str, right: str) -> bool:
        if left[-1] == GAP or (left[0] == GAP and right[0] == GAP):
            return self.merged(left + right) == [left, right]  # gap runs share one rank
        rank, limit = self.rank, np.inf
        while True:
            if rank.get(left + right, np.inf) < limit:
                return False
            a = rank[left] if len(left) > 1 else -1
            b = rank[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.halves(left)[1]
            else:
                limit, right = b + 1, self.halves(right)[0]


class Streaming:
    """Encodes one unit of characters; emits ids as they become final."""

    def __init__(self, pieces: Pieces):
        self.p = pieces

    def encode(self, unit: str) -> Iterator[int]:
        """Ids of ``unit``, committed in order. Memory: the window and the text since the last commit.

        Between two characters that stand side by side in no piece, every
        path has a boundary: what is left of it is committed at once.
        """
        p = self.p
        bridges, widest = p.bridges, p.longest
        base, n = 0, len(unit)
        back, last, best = [0], [-1], [0.0]  # of boundaries from base on: where the last piece begins, its id, the score
        for i in range(1, n + 1):
            self._extend(unit, i, base, back, last, best)
            if i == n:
                break
            if unit[i - 1 : i + 1] not in bridges:
                meet = i
            elif i - base >= 4 * widest and i % widest == 0:
                meet = self._meet(base, back, i)
            else:
                continue
            if meet > base:
                yield from self._walk(unit, base, back, last, meet)
                cut = meet - base
                back, last, best, base = back[cut:], last[cut:], best[cut:], meet
                if meet == i:
                    last[0] = -1
        yield from self._walk(unit, base, back, last, n)

    def _extend(self, unit: str, i: int, base: int, back: list[int], last: list[int], best: list[float]) -> None:
        """The surviving path of boundary ``i``. A character without a piece stands alone, as id -1."""
        p = self.p
        get, tails, scores, merges = p.ids.get, p.tails, p.scores, p.kind == "merges"
        j, chosen, at, top = i - 1, -1, i - 1, -np.inf
        if not merges:
            top = best[j - base] + scores.get(unit[j:i], p.floor)
        while j >= base:
            piece = unit[j:i]
            if piece not in tails:
                break
            found = get(piece)
            if found is not None:
                if merges:
                    before = last[j - base]
                    if before < 0 or p.stay_apart(before, found):
                        chosen, at = found, j
                        break
                elif (score := best[j - base] + scores[piece]) >= top:
                    chosen, at, top = found, j, score
            j -= 1
        back.append(at)
        last.append(chosen)
        best.append(top)

    def short(self, unit: str) -> bytes:
        """As :meth:`encode` for a unit shorter than the window needs to move, as 32-bit integers.

        Written out for merges, since nearly all units come here.
        """
        p = self.p
        if p.kind != "merges":
            return array("i", self.encode(unit)).tobytes()
        get, tails, side = p.ids.get, p.tails, p._side.get
        back, last = [0], [-1]
        for i in range(1, len(unit) + 1):
            j = at = i - 1
            chosen = -1
            while j >= 0:
                piece = unit[j:i]
                if piece not in tails:
                    break
                found = get(piece)
                if found is not None:
                    before = last[j]
                    if before < 0:
                        chosen, at = found, j
                        break
                    fits = side(before << 32 | found)
                    if fits is None:
                        fits = p.stay_apart(before, found)
                        side = p._side.get
                    if fits:
                        chosen, at = found, j
                        break
                j -= 1
            back.append(at)
            last.append(chosen)
        return array("i", self._walk(unit, 0, back, last, len(unit))).tobytes()

    def _meet(self, base: int, back: list[int], i: int) -> int:
        """The last boundary that the paths of all live boundaries share."""
        live = set(range(max(base, i - self.p.longest + 1), i + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(max(base, back[far - base]))
        return live.pop()

    def _walk(self, unit: str, base: int, back: list[int], last: list[int], end: int) -> list[int]:
        path: list[int] = []
        while end > base:
            at, found = back[end - base], last[end - base]
            if found >= 0:
                path.append(found)
            else:
                path += [self.p.byte_ids[b] for b in reversed(unit[at:end].encode("utf-8", "surrogatepass"))]
            end = at
        path.reverse()
        return path


class Codec:
    """Whole texts to ids and back, exactly."""

    def __init__(self, pieces: Pieces):
        self.p, self.stream = pieces, Streaming(pieces)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.gap_bytes = array("i", [pieces.byte_ids[b] for b in GAP.encode()]).tobytes()
        size = max([*pieces.ids.values(), *pieces.byte_ids]) + 1
        self.spelled = [b""] * size
        for piece, i in pieces.ids.items():
            self.spelled[i] = piece.replace(GAP, " ").encode()
        for b, i in enumerate(pieces.byte_ids):
            self.spelled[i] = bytes([b])

    def _fresh(self, unit: str) -> bytes:
        """A unit that the memo lacks: looked up, or encoded, in the stretches that no piece bridges."""
        found = self.older.get(unit)
        if found is None:
            bridges, start, parts = self.p.bridges, 0, []
            for i in range(1, len(unit) + 1):
                if i == len(unit) or unit[i - 1 : i + 1] not in bridges:
                    part = unit[start:i]
                    start = i
                    known = self.memo.get(part) or self.older.get(part)
                    if known is None:
                        if len(part) <= 48:
                            known = self.stream.short(part)
                            self._keep(part, known)
                        else:
                            known = array("i", self.stream.encode(part)).tobytes()
                    parts.append(known)
            if len(parts) == 1:
                return parts[0]
            found = b"".join(parts)
        if len(unit) <= 48:
            self._keep(unit, found)
        return found

    def _keep(self, unit: str, ids: bytes) -> None:
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[unit] = ids

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers. A leading gap is added, as the model expects; no piece crosses
        the start of a run of gaps, so a text falls into units there. A literal gap character is
        spelled in bytes.
        """
        out: list[bytes] = []
        for k, part in enumerate(text.split(GAP) if text else ()):
            if k:
                out.append(self.gap_bytes)
            get = self.memo.get
            for unit in _UNITS.findall(part.replace(" ", GAP) if k else GAP + part.replace(" ", GAP)):
                found = get(unit)
                if found is None:
                    found = self._fresh(unit)
                    get = self.memo.get
                out.append(found)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids): the ids of each whole text, a row per row.

    A null text has null ids and an empty one an empty list. Ids repeat and
    may be null; other columns aren't read, so their names can't clash.
    """
    batches(docs.sparkSession)
    pieces = Pieces.load(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces)
        for rb in it:
            found = [codec.encode(t or "") for t in rb.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)), mask=rb.column(1).is_null())
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), lists], names=[id_col, text_col, "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, ids array<int>")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, out_col: str = "decoded") -> DataFrame:
    """``encoded`` and the text that its ``ids`` spell; null ids give null.

    A column named as ``out_col`` is replaced. Rows repeat; an empty table
    gives an empty result.
    """
    batches(encoded.sparkSession)
    encoded = encoded.drop(out_col)
    pieces = Pieces.load(model)
    names, place = [*encoded.columns, out_col], encoded.columns.index("ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces)
        for rb in it:
            lists = rb.column(place)
            flat, ends = lists.flatten().to_pylist(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = [None if gone else codec.decode(flat[ends[i] : ends[i + 1]]) for i, gone in enumerate(lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(texts, pa.string())], names=names)

    schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])
    return encoded.mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids, round_trip): the ids, and whether they spell the text again exactly.

    :func:`encode` and :func:`decode` in one pass over the texts. A null text
    has null ids and n_ids 0, an empty one no ids. Texts of any length are read
    whole, through a window. Ids repeat and may be null; other columns aren't
    read; an empty table gives an empty result.
    """
    batches(docs.sparkSession)
    pieces = Pieces.load(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces)
        for rb in it:
            texts = rb.column(1).to_pylist()
            found = [codec.encode(t or "") for t in texts]
            same = [codec.decode(np.frombuffer(f, dtype=np.int32).tolist()) == (t or "") for f, t in zip(found, texts, strict=True)]
            ends = np.cumsum([0, *map(len, found)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)), mask=rb.column(1).is_null())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(same, pa.bool_())], names=[id_col, "n_ids", "ids", "round_trip"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_ids long, ids array<int>, round_trip boolean")
