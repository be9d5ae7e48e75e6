"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model is a published BPE vocabulary with byte fallback. A segmentation is a path of pieces; its weight is the sum over
neighbours of 0 if BPE leaves the two pieces apart when it encodes their joined string, and of minus infinity otherwise.
The path that BPE itself finds is the only one of weight 0, so a max-plus search over paths yields exactly the identifiers
of the published tokenizer.

A text is cut into chunks of `CHUNK` characters anywhere; one that fits a single chunk has no cut and no matrix. The state at a cut is the piece that covers the character
before it; around a cut, only pieces that match the text there are possible, a few dozen at most. Each chunk yields a
transfer matrix: entry (i, j) is the weight of the best path from state i at its left cut to state j at its right cut.
Matrices are multiplied in the max-plus semiring, which is associative, so products are formed in groups of `GROUP` chunks
and then over the groups. One task does the chunks of a group; a text of several groups is spread over tasks. The vectors of states reached at every cut select one state for each cut (the scan), and each
chunk is backtraced on its own between its two states.

A piece never holds a word start inside (checked when the vocabulary is loaded), so within a chunk every path passes all
word starts. Words between them have one inner path: the words of a batch are dictionary-encoded in Arrow, the distinct
ones are merged at once in numpy, and their pieces are gathered by index. Only the ends of a chunk, and runs without a word
start, are searched piece by piece.

Decoding joins the pieces, turns byte pieces back into UTF-8 and drops the space that encoding put in front.

Defined results: a null text has null ids; an empty text has none. Characters outside the vocabulary become byte pieces.
Decoding gives back the text exactly, but for the character U+2581, which is decoded as a space, as in the published
tokenizer. Repeated rows are encoded each; further columns stay, `ids` and `n_ids` are replaced if they exist. Rows are
told apart by their place, not by doc_id, so null and repeated ids do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.batches import small_batches
from hearken.llm.lines import slabs
from hearken.session import materialize

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 8192  # characters
GROUP = 8  # chunks whose matrices one task multiplies
NEVER = -np.inf
START = re.compile(f"(?<!{SPACE}){SPACE}")
CACHE = 1 << 18  # words remembered by a worker
SLAB = 1 << 20  # characters whose words are merged at once


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    """Pieces, their ranks, and the merges that build them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.rank = np.array([-p.score for p in model.pieces], np.float64)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a word start inside")
        pairs = [
            (self.ids[p[:cut]] << 32 | self.ids[p[cut:]], whole)
            for p, whole in self.ids.items()
            for cut in range(1, len(p))
            if p[:cut] in self.ids and p[cut:] in self.ids
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_whole = np.array([w for _, w in pairs], np.int64)
        self.unknown: dict[str, int] = {}  # characters outside the vocabulary get numbers from len(pieces) on
        self.char_of: dict[int, str] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.spelled: dict[bytes, list[int]] = {}  # identifiers of words, spaces as they are
        self.bytes = [p.encode() for p in self.pieces]
        for value, i in enumerate(self.byte_ids.tolist()):
            self.bytes[i] = bytes([value])
        self.inside = np.zeros((256, 256), bool)  # bytes that meet at the characters inside a piece
        for piece in self.ids:
            chars = [c.encode() for c in piece.replace(SPACE, " ")]
            for a, b in zip(chars, chars[1:]):
                self.inside[a[-1], b[0]] = True
        self.plain_bytes = pa.array([b.replace(SPACE.encode(), b" ") for b in self.bytes], pa.binary())

    def symbol(self, char: str) -> int:
        found = self.ids.get(char)
        if found is None:
            found = self.unknown.setdefault(char, len(self.pieces) + len(self.unknown))
            self.char_of[found] = char
        return found

    def string(self, piece: int) -> str:
        return self.pieces[piece] if piece < len(self.pieces) else self.char_of[piece]

    def merged(self, words: list[str]) -> list[tuple[int, ...]]:
        """BPE of many strings at once: in each step every string merges its pair of lowest rank, the leftmost of equals."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        begins = np.cumsum(lengths) - lengths
        chars, which = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in chars.tolist()], np.int64)[which]
        order = np.argsort(lengths, kind="stable")
        found: list[tuple[int, ...]] = [()] * len(words)
        for at in range(0, len(order), 4096):  # strings of like length share a matrix
            part = order[at : at + 4096]
            left = lengths[part]
            place = np.arange(left[-1] + 1)
            grid = symbols[np.minimum(begins[part, None] + place, len(symbols) - 1)]
            grid[place >= left[:, None]] = -1
            self._merge(grid)
            ends = np.cumsum((grid >= 0).sum(axis=1)).tolist()
            flat = grid[grid >= 0].tolist()
            for i, low, high in zip(part.tolist(), [0, *ends], ends):
                found[i] = tuple(flat[low:high])
        return found

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, whole) of neighbours: the rank is infinite where they do not merge; -1 stands beyond the end."""
        keys = np.where(right < 0, -1, left << 32 | np.maximum(right, 0))
        spot = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        whole = self.pair_whole[spot]
        return np.where(self.pair_keys[spot] == keys, self.rank[whole], np.inf), whole

    def _merge(self, grid: np.ndarray) -> None:
        """BPE of every row in place; only the two pairs beside a merge are ranked anew."""
        live, now = np.arange(len(grid)), grid.copy()
        rank, whole = self._pair(now[:, :-1], now[:, 1:])
        place = np.arange(rank.shape[1])
        while len(live):
            best = rank.argmin(axis=1)
            going = rank[np.arange(len(live)), best] < np.inf
            if not going.all():
                grid[live[~going]] = now[~going]
                live, now, rank, whole, best = live[going], now[going], rank[going], whole[going], best[going]
            rows = np.arange(len(live))
            now[rows, best] = whole[rows, best]
            later = place > best[:, None]
            now[:, :-1] = np.where(later, now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            for table in (rank, whole):
                table[:, :-1] = np.where(later[:, :-1], table[:, 1:], table[:, :-1])
            rank[:, -1] = np.inf
            for spot in (np.maximum(best - 1, 0), best):
                rank[rows, spot], whole[rows, spot] = self._pair(now[rows, spot], now[rows, spot + 1])

    def merged_long(self, text: str) -> list[int]:
        """BPE of one long string without word starts: a heap of pairs over a linked list."""
        import heapq

        ids = [self.symbol(c) for c in text]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < len(ids):
                key = ids[left] << 32 | ids[right]
                spot = int(np.searchsorted(self.pair_keys, key))
                if spot < len(self.pair_keys) and self.pair_keys[spot] == key:
                    heapq.heappush(heap, (float(self.rank[self.pair_whole[spot]]), left, key, int(self.pair_whole[spot])))

        for left in range(len(ids) - 1):
            offer(left)
        while heap:
            _, left, key, whole = heapq.heappop(heap)
            right = after[left] if ids[left] >= 0 else len(ids)
            if right >= len(ids) or ids[left] << 32 | ids[right] != key:
                continue
            ids[left], ids[right] = whole, -1
            after[left] = after[right]
            if after[right] < len(ids):
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [i for i in ids if i >= 0]

    def together(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces apart, so that they may be neighbours: weight 0, else minus infinity."""
        found = self.apart.get((left, right))
        if found is None:
            a, b = self.string(left), self.string(right)
            found = (b[0] == SPACE and a[-1] != SPACE) or self.merged_long(a + b) == [left, right]
            self.apart[left, right] = found
        return found

    def at(self, text: str, start: int, end: int) -> int | None:
        """The piece that these characters can be: a single character, or one that BPE builds from its own string."""
        if end == start + 1:
            return self.symbol(text[start])
        piece = self.ids.get(text[start:end])
        if piece is None:
            return None
        if piece not in self.alone:
            self.alone[piece] = self.merged_long(self.pieces[piece]) == [piece]
        return piece if self.alone[piece] else None

    def bytes_for(self, symbols: list[int] | tuple[int, ...]) -> list[int]:
        """Identifiers, with byte pieces in place of unknown characters."""
        known = len(self.pieces)
        if not symbols or max(symbols) < known:
            return list(symbols)
        found: list[int] = []
        for s in symbols:
            found += [s] if s < known else self.byte_ids[list(self.string(s).encode("utf-8", "replace"))].tolist()
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def prepared(text: str) -> str:
    """What the pieces are matched to: a space in front, and spaces as U+2581."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def spaced(texts: pa.Array) -> pa.StringArray:
    """`prepared` for an Arrow array, with spaces in place of U+2581."""
    front = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
    return pc.replace_substring(front, SPACE, " ")


def encode_array(voc: Vocabulary, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers of all texts, where those of each text begin and end); every text begins at a word start, with a space.

    Words are cut wherever two characters meet as they do in no piece (before spaces, but also at most punctuation), so that
    no piece can lie over a cut. They cover the bytes without gaps.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~voc.inside[raw[:-1], raw[1:]]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    edges = np.r_[starts, len(raw)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
    spelled = spell(voc, words.dictionary.to_pylist())
    which = words.indices.to_numpy()
    sizes = np.array([len(x) for x in spelled], np.int64)
    flat = np.fromiter(chain.from_iterable(spelled), np.int32, int(sizes.sum()))
    n = sizes[which]
    ends = np.cumsum(n)
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n) + np.arange(ends[-1])]
    return ids, np.r_[0, ends][np.searchsorted(starts, offsets)]


def spell(voc: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """Identifiers of distinct words."""
    known = voc.spelled
    if len(known) > CACHE:
        known.clear()
    new = [w for w in words if w not in known]
    texts = [w.decode().replace(" ", SPACE) for w in new]
    short = [i for i, text in enumerate(texts) if len(text) <= 64]
    for i, symbols in zip(short, voc.merged([texts[i] for i in short])):
        known[new[i]] = voc.bytes_for(symbols)
    for word, text in zip(new, texts):
        if len(text) > 64:
            known[word] = voc.bytes_for(voc.merged_long(text))
    return [known[w] for w in words]


def gives_back(voc: Vocabulary, texts: pa.StringArray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the bytes of the pieces of each text are those of the text."""
    joined = voc.plain_bytes.take(pa.array(ids))
    at = np.r_[0, np.cumsum(pc.binary_length(joined).to_numpy())][bounds]
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), b"")[0].as_buffer()
    texts = texts.cast(pa.binary()).fill_null(b"")
    whole = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32)), data])
    return pc.equal(whole, texts).to_numpy(zero_copy_only=False)


State = tuple[int, int, int]  # first and last character (exclusive) of a piece, and the piece


def states_at(voc: Vocabulary, text: str, cut: int) -> list[State]:
    """The pieces that may cover the character before the cut, in order."""
    spans = [(a, b) for a in range(max(0, cut - voc.longest), cut) for b in range(cut, min(len(text), a + voc.longest) + 1)]
    return [(a, b, piece) for a, b in spans if (piece := voc.at(text, a, b)) is not None]


def paths_from(voc: Vocabulary, text: str, state: State, stop: int) -> dict[int, tuple[int, int]]:
    """(place before, piece) for every place from the state's end to `stop`, and just beyond, that a path of weight 0 reaches.

    For one origin no two such paths end with different pieces at a place. A piece of -1 stands for a word start or text end.
    """
    reached = {state[1]: (state[0], state[2])}
    for at in range(state[1], stop):
        if at in reached:
            before = reached[at][1]
            for end in range(at + 1, min(len(text), at + voc.longest) + 1):
                piece = voc.at(text, at, end)
                if piece is not None and (before < 0 or voc.together(before, piece)):
                    reached.setdefault(end, (at, piece))
    return reached


class Chunk:
    """Characters `low` to `high` of a prepared text, with the surroundings that pieces over the cuts need.

    `text` holds the characters from `low - margin` on; `first` and `last` say whether the text itself begins or ends here.
    """

    def __init__(self, voc: Vocabulary, text: str, low: int, high: int, first: bool, last: bool):
        self.voc, self.text, self.low, self.high = voc, text, low, high
        self.left: list[State] = [(low, low, -1)] if first else states_at(voc, text, low)
        self.right: list[State] = [(high, high, -1)] if last else states_at(voc, text, high)
        head = low if first and high > low else next((m.start() for m in START.finditer(text, low + 1, high)), -1)
        tail = text.rfind(SPACE, low, high)
        while tail > low and text[tail - 1] == SPACE:
            tail -= 1
        self.starts = () if head < 0 else (head, max(head, tail))  # the first and the last one

    def _steps(self, origin: State) -> dict[int, tuple[int, int]]:
        return paths_from(self.voc, self.text, origin, self.high)

    def _arrives(self, reached: dict[int, tuple[int, int]], target: State) -> bool:
        if target[2] < 0:
            return target[1] in reached
        return reached.get(target[1]) == (target[0], target[2])

    def matrix(self) -> np.ndarray:
        """Transfer matrix: 0 where a path of neighbours that BPE leaves apart leads from state i to state j."""
        found = np.full((len(self.left), len(self.right)), NEVER)
        if not self.starts:
            for i, state in enumerate(self.left):
                reached = self._steps(state)
                for j, target in enumerate(self.right):
                    if target == state or self._arrives(reached, target):
                        found[i, j] = 0.0
            return found
        head, tail = self.starts
        enters = np.array([0.0 if head in self._head(s, head) else NEVER for s in self.left])
        reached = self._steps((tail, tail, -1))
        leaves = np.array([0.0 if self._arrives(reached, t) else NEVER for t in self.right])
        return enters[:, None] + leaves[None]

    def _head(self, state: State, head: int) -> dict[int, tuple[int, int]]:
        return paths_from(self.voc, self.text, state, head)

    def backtrace(self, i: int, j: int) -> tuple[list[int], str, list[int]]:
        """What lies after left state i up to and with right state j: symbols, whole words, symbols."""

        def back(reached: dict[int, tuple[int, int]], at: int, floor: int) -> list[int]:
            found = []
            while at > floor:
                at, piece = reached[at]
                found.append(piece)
            return found[::-1]

        state, target = self.left[i], self.right[j]
        if target == state:
            return [], "", []
        if not self.starts:
            return back(self._steps(state), target[1], state[1]), "", []
        head, tail = self.starts
        before = back(self._head(state, head), head, state[1]) if state[1] < head else []
        return before, self.text[head:tail], back(self._steps((tail, tail, -1)), target[1], tail)


def joined_ids(voc: Vocabulary, traced: list[tuple[list[int], str, list[int]]]) -> list[np.ndarray]:
    """Identifiers of backtraced chunks; the words of all of them are looked up together."""
    inner = pa.array([words.replace(SPACE, " ") for _, words, _ in traced], pa.string())
    ids, bounds = encode_array(voc, inner)
    return [
        np.concatenate([np.array(voc.bytes_for(a), np.int32), ids[low:high], np.array(voc.bytes_for(b), np.int32)])
        for (a, _, b), low, high in zip(traced, bounds[:-1].tolist(), bounds[1:].tolist())
    ]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def choose(first: int, last: int, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states (left, right) of every matrix on the best path from state `first` to state `last`."""
    forward = [np.full(len(matrices[0]), NEVER)]
    forward[0][first] = 0.0
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    if forward[-1][last] == NEVER:
        raise ValueError("no path through the chunks")
    found, right = [], last
    for reached, m in zip(forward[-2::-1], matrices[::-1]):
        left = int((reached + m[:, right]).argmax())
        found.append((left, right))
        right = left
    return found[::-1]


def chunk_rows(text: str, margin: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """(number, slice, low, high, first, last) of the chunks of a prepared text."""
    count = -(-len(text) // CHUNK)
    for no in range(count):
        low, high = no * CHUNK, min(len(text), (no + 1) * CHUNK)
        base = max(0, low - margin)
        yield no, text[base : high + margin], low - base, high - base, no == 0, no == count - 1


def scanned(voc: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The whole scan for some texts, in this process."""
    traced, counts = [], []
    for text in texts:
        chunks = [Chunk(voc, *row[1:]) for row in chunk_rows(prepared(text), voc.longest)]
        path = choose(0, 0, [c.matrix() for c in chunks]) if chunks else []
        traced += [c.backtrace(i, j) for c, (i, j) in zip(chunks, path)]
        counts.append(len(chunks))
    ids = joined_ids(voc, traced)
    ends = np.cumsum([0, *counts]).tolist()
    return [np.concatenate([np.zeros(0, np.int32), *ids[low:high]]) for low, high in zip(ends, ends[1:])]


def encode_chunks(voc: Vocabulary, text: str) -> list[int]:
    """The identifiers of one text by the scan."""
    return scanned(voc, [text])[0].tolist()


def as_matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["weights"], np.float32).reshape(row["n"], -1)


def _encode_whole(batches: Iterator[pa.RecordBatch], path: str, place: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path)
    for batch in batches:
        for part in slabs(batch, place, SLAB):
            column = part.column(place).cast(pa.string())
            absent, texts = column.is_null(), spaced(column)
            cut = pc.fill_null(pc.greater(pc.utf8_length(texts), CHUNK), False)
            ids, bounds = encode_array(voc, pc.if_else(cut, "", texts))
            found = [ids[low:high] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            rows = np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist()
            for row, given in zip(rows, scanned(voc, [column[row].as_py() for row in rows])):
                found[row] = given
            ids, bounds = np.concatenate([np.zeros(0, np.int32), *found]), np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), pa.list_(pa.int32()), mask=absent)
            same = pc.if_else(absent, None, pa.array(gives_back(voc, texts, ids, bounds)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, same], names)


def _cut_ids(long: DataFrame, text_col: str, path: str) -> DataFrame:
    """(row, ids) of texts of several groups by chunks, transfer matrices, scan and backtraces."""
    keys = "row bigint, no int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = vocabulary(path).longest
        names = ["row", "no", "text", "low", "high", "first", "last"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for chunk in chunk_rows(prepared(value.as_py()), margin):
                    held.append((row, *chunk))
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [Chunk(voc, *[r[k] for k in ("text", "low", "high", "first", "last")]).matrix() for r in rows]
            data = [m.astype(np.float32).tobytes() for m in found]
            columns = [pa.array([len(m) for m in found], pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "no", "n", "weights"])

    def multiply(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        total = as_matrix(rows[0])
        for r in rows[1:]:
            total = product(total, as_matrix(r))
        whole = {"row": rows[0]["row"], "part": rows[0]["part"], "n": len(total), "weights": total.astype(np.float32).tobytes()}
        return pa.Table.from_pylist([whole], schema=pa.schema([("row", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("weights", pa.binary())]))

    def scan_parts(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        chosen = choose(0, 0, [as_matrix(r) for r in rows])
        found = [{"row": r["row"], "part": r["part"], "from": i, "to": j} for r, (i, j) in zip(rows, chosen)]
        return pa.Table.from_pylist(found, schema=pa.schema([("row", pa.int64()), ("part", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))

    def scan_chunks(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        chosen = choose(rows[0]["from"], rows[0]["to"], [as_matrix(r) for r in rows])
        found = [{"row": r["row"], "no": r["no"], "i": i, "j": j} for r, (i, j) in zip(rows, chosen)]
        return pa.Table.from_pylist(found, schema=pa.schema([("row", pa.int64()), ("no", pa.int32()), ("i", pa.int32()), ("j", pa.int32())]))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            chunks = [(Chunk(voc, *[r[k] for k in ("text", "low", "high", "first", "last")]), r["i"], r["j"]) for r in batch.to_pylist()]
            ids = joined_ids(voc, [chunk.backtrace(i, j) for chunk, i, j in chunks])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["row", "no", "ids"])

    kinds = f"{keys}, text string, low int, high int, first boolean, last boolean"
    chunks = materialize(long.select("row", text_col).mapInArrow(split, kinds).repartition("row", "no"), "chunks")
    matrices = materialize(
        chunks.mapInArrow(transfer, f"{keys}, n int, weights binary").withColumn("part", (F.col("no") / GROUP).cast("int")), "matrices"
    )
    products = matrices.groupBy("row", "part").applyInArrow(multiply, "row bigint, part int, n int, weights binary")
    ends = products.groupBy("row").applyInArrow(scan_parts, "row bigint, part int, from int, to int")
    chosen = matrices.join(ends, ["row", "part"]).groupBy("row", "part").applyInArrow(scan_chunks, f"{keys}, i int, j int")
    traced = chunks.join(chosen, ["row", "no"]).select("row", "no", "text", "low", "high", "first", "last", "i", "j")
    parts = traced.mapInArrow(back, f"{keys}, ids array<int>")
    ordered = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return ordered.select("row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def n_chunks(text: Column) -> Column:
    """Into how many chunks a text is cut; encoding puts one character in front."""
    return F.when(text.isNotNull(), F.ceil((F.length(text) + F.least(F.length(text), F.lit(1))) / CHUNK).cast("int"))


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with the columns ids (array<int>), n_ids, and round_trip: whether decoding the ids gives back the text."""
    path = path or model_path()
    rest = [c for c in docs.columns if c not in ("ids", "n_ids", "round_trip")]
    given = small_batches(docs).select(rest)
    spread = F.coalesce(n_chunks(F.col(text_col)) > GROUP, F.lit(False))

    place, names = rest.index(text_col), [*rest, "ids", "round_trip"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", ids array<int>, round_trip boolean"
    done = given.filter(~spread).mapInArrow(lambda batches: _encode_whole(batches, path, place, names), schema)

    long = given.filter(spread).select(F.struct(*rest).alias("own"), F.col(text_col).alias("text"))
    long = materialize(long.withColumn("row", F.monotonically_increasing_id()), "long")
    ids = materialize(_cut_ids(long, "text", path), "long-ids")
    same = F.col("decoded") == F.replace(F.col("text"), F.lit(SPACE), F.lit(" "))
    traced = decode(long.join(ids, "row"), "decoded", path).select("own.*", "ids", same.alias("round_trip"))
    return done.unionByName(traced).select(*rest, "ids", F.size("ids").cast("bigint").alias("n_ids"), "round_trip")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with the columns ids and n_ids."""
    return round_trip(docs, text_col, path).drop("round_trip")


def decode(encoded: DataFrame, into: str = "decoded", path: str | None = None) -> DataFrame:
    """`encoded` with the text of its ids in the column `into`; null ids give null."""
    path = path or model_path()
    rest = [c for c in encoded.columns if c != into]
    place = rest.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else voc.decode(x) for x in (v.as_py() for v in batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, into])

    picked = small_batches(encoded).select(rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema) + f", `{into}` string"
    return picked.mapInArrow(run, schema)
