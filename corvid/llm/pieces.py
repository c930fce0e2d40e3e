"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read left to right. At each position the search keeps the last piece of the best path that ends there; it looks back
no further than the longest piece, and as soon as the paths of all positions that can still be extended meet in one boundary,
the ids before it are committed and forgotten. So memory is bounded by the window, not by the text.

The model at hand is a byte-pair model, whose segmentation isn't the one of the largest sum of scores but the one its merges
make. So a path's score is whether merging makes it: a piece may follow another only if merging the two together gives these
two again. Merges are local, so a path is the model's own segmentation exactly if all its neighbours are, and at most one
path survives at each position. The ids are those that the sentencepiece library gives, character for character.

Characters without a piece become their UTF-8 bytes' pieces. Stretches between blanks are encoded once and remembered (no piece
holds a blank after another character, so all paths meet before a blank).

Edge cases: a null text has null ids; an empty text has no ids. Unknown ids raise an error in decode; null ids give a null
text. Repeated rows get equal ids. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "\u2581"
#: What a worker remembers before it starts anew: bytes of stretches with their ids, and pairs of pieces (about 150 bytes each).
MEMORY_BYTES, PAIR_MEMORY = 64 << 20, 300_000
#: Bytes of text that are encoded together, and ids that are decoded together.
BLOCK_BYTES, BLOCK_IDS = 2 << 20, 1 << 18
#: About what a remembered stretch takes besides its characters and ids.
ENTRY_BYTES = 200
STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PieceModel:
    """Pieces, their ranks and the pairs that may stand side by side."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.rank[piece] = (model.get_score(i), i)
        self.rank = {p: r for p, r in self.rank.items() if self.merged(p) == [p]}  # merging can't make the others
        self.longest = max(map(len, self.rank))
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: marks that never follow a letter within a piece
        self.marks = [c for c in string.punctuation if not any(b[1] == c and b[0].isalpha() for b in self.inside)]
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.packed = {p: np.asarray([i], dtype="<u4").tobytes() for p, (_, i) in self.rank.items()}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: again and again the neighbours whose union scores best, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.rank.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether merging keeps the boundary between two pieces."""
        ok = self.fits.get((left, right))
        if ok is None:
            if len(self.fits) >= PAIR_MEMORY:
                self.fits.clear()
            ok = self.fits[left, right] = left[-1] + right[0] not in self.inside or self.merged(left + right) == [left, right]
        return ok

    def extend(self, text: str, last: list[str], before: str) -> None:
        """Appends to last, for each further end of text, the piece of the path that survives there; before: the committed piece.

        The automaton gives the pieces that end at each character, longest first; the first that may follow survives, and
        where there is none a single character does.
        """
        fits, done = self.fits, len(last)
        for end, piece in self.automaton.iter(text, max(0, done - self.longest + 1)):
            if end < done:
                continue
            if len(last) < end:
                last.extend(text[len(last) : end])
            begin = end + 1 - len(piece)
            left = last[begin - 1] if begin else before
            if not left:
                ok = True
            else:
                ok = fits.get((left, piece))
                if ok is None:
                    ok = self.follows(left, piece)
            if ok:
                last.append(piece)
                done = end + 1
        last.extend(text[len(last) :])

    def pieces(self, chunks: Iterable[str]) -> Iterator[str]:
        """Streaming Viterbi over the characters of chunks (blanks already as BLANK); yields committed pieces."""
        text, last, before = "", [], ""
        for chunk in chunks:
            for at in range(0, len(chunk), 8 * self.longest):
                text += chunk[at : at + 8 * self.longest]
                self.extend(text, last, before)
                if len(text) >= 4 * self.longest and (cut := self.meeting(last)):
                    done = self.path(last, cut)
                    yield from done
                    before, text, last = done[-1], text[cut:], last[cut:]
        if text:
            yield from self.path(last, len(text))

    def meeting(self, last: list[str]) -> int:
        """The last boundary that the paths of all ends within reach of a further piece share."""
        at = set(range(max(1, len(last) - self.longest), len(last) + 1))
        while len(at) > 1:  # the furthest goes back by its piece until all have met
            top = max(at)
            at.remove(top)
            at.add(top - len(last[top - 1]))
        return at.pop()

    @staticmethod
    def path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(last[end - 1])
        return out[::-1]

    def ids(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            found = self.rank.get(piece)
            if found is None:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(found[1])
        return out

    def stretch(self, text: str) -> bytes:
        """Packed ids of one stretch."""
        packed = self.known.get(text)
        if packed is None:
            packed = np.asarray(self.ids(self.pieces([text])), dtype="<u4").tobytes()
            self.remember({text: packed})
        return packed

    def remember(self, found: dict[str, bytes]) -> None:
        """Keeps the ids of short stretches, within the bytes that a worker may hold."""
        for text, packed in found.items():
            if len(text) <= 64 and text not in self.known:
                self.held += ENTRY_BYTES + 2 * len(text) + len(packed)
                if self.held > MEMORY_BYTES:
                    self.known.clear()
                    self.held = ENTRY_BYTES + 2 * len(text) + len(packed)
                self.known[text] = packed

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Packed ids of stretches without U+0000, by one stream over all that aren't known yet."""
        new = [w for w in stretches if w not in self.known]
        found, one, packed, nth = {}, [], self.packed, 0
        for piece in self.pieces(["\0".join([*new, ""])]):
            if piece == "\0":
                found[new[nth]] = b"".join(one)
                nth += 1
                one = []
            else:
                one.append(packed.get(piece) or np.asarray(self.ids([piece]), dtype="<u4").tobytes())
        known = {w: self.known[w] for w in stretches if w in self.known} | found
        self.remember(found)
        return known

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        marked = BLANK + text.replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.stretch, STRETCH.findall(marked))), dtype="<u4")

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin; by way of the distinct stretches."""
        filled = texts.fill_null("")
        marked = pc.if_else(pc.equal(filled, ""), "", pc.binary_join_element_wise(pc.cast("", pa.string()), pc.replace_substring(filled, " ", BLANK), BLANK))
        # a cut goes before each blank or mark that no piece holds after the character before it; U+0000 can't be told from it, so such texts go one by one
        marked = pc.replace_substring_regex(marked, f"([^{BLANK}]){BLANK}", f"\\1\0{BLANK}")
        if self.marks:
            marked = pc.replace_substring_regex(marked, rf"(\p{{L}})([{re.escape(''.join(self.marks))}])", "\\1\0\\2")
        lists = pc.split_pattern(marked, "\0")
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary.to_pylist()
        known = self.learn([w for w in words if w])
        packed = [known[w] if w else b"" for w in words]
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        code, at = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        length = size[code]
        ends = np.concatenate([[0], np.cumsum(length)])
        return flat[np.repeat(first[code] - ends[:-1], length) + np.arange(ends[-1])], ends[at - at[0]]


class PieceBytes:
    """The bytes of every id, in one row: all that decoding needs."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        each = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            plain = b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(BLANK, " ").encode()
            each.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else plain)
        self.size = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(each), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids in a row, and where each id's end (0 first). An id that the model doesn't have raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError(f"an id is outside 0 to {len(self.size) - 1}")
        length = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(self.first[ids] - ends[:-1], length) + np.arange(ends[-1])].tobytes(), ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the blank that encoding puts in front."""
        data = b"".join(self.join(ids[i : i + BLOCK_IDS])[0] for i in range(0, len(ids), BLOCK_IDS))
        return data.removeprefix(b" ").decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of neighbouring stretches of ids, at[k] to at[k + 1]."""
        if len(at) == 2:
            return [self.decode(ids[at[0] : at[1]])]
        data, ends = self.join(ids[at[0] : at[-1]])
        place = ends[at - at[0]].tolist()
        return [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(place[:-1], place[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def piece_model(model_file: str) -> PieceModel:
    """The model of a worker: what it remembers serves all of the worker's tasks."""
    return PieceModel(model_file)


@functools.lru_cache(maxsize=2)
def piece_bytes(model_file: str) -> PieceBytes:
    return PieceBytes(model_file)


IDS = T.ArrayType(T.IntegerType())


def blocks(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sizes add up to about most; a larger row is a slice of its own."""
    size = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.cumsum(size) // most + np.cumsum(size >= most)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in (part for b in batches for part in blocks(b, pc.binary_length(b.column(1)), BLOCK_BYTES)):
            texts = batch.column(1)
            if pc.any(pc.match_substring(texts, "\0")).as_py():
                parts = [model.encode(t or "") for t in texts.to_pylist()]
                flat, begins = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            else:
                flat, begins = model.encode_all(texts)
            ids = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat.astype(np.int32)), mask=pc.is_null(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=schema.names)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id", "ids"), ids_col: str = "ids") -> DataFrame:
    """The kept columns and the text of every row."""
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_model.cache_clear()  # this worker may have encoded before
        model = piece_bytes(model_file)
        for batch in (part for b in batches for part in blocks(b, pc.list_value_length(b.column(len(keep))), BLOCK_IDS)):
            ids = batch.column(len(keep))
            texts = pa.array(model.decode_all(ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()), pa.string())
            texts = pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts], names=schema.names)
        pa.default_memory_pool().release_unused()

    return encoded.select(*keep, F.col(ids_col).alias("_ids_to_decode")).mapInArrow(run, schema)
